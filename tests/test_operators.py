"""Joins, bands, grids, rules and simulations on small literal inputs."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from terracadence.functions import geo as G
from terracadence.functions import numbers as N
from terracadence.functions import spectral as S
from terracadence.functions import times as T
from terracadence.functions.clip import overlap_area
from terracadence.operators import aggregates as A
from terracadence.operators import audit, band, joins, rules, sampling, simulate
from terracadence.operators import windows as W
from terracadence.plans import features, payloads
from terracadence.sources import readers, sinks


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_finite(spark):
    df = spark.createDataFrame([("1.5",), ("x",), ("NaN",), ("Infinity",), (None,)], "x string")
    assert [r[0] for r in df.select(N.finite("x")).collect()] == [1.5, None, None, None, None]


def test_index_of_pixels(spark):
    px = lambda **k: {"B4": 1000.0, "B8": 7000.0, "cloudy": False, "valid": True} | k
    full = "struct<" + ", ".join(f"{b}: double" for b in ("B2", "B3", "B4", "B6", "B7", "B8", "B8A", "B11", "B12")) + ", cloudy: boolean, valid: boolean>"
    rows = [("f", "i", "2025-01-01T00:00:00Z", 1e-4, [px(), px(B4=1500.0, B8=8500.0), px(cloudy=True), px(valid=False)])]
    rows = [(a, b, c_, d, [tuple(p.get(n) for n in ("B2", "B3", "B4", "B6", "B7", "B8", "B8A", "B11", "B12", "cloudy", "valid")) for p in ps]) for a, b, c_, d, ps in rows]
    r = features.optical_features(spark.createDataFrame(rows, f"field_id string, source_image_id string, acquisition_datetime string, value_scale double, pixels array<{full}>")).first()
    assert (r.valid_pixel_count, r.total_pixel_count, r.cloud_fraction) == (2, 4, 0.25)
    assert r.NDVI_mean == pytest.approx(0.725) and r.NDVI_std == pytest.approx(0.025) and r.NBR_mean is None


def test_parse_and_clock(spark):
    r = one(spark, T.parse_utc(F.lit("2025-01-01T05:30:00+05:30")).alias("a"), T.parse_utc(F.lit("2025-01-01T00:00:00")).alias("b"), T.local_hour(F.lit(2000)).alias("h"), T.date_of(F.lit(2024), F.lit(60)).alias("d"), T.at_clock(F.lit("2024-11-27"), F.lit(530)).alias("t"))
    assert r.a == r.b == dt.datetime(2025, 1, 1) and r.h == 1.5 and r.d == dt.date(2024, 2, 29) and r.t == dt.datetime(2024, 11, 27, 5, 30)


def test_geometry(spark):
    square = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (4, 0), (4, 4), (0, 4))])
    cx, cy = G.ring_centroid(square)
    r = one(spark, G.ring_area(square).alias("a"), cx.alias("cx"), cy.alias("cy"), G.in_ring(F.lit(4.0), F.lit(2.0), square).alias("edge"), G.polygon_distance(F.lit(7.0), F.lit(8.0), square).alias("d"), G.haversine_km(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("km"))
    assert (r.a, r.cx, r.cy, r.edge, r.d) == (16.0, 2.0, 2.0, True, 5.0) and r.km == pytest.approx(111.1950802, abs=1e-6)


def test_projection(spark):
    x, y = G.utm_xy(F.lit(30.9), F.lit(75.0))
    a, b = G.utm_xy(F.lit(0.0), F.lit(76.0))
    r = one(spark, x.alias("x"), y.alias("y"), a.alias("a"), b.alias("b"))
    assert r.x == pytest.approx(500000, abs=1e-6) and r.y == pytest.approx(0.9996 * 3419846.79, rel=2e-4)
    assert r.b == pytest.approx(0, abs=1e-6) and r.a == pytest.approx(500000 + 0.9996 * 111325, abs=20)


def test_overlap_of_polygons(spark):
    shape = "a array<struct<x: double, y: double>>, b array<struct<x: double, y: double>>"
    box = lambda x, y, s: [(x, y), (x + s, y), (x + s, y + s), (x, y + s)]
    ell = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (1.0, 1.0), (1.0, 4.0), (0.0, 4.0)]
    df = spark.createDataFrame([(box(0.0, 0.0, 4.0), box(2.0, 2.0, 4.0)), (ell, box(0.5, 0.5, 1.0)), (box(0.0, 0.0, 1.0), box(5.0, 5.0, 1.0))], shape)
    assert [r[0] for r in df.select(overlap_area("a", "b")).collect()] == pytest.approx([4.0, 0.75, 0.0])


def test_asof_against_plain(spark):
    rnd = random.Random(3)
    left = [(i, rnd.randrange(4), rnd.randrange(50)) for i in range(80)]
    right = [(rnd.randrange(3), rnd.randrange(50), i) for i in range(60)]
    l, r = spark.createDataFrame(left, "id int, k int, t long"), spark.createDataFrame(right, "k int, t long, r int")
    for strict in (False, True):
        out = {x.id: x.asof_r for x in joins.asof(l, r, ["k"], "t", "t", ["r"], 10, tie="r", strict=strict).collect()}
        for i, k, t in left:
            fits = [(u, v) for kk, u, v in right if kk == k and (u < t if strict else u <= t) and u >= t - 10]
            assert out[i] == (max(fits)[1] if fits else None)


def test_asof_statuses(spark):
    l, r = spark.createDataFrame([(1, "a", 20), (2, "a", 2), (3, "b", 5)], "id int, k string, t long"), spark.createDataFrame([("a", 15)], "k string, t long")
    out = joins.asof_with_status(l, r, ["k"], "t", "t", [], 12).orderBy("id").collect()
    assert [x.asof_status for x in out] == ["AVAILABLE", "NONE_WITHIN_TOLERANCE", "NOT_ACQUIRED"]


def test_many_to_one_refuses_repeats(spark):
    with pytest.raises(ValueError):
        joins.many_to_one(spark.range(1), spark.createDataFrame([(0,), (0,)], "id long"), ["id"])


def test_radius_is_closed_and_exact(spark):
    rnd = random.Random(5)
    a = [(i, float(rnd.randrange(-30, 30)), float(rnd.randrange(-30, 30))) for i in range(60)]
    b = [(i, float(rnd.randrange(-30, 30)), float(rnd.randrange(-30, 30))) for i in range(60)]
    l, r = spark.createDataFrame(a, "id int, x double, y double"), spark.createDataFrame(b, "o int, ox double, oy double")
    got = {(p.id, p.o) for p in band.radius_pairs(l, r, 5.0, ("x", "y"), ("ox", "oy")).collect()}
    assert got == {(i, j) for i, x, y in a for j, u, v in b if math.hypot(x - u, y - v) <= 5.0}


def test_merge_and_thinning(spark):
    i = spark.createDataFrame([("a", 0, 5), ("a", 5, 7), ("a", 8, 9), ("a", 1, 2)], "k string, s int, e int")
    assert sorted((r.s, r.e) for r in W.merge_intervals(i, ["k"], "s", "e").collect()) == [(0, 7), (8, 9)]
    d = spark.createDataFrame([("a", dt.date(2025, 1, x)) for x in (1, 3, 5, 6, 10)], "k string, d date")
    assert sorted(r.d.day for r in W.thin_dates(d, ["k"], "d", 4).collect()) == [1, 5, 10]


def test_complete_windows(spark):
    df = spark.createDataFrame([("g", k, v) for k, v in enumerate((1.0, 2.0, None, 4.0, 5.0, 6.0))], "g string, t int, r double")
    assert [r.s for r in W.complete_sum(df, ["g"], ["t"], "r", 2, "s").orderBy("t").collect()] == [None, 3.0, None, None, 9.0, 11.0]


def test_numbering_without_a_single_task(spark):
    df = spark.createDataFrame([(x,) for x in random.Random(1).sample(range(1000), 300)], "x int")
    out = [r.row_rank for r in W.numbered_globally(df, [F.col("x")]).orderBy("x").collect()]
    assert out == list(range(1, 301))


def test_nearest_rank(spark):
    df = spark.createDataFrame([("g", float(x)) for x in range(1, 12)], "g string, v double")
    assert A.nearest_rank(df, ["g"], "v", {"p": 0.25}).first().p == float(range(1, 12)[round(10 * 0.25)])


def test_estimator(spark):
    pop = spark.createDataFrame([("a", 100), ("b", 100), ("c", 800)], "stratum string, n_population long")
    rows = [("a", "BURNED")] * 8 + [("a", "NOT_BURNED")] * 2 + [("b", "BURNED")] * 5 + [("b", "NOT_BURNED")] * 5 + [("c", "BURNED")] + [("c", "NOT_BURNED")] * 9
    r = A.stratified_estimate(spark.createDataFrame(rows, "stratum string, label string"), pop, "stratum", "label", "BURNED", "NOT_BURNED", ["a", "b"]).first()
    assert r.share == pytest.approx(0.21) and r.precision == pytest.approx(0.65) and r.recall == pytest.approx(130 / 210)


def test_score_metrics(spark):
    rows = [(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.05)]
    r = A.score_metrics(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()
    pairs = [(1.0 if a > b else 0.5 if a == b else 0.0) for y, a in rows for z, b in rows if y == 1 and z == 0]
    assert r.auc == pytest.approx(sum(pairs) / len(pairs)) and r.brier == pytest.approx(sum((s - y) ** 2 for y, s in rows) / 5)
    assert r.average_precision == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 5) / 3)


@pytest.mark.parametrize("row,expected", [((0.8, 0.0, 0.0, 0.0, 0.0), "STANDING"), ((0.3, -0.3, -0.5, 0.0, 0.0), "HARVESTED"), ((0.2, -0.3, -0.5, -0.2, 0.2), "BURNT"), ((0.4, 0.2, -0.1, 0.0, 0.0), "SOWN"), ((None, 0.2, 0.0, 0.0, 0.0), None)])
def test_status(spark, row, expected):
    assert one(spark, rules.status_candidate(*[F.lit(x).cast("double") for x in row], F.lit(None).cast("boolean")).alias("s")).s.status == expected


def test_straw(spark):
    r = one(spark, rules.straw_estimate(F.lit("HARVESTED"), F.lit("MODERATE"), F.lit(2.0), F.lit(0.70)).alias("s")).s
    assert (r.baseline_t, r.factor, r.estimate_t) == (12.0, pytest.approx(0.9875), pytest.approx(11.85))


def test_risk_renormalises(spark):
    r = one(spark, rules.risk_score({"time_pressure": F.lit(1.0), "dry_weather": F.lit(0.5), "low_humidity": F.lit(None).cast("double")}).alias("s")).s
    assert r.score == pytest.approx((0.25 + 0.1) / 0.45) and r.level == "CRITICAL" and r.top == ["time_pressure", "dry_weather"]
    assert one(spark, rules.risk_score({"time_pressure": F.lit(None).cast("double")}).alias("s")).s.level == "INSUFFICIENT_DATA"


@pytest.mark.parametrize("obs,expected", [(("GOOD", -0.3, 0.2, -0.3, False), "STRONG"), (("GOOD", -0.16, 0.11, 0.0, False), "MODERATE"), (("GOOD", 0.0, 0.0, 0.0, False), "NO_BURN"), (("GOOD", 0.0, 0.0, 0.0, True), "UNCLEAR"), (("POOR", -0.3, 0.2, -0.3, False), "UNCLEAR"), (("GOOD", None, None, None, False), "UNCLEAR")])
def test_evidence(spark, obs, expected):
    q, n, b, v, f = obs
    assert one(spark, rules.burn_evidence(F.lit(q), F.lit(n).cast("double"), F.lit(b).cast("double"), F.lit(v).cast("double"), F.lit(f)).alias("e")).e == expected


def test_replay(spark):
    schema = "zone int, key string, area double, ready double, burned boolean, burn_day double, last_clear double, score double, dynamic array<struct<day: int, score: double>>"
    rows = [(0, "a", 3.0, 0.0, True, 5.0, 4.0, 0.9, None), (0, "b", 3.0, 0.0, True, 1.0, 0.0, 0.1, None), (0, "c", 1.0, 2.0, False, None, None, 0.5, None)]
    f = spark.createDataFrame(rows, schema)
    got = {r.key: (r.served_day, r.preempted) for r in simulate.replay(f, [], "risk", per_day=4.0).collect()}
    assert got == {"a": (0, True), "b": (None, False), "c": (2, False)}
    s = simulate.replay_summary(f, simulate.replay(f, [], "risk", per_day=4.0)).first()
    assert (s.burned, s.preempted, s.preempted_share) == (2, 1, 0.5)
    assert {r.key for r in simulate.replay(f, [0, 1, 2, 3, 4], "fifo", per_day=4.0).collect() if r.served_day is not None} == {"c"}


def plain_season(rows, rain, rank, per_day, window):
    """Every day looked at afresh: who is open, in order of rank, until the first that does not fit."""
    served = {}
    for day in range(60):
        open_ = [r for r in rows if r["key"] not in served and r["ready"] <= day <= r["ready"] + window and not (r["burned"] and r["burn_day"] <= day)]
        spent = 0.0
        for k, r in enumerate(sorted(open_, key=lambda r: (-rank(r, day), r["key"])) if day not in rain else []):
            if k and spent + r["area"] > per_day:
                break
            served[r["key"]], spent = day, spent + r["area"]
    return served


@pytest.mark.parametrize(("policy", "rank"), [
    ("fifo", lambda r, d: d - r["ready"]), ("largest_first", lambda r, d: r["area"]), ("risk", lambda r, d: r["score"] + 1e-4 * (d - r["ready"])),
    ("risk_urgency", lambda r, d: r["score"] * (1 + (d - r["ready"]) / 10)), ("oracle", lambda r, d: 1000 - (r["last_clear"] - d) if r["burned"] else 1e-3 * (d - r["ready"])),
    ("dynamic", lambda r, d: next((p["score"] for p in reversed(r["dynamic"]) if p["day"] <= d), r["score"] * 1e-3) + 1e-4 * (d - r["ready"])),
])
def test_replay_equals_a_plain_season(spark, policy, rank):
    rnd = random.Random(policy)
    rows = [{"zone": k % 3, "key": k, "area": rnd.choice([0.5, 1.0, 2.0, 5.0]), "ready": float(rnd.randrange(12)), "burned": rnd.random() < 0.4, "burn_day": float(rnd.randrange(8, 30)), "last_clear": float(rnd.randrange(5, 28)), "score": rnd.randrange(100) / 100, "dynamic": [{"day": 3, "score": rnd.random()}, {"day": 7, "score": rnd.random()}]} for k in range(120)]
    df = spark.createDataFrame(rows, "zone int, key int, area double, ready double, burned boolean, burn_day double, last_clear double, score double, dynamic array<struct<day: int, score: double>>")
    got = {r.key: r.served_day for r in simulate.replay(df, [4, 9], policy, per_day=4.0, window=8).collect() if r.served_day is not None}
    want = {}
    for zone in range(3):
        want |= plain_season([r for r in rows if r["zone"] == zone], {4, 9}, rank, 4.0, 8)
    assert got == want and got


@pytest.mark.parametrize("policy", ["random", "fifo", "largest_first", "risk", "risk_urgency", "dynamic", "oracle"])
def test_replay_keeps_within_capacity(policy):
    rnd = random.Random(2)
    rows = pd.DataFrame([{"zone": 0, "key": i, "area": rnd.choice([1.0, 2.0, 3.0]), "ready": float(rnd.randrange(10)), "burned": i % 3 == 0, "burn_day": 12.0, "last_clear": 11.0, "score": rnd.random(), "dynamic": [{"day": 3, "score": 0.5}]} for i in range(40)])
    out = simulate.serve_zone(rows, {4}, policy, 4.0, 20, 0)
    served = out.dropna(subset=["served"])
    assert (served.served >= served.ready).all() and 4 not in set(served.served) and (served.groupby("served").area.sum() <= 4.0).all()


def test_the_informed_policy_on_any_count_of_days_and_fields_without_area():
    """What burns first goes first, whatever day is called 0; a field of no area is the first of its day like any other."""
    def season(start):
        rows = pd.DataFrame([{"zone": 0, "key": k, "area": 4.0, "ready": start, "burned": b, "burn_day": start + 9, "last_clear": c, "score": 0.0, "dynamic": None} for k, (b, c) in enumerate([(False, math.nan), (True, math.nan), (True, start + 6), (True, start + 3)])])
        return [x - start for x in simulate.serve_zone(rows, set(), "oracle", 4.0, 20, 0)["served"]]

    assert season(1.0) == season(20_001.0) == [3.0, 2.0, 1.0, 0.0]
    rows = pd.DataFrame([{"zone": 0, "key": k, "area": a, "ready": 0.0, "burned": False, "burn_day": math.nan, "last_clear": math.nan, "score": 1.0 - k / 10, "dynamic": None} for k, a in enumerate([0.0, 9.0, 4.0, 0.0])])
    assert list(simulate.serve_zone(rows, set(), "risk", 4.0, 20, 0)["served"]) == [0.0, 1.0, 2.0, 2.0]


def test_buyers(spark):
    f = spark.createDataFrame([("f1", 30.0, 75.0, "Straw", 10.0, 0.9, 8.0), ("f2", 30.0, 75.1, "straw", 10.0, 0.5, 5.0), ("f3", None, 75.0, "straw", 10.0, 0.4, 1.0), ("f4", 30.0, 75.0, "husk", 10.0, 0.3, 1.0)], "field_id string, field_lat double, field_lon double, residue string, moisture double, score double, tonnes double")
    b = spark.createDataFrame([("b1", 30.0, 75.0, "AVAILABLE", ["STRAW"], 15.0, "06:00", "20:00", 10.0, 10.0), ("b2", 30.0, 75.0, "PAUSED", ["STRAW"], 15.0, "06:00", "20:00", 10.0, 10.0)], "buyer_id string, buyer_lat double, buyer_lon double, buyer_status string, accepted array<string>, max_moisture double, opens string, closes string, demand double, room double")
    f, b = f.withColumn("market", F.lit("north")), b.withColumn("market", F.lit("north"))
    away = f.where("field_id = 'f2'").withColumns({"field_id": F.lit("f5"), "market": F.lit("south")})
    nowhere = away.withColumns({"field_id": F.lit("f6"), "market": F.lit(None).cast("string")})
    got = {r.field_id: (r.buyer_id, r.reason) for r in simulate.match_buyers(f.unionByName(away).unionByName(nowhere), b, ["market"]).collect()}
    assert got == {"f1": ("b1", None), "f2": (None, "NO_BUYER_CAPACITY"), "f3": (None, "INVALID_LOCATION"), "f4": (None, "NO_COMPATIBLE_BUYER"), "f5": (None, "NO_COMPATIBLE_BUYER"), "f6": (None, "NO_COMPATIBLE_BUYER")}


def test_tours(spark):
    f = pd.DataFrame([("a", 0.9, 1.0, 30.0, 75.0, 5.0), ("b", 0.5, 1.0, 30.1, 75.0, 5.0), ("c", 0.1, 1.0, 30.0, 75.0, 50.0)], columns=["field_id", "score", "tonnes", "lat", "lon", "acres"])
    u = pd.DataFrame([("u1", 30.0, 75.0, 8.0, None, 480, 3.0), ("u2", 30.0, 75.2, 8.0, None, 480, 3.0)], columns=["unit_id", "lat", "lon", "max_acres", "max_straw", "shift_minutes", "acres_per_hour"])
    out = simulate.route_depot(f, u, 300.0).set_index("field_id")
    assert out.unit_id["a"] == "u1" and out.unit_id["b"] == "u2" and out.unit_id["c"] is None
    why = simulate.drop_reasons(spark.createDataFrame([("c", 0, 30.0, 75.0, 50.0, 1.0)], "field_id string, depot int, lat double, lon double, acres double, tonnes double"), spark.createDataFrame(u.assign(depot=0, max_straw=9.0)), "depot")
    assert why.first().reason == "CAPACITY_EXCEEDED"


def test_tours_look_at_all_units_at_once(monkeypatch):
    """Only the units that may be the best are measured one by one."""
    calls, plain = [], simulate._km
    monkeypatch.setattr(simulate, "_km", lambda a, b: calls.append(1) or plain(a, b))
    rnd = random.Random(3)
    f = pd.DataFrame([(k, rnd.random(), 1.0, 30 + rnd.random(), 75 + rnd.random(), 1.0 + k % 9) for k in range(200)], columns=["field_id", "score", "tonnes", "lat", "lon", "acres"])
    u = pd.DataFrame([(k, 30.0, 75.0 + k % 2, 20.0, None, 480, 3.0) for k in range(100)], columns=["unit_id", "lat", "lon", "max_acres", "max_straw", "shift_minutes", "acres_per_hour"])
    out = simulate.route_depot(f, u, 300.0)
    assert out.unit_id.notna().sum() > 150 and len(calls) < len(f) * len(u) / 10


def _operators(df):
    return [line.strip(" :+-") for line in df._jdf.queryExecution().optimizedPlan().toString().splitlines()]


def test_matching_and_reasons_make_no_pairs(spark):
    """Neither buyers nor units are joined row by row."""
    f = spark.createDataFrame([("a", 1, 30.0, 75.0, "straw", 9.0, 0.5, 1.0, 2.0)], "field_id string, market int, field_lat double, field_lon double, residue string, moisture double, score double, tonnes double, acres double")
    b = spark.createDataFrame([(k, 1, 30.0, 75.0, "AVAILABLE", ["STRAW"], 15.0, 9.0, 9.0) for k in range(3)], "buyer_id int, market int, buyer_lat double, buyer_lon double, buyer_status string, accepted array<string>, max_moisture double, demand double, room double")
    out = simulate.match_buyers(f, b, ["market"])
    assert [(r.field_id, r.buyer_id, r.reason) for r in out.collect()] == [("a", 2, None)] and not any(line.startswith("Join") for line in _operators(out))
    u = b.select("market", F.col("buyer_lat").alias("lat"), F.col("buyer_lon").alias("lon"), F.lit(1.0).alias("max_acres"), F.lit(None).cast("double").alias("max_straw"), F.lit(480).alias("shift_minutes"), F.lit(3.0).alias("acres_per_hour"))
    why = simulate.drop_reasons(f.withColumnsRenamed({"field_lat": "lat", "field_lon": "lon"}), u, "market")
    plan = _operators(why)
    assert why.first().reason == "CAPACITY_EXCEEDED" and not any(line.startswith("Aggregate [field_id") for line in plan)


def test_documents_are_put_together_once_a_nation(spark):
    from terracadence.plans import queries_joins

    plan = _operators(queries_joins.nested_history_doc(spark, "/root/testdata/sf0.001"))
    assert plan.index(next(x for x in plan if x.startswith("Join"))) < plan.index(next(x for x in plan if x.startswith("Aggregate")))


def test_upright_rectangles_are_not_clipped(spark):
    """Rectangles meet as boxes; other polygons are still cut exactly, also against rectangles."""
    from terracadence.functions import clip

    shape = lambda *ps: [{"x": float(x), "y": float(y)} for x, y in ps]
    rows = [(1, shape((0, 0), (10, 0), (10, 10), (0, 10))), (2, shape((5, 5), (5, 15), (15, 15), (15, 5))), (3, shape((0, 0), (10, 10), (0, 10))), (4, shape((8, 8), (20, 8), (20, 20)))]
    plain = clip._overlap
    out = features.overlapping(spark.createDataFrame(rows, "field_id int, xy array<struct<x:double,y:double>>"))
    got = {(r.field_id, r.other_id): round(r.overlap_m2, 6) for r in out.collect()}
    brute = {(i, j): plain(*(np.array([(p["x"], p["y"]) for p in ring]) for ring in (a, b))) for i, a in rows for j, b in rows if i < j}
    assert got == {k: round(v, 6) for k, v in brute.items() if v > 1.0} and got[1, 2] == 25.0
    square = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    turned = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((1.0, 0.0), (2.0, 1.0), (1.0, 2.0), (0.0, 1.0))])
    there_and_back = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (1.0, 0.0))])
    assert one(spark, *[G.upright(r).alias(n) for r, n in ((square, "a"), (turned, "b"), (there_and_back, "c"))]) == (True, False, False)


def test_splits_and_samples(spark):
    df = spark.createDataFrame([(g, "xy"[g % 2]) for g in range(40) for _ in range(3)], "g int, label string")
    split = audit.grouped_split(df, "g", "label")
    parts = {s: split.where(F.col("split") == s) for s in ("train", "validation", "test")}
    assert [parts[s].count() for s in ("train", "validation", "test")] == [24, 8, 8] and audit.disjoint(parts["train"], parts["test"], ["g"])
    assert sampling.stratified_sample(df.distinct(), "label", "g", 5).count() == 10
    assert sampling.spread_sample(df.distinct().withColumn("a", F.col("g") * 1.0), ["label"], "a", "g", 20, 8).count() == 8


def test_audits(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 2.0), (2, None)], "id int, v double")
    r = audit.dataset_audit(df, ["id"], ["v"], {"v": (0, 1)}).first()
    assert (r.n_rows, r.missing_v, r.range_v, r.repeated_keys) == (3, 1, 1, 2)
    assert audit.schema_problems(df, [("id", "int"), ("w", "int")]) == ["missing w", "unexpected v"]
    files = spark.createDataFrame([("a", bytearray(b"x\r\n")), ("b", bytearray(b"version https://git-lfs.github.com/spec/v1"))], "path string, content binary")
    import hashlib

    manifest = spark.createDataFrame([("a", hashlib.sha256(b"x\n").hexdigest()), ("b", "0"), ("c", "0")], "path string, sha256 string")
    assert {x.path: x.status for x in audit.artifact_status(files, manifest).collect()} == {"a": "MATCH_AFTER_LINE_ENDINGS", "b": "POINTER", "c": "MISSING"}


def test_readers(spark, tmp_path):
    (tmp_path / "x.geojson").write_text('{"type": "FeatureCollection", "features": [{"type": "Feature", "properties": {"field_id": "a"}, "geometry": {"type": "Polygon", "coordinates": [[[0, 0], [1, 0], [1, 1], [0, 0]]]}}]}')
    r = readers.geojson(spark, str(tmp_path / "x.geojson"), "field_id: string").first()
    assert r.field_id == "a" and len(r.rings[0]) == 4
    raw = spark.createDataFrame([("30", "75", "2024-11-27", "530", "n", "V"), ("30", "75", "2024-11-27", "0530", "n", "V"), ("95", "75", "2024-11-27", "0530", "n", "V"), ("x", "75", "2024-11-27", "0530", "n", "V"), ("30", "75", "2024-11-27", "2530", "n", "V")], "LATITUDE string, longitude string, acq_date string, acq_time string, confidence string, source string")
    good, bad = readers.fire_rows(raw)
    assert good.count() == 1 and sorted(x.reject_reason for x in bad.collect()) == ["COORDINATES_MISSING", "COORDINATES_OUT_OF_RANGE", "TIME_NOT_VALID"]
    assert readers.request_chunks(spark.createDataFrame([("2025-01-01", "2025-01-12"), ("2025-01-05", "2025-01-04")], "a string, b string"), "a", "b").count() == 3
    arrays = spark.createDataFrame([("n", [1, 2, 3], [4.0, None])], "k string, t array<int>, v array<double>")
    assert [tuple(x) for x in readers.parallel_arrays(arrays, ["k"], ["t", "v"]).collect()] == [("n", 1, 4.0), ("n", 2, None), ("n", 3, None)]
    assert readers.grid_nodes(spark.createDataFrame([(75.0, 30.0, 75.4, 30.2)], "west double, south double, east double, north double"), 0.25).count() == 6


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, float("nan"), 2024), (2, 1.0, 2025)], "id int, v double, year int")
    assert sinks.strict_json(df).orderBy("json").first().json == '{"id":1,"v":null,"year":2024}'
    sinks.by_season(df, str(tmp_path / "s"))
    sinks.by_season(df.where("year = 2025").withColumn("v", F.lit(9.0)), str(tmp_path / "s"))
    assert {(r.id, r.year) for r in spark.read.parquet(str(tmp_path / "s")).collect()} == {(1, 2024), (2, 2025)}
    assert sinks.upsert(df, df.where("id = 2").withColumn("v", F.lit(3.0)), ["id"]).where("id = 2").first().v == 3.0


def test_field_geometry(spark):
    d = 0.001
    box = lambda x, y: [(x, y), (x + d, y), (x + d, y + d), (x, y + d), (x, y)]
    bow = [(75.0, 30.0), (75.0 + d, 30.0 + d), (75.0 + d, 30.0), (75.0, 30.0 + 2 * d), (75.0, 30.0)]
    rows = [("a", box(75.0, 30.0)), ("b", box(75.0 + d / 2, 30.0)), ("c", box(75.0, 30.0)), ("d", bow), ("e", [(0.0, 95.0), (1.0, 95.0), (1.0, 96.0)])]
    good, bad = features.checked_fields(spark.createDataFrame(rows, "field_id string, ring array<struct<x: double, y: double>>"))
    issues = {r.field_id: set(r.issues) for r in bad.collect()}
    assert {r.field_id for r in good.collect()} == {"a", "b"} and issues["c"] == {"SHAPE_REPEATED"} and "CROSSES_ITSELF" in issues["d"] and "COORDINATES_OUT_OF_RANGE" in issues["e"]
    pair = features.overlapping(good).collect()
    assert len(pair) == 1 and pair[0].overlap_m2 == pytest.approx(good.first().area_ha * 5000, rel=1e-2)


def test_payloads(spark):
    df = spark.createDataFrame([("a", 0.9), ("b", 0.9), ("c", None)], "field_id string, score double")
    assert [r.field_id for r in payloads.watchlist(df, "score", "field_id", 2).collect()] == ["a", "b"]
    assert payloads.visible_to(df, spark.createDataFrame([("a",)], "field_id string"), "field_id").count() == 1


def test_indices_guard_their_domain(spark):
    df = spark.createDataFrame([(0.0, 0.2, 0.2, 0.2, 0.1), (0.1, 0.2, 0.2, 0.0, 0.0), (float("nan"), 0.2, 0.2, 0.2, 0.1), (None, 0.2, 0.2, 0.2, 0.1)], "a double, b double, c double, d double, e double")
    cols = [F.col(x) for x in "abcde"]
    assert [r[0] for r in df.select(S.bais2_strict(*cols)).collect()] == [None] * 4
    assert [r[0] for r in df.select(S.bais2_floored(*cols)).collect()][0] is None


def test_compatible_rows_without_pairs(spark):
    """Every pattern of unknown columns against all pairs, with repeated rows, ties and missing keys."""
    import itertools
    import random

    draw = random.Random(5)
    rows = [(draw.choice([1, 2, None]), draw.choice([*range(12), None]), n, draw.choice(["IW", None]), draw.choice(["A", "D", None]), draw.choice([7, 8, None])) for n in range(120)]
    rows += rows[:10]
    df = spark.createDataFrame(rows, "k int, t long, n int, mode string, orbit string, track int")
    out = joins.asof_compatible(df, ["k"], "t", "n", ["mode"], ["orbit", "track"], ["n"]).collect()
    want = []
    for a in rows:
        fits = lambda b: None not in (a[0], a[1], a[3], b[0], b[1], b[3]) and a[0] == b[0] and a[3] == b[3] and b[1] < a[1] and all(None in (x, y) or x == y for x, y in itertools.islice(zip(a, b), 4, None))  # noqa: B023, B905, E731
        best = max(((b[1], b[2]) for b in rows if fits(b)), default=(None, None))
        want.append((*a, *best))
    key = lambda r: tuple((v is not None, v) for v in r)
    assert sorted(map(tuple, out), key=key) == sorted(want, key=key)
    assert any(r[-1] is not None for r in want)


def test_intervals_meet_in_buckets(spark):
    """Intervals longer and shorter than a bucket, turned round, and without an end."""
    l = spark.createDataFrame([(1, 0.0, 0.0, -40, 95), (2, 1.0, 1.0, 5, 5), (3, 0.0, 0.0, 9, 3), (4, 0.0, 0.0, 0, None), (5, 50.0, 0.0, 0, 90)], "id int, x double, y double, a int, b int")
    r = spark.createDataFrame([(0.0, 0.0, t) for t in (-41, -40, 5, 30, 95, 96, None)], "ox double, oy double, t int")
    out = band.match_intervals(l, r, "id", 5.0, ("x", "y"), ("ox", "oy"), "a", "b", "t", 30.0)
    assert {r.id: r.n_matches for r in out.collect()} == {1: 4, 2: 1, 3: 0, 4: 0, 5: 0}


def test_intelligence_follows_its_model(spark):
    """Rules unless a validated model decides; risk only for a harvest that is well founded; synthetic models are refused."""
    names = "NDVI_mean NDVI_delta NDVI_drop_from_peak NBR_delta BAIS2_delta area_ha peak_NDVI days_since_harvest rain_72h forecast_rain forecast_issued observed humidity_pct baler_m buyer_m burn_rate".split()
    weak = dict.fromkeys(names, 1.0) | {"NDVI_delta": -0.3, "NDVI_drop_from_peak": -0.3, "NBR_delta": 0.0, "BAIS2_delta": 0.0}
    rows = [(n, *r.values(), False, False, "CONFIRMED", "HARVESTED") for n, r in (("weak", weak), ("firm", weak | {"NBR_delta": -0.2}), ("standing", weak | {"NDVI_delta": 0.0, "NDVI_drop_from_peak": 0.0}), ("unknown", dict.fromkeys(names)))]
    df = spark.createDataFrame(rows, "id string, " + ", ".join(f"{n} double" for n in names) + ", recent_fire_24h boolean, recent_fire_72h boolean, harvest_state string, own string")
    short = lambda out: {r.id: (r.status.status, r.straw.state, r.risk_state == "SCORED", r.risk is None, r.status_source) for r in out.collect()}
    by_rule = {"weak": ("HARVESTED", "NOT_ELIGIBLE", False, True, "rule"), "firm": ("HARVESTED", "PRELIMINARY_ESTIMATE", True, False, "rule"), "standing": ("STANDING", "NOT_ELIGIBLE", False, True, "rule"), "unknown": (None, "NOT_ELIGIBLE", False, True, "rule")}
    assert short(payloads.intelligence(df)) == by_rule == short(payloads.intelligence(df, "EXPERIMENTAL_MODEL", "own"))
    assert {v[0] for v in short(payloads.intelligence(df, "VALIDATED_MODEL", "own")).values()} == {"HARVESTED"}
    assert all(v[2:] == (True, False, "trained_model") for v in short(payloads.intelligence(df, "VALIDATED_MODEL", "own")).values())
    with pytest.raises(ValueError):
        payloads.intelligence(df, "SYNTHETIC_TEST_MODEL", "own")


def test_provider_requests(spark):
    """Spans before, across, after today and beyond the horizon, turned round and open."""
    day = dt.date
    spans = [(1, day(2024, 1, 1), day(2024, 1, 5)), (2, day(2024, 1, 8), day(2024, 1, 12)), (3, day(2024, 1, 10), day(2024, 2, 1)), (4, day(2024, 2, 1), day(2024, 2, 3)), (5, day(2024, 1, 9), day(2024, 1, 8)), (6, None, day(2024, 1, 8)), (7, day(2024, 1, 1), day(2024, 2, 1))]
    df = spark.createDataFrame(spans, "id int, a date, b date")
    out = readers.provider_requests(df, "a", "b", F.lit("2024-01-10").cast("date"))
    assert sorted((r.id, r.provider, r.from_day, r.to_day, r.days_missing) for r in out.collect()) == [
        (1, "archive", day(2024, 1, 1), day(2024, 1, 5), 0), (2, "archive", day(2024, 1, 8), day(2024, 1, 9), 0), (2, "forecast", day(2024, 1, 10), day(2024, 1, 12), 0),
        (3, "forecast", day(2024, 1, 10), day(2024, 1, 25), 7), (4, "none", None, None, 3), (7, "archive", day(2024, 1, 1), day(2024, 1, 9), 0), (7, "forecast", day(2024, 1, 10), day(2024, 1, 25), 7),
    ]


def test_one_district(spark):
    areas = spark.createDataFrame([(" North ", 2000.0), ("north", 10.0), ("south", 1500.0), ("tiny", 5.0)], "name string, km2 double")
    assert readers.one_district(areas, "name", ("SOUTH",), "km2").count() == 1
    for bad in ("north", "tiny", "east"):
        with pytest.raises(ValueError):
            readers.one_district(areas, "name", (bad,), "km2")
