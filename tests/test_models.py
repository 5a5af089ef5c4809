"""Models against plain fits, and the promises they make."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terracadence.operators import boosting, learn

FEATURES = ["a", "b", "noise"]


def table(n=600, seed=0):
    rnd = np.random.default_rng(seed)
    rows = []
    for k in range(n):
        a, b, z = rnd.uniform(0, 10), rnd.uniform(0, 10), rnd.uniform(0, 10)
        y = int(rnd.uniform() < 1 / (1 + math.exp(-(0.5 * a - 0.4 * b + (2 if z > 9.5 else 0) - 1 + math.sin(3 * a)))))
        rows.append((k, a if k % 9 else None, b if k % 13 else float("nan") if k % 2 else None, z, y if k % 50 else None, 1.0 + k % 3))
    return rows


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(table(), "id long, a double, b double, noise double, y int, w double").repartition(5)


EDGES = [[1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0, 9.0], [2.0, 4.0, 6.0, 8.0], [9.5]]


def bin_of(x, edges):
    return 0 if x is None else 1 + sum(x > e for e in edges)  # NaN is above no edge here; the table holds it as Spark does, above all


def plain_fit(rows, edges, monotone, rounds, depth, rate, l2, least, weighted):
    """One row at a time, one candidate at a time."""
    data = [(tuple(1 + len(e) if x is not None and math.isnan(x) else bin_of(x, e) for x, e in zip(r[1:4], edges, strict=True)), r[4], r[5] if weighted else 1.0) for r in rows]
    fit = [d for d in data if d[1] is not None]
    unit = lambda x: math.floor(x * boosting.UNIT + 0.5)
    pos, all_ = sum(unit(y * w) for _, y, w in fit), sum(unit(w) for _, _, w in fit)
    raw = [math.log(pos / (all_ - pos))] * len(data)
    for _ in range(rounds):
        leaves = [(list(range(len(data))), 0.0, -math.inf, math.inf, True)]
        for _ in range(depth):
            grown = []
            for members, value, low, high, open_ in leaves:
                grads = {}
                for i in members:
                    bins, y, w = data[i]
                    if y is not None:
                        p = 1 / (1 + math.exp(-raw[i]))
                        grads[i] = (unit((p - y) * w), unit(p * (1 - p) * w))
                clip = lambda x: min(max(x, low), high)  # noqa: E731, B023
                total = lambda ids: (sum(grads[i][0] for i in ids) / boosting.UNIT, sum(grads[i][1] for i in ids) / boosting.UNIT)  # noqa: E731, B023
                worth = lambda g, h, w: g * w + 0.5 * (h + l2) * w * w
                best = None
                g, h = total(grads)
                for f in range(3) if open_ else ():
                    for t in sorted({data[i][0][f] for i in grads} - {0}):
                        for missing in (True, False):
                            side = lambda i: data[i][0][f] <= t if missing or data[i][0][f] else False  # noqa: E731, B023
                            a, b = [i for i in grads if side(i)], [i for i in grads if not side(i)]
                            if len(a) < least or len(b) < least:
                                continue
                            (ga, ha), (gb, hb) = total(a), total(b)
                            wa, wb = clip(-ga / (ha + l2)), clip(-gb / (hb + l2))
                            gain = worth(g, h, clip(-g / (h + l2))) - worth(ga, ha, wa) - worth(gb, hb, wb)
                            if monotone[f] * (wb - wa) >= 0 and gain > boosting.LEAST_GAIN and (best is None or gain > best[0]):
                                best = gain, [i for i in members if side(i)], [i for i in members if not side(i)], wa, wb, monotone[f]
                if best is None:
                    grown.append((members, value, low, high, False))
                    continue
                _, a, b, wa, wb, s = best
                mid = (wa + wb) / 2
                grown += [(a, wa, mid if s < 0 else low, mid if s > 0 else high, True), (b, wb, mid if s > 0 else low, mid if s < 0 else high, True)]
            leaves = grown
        for members, value, *_ in leaves:
            for i in members:
                raw[i] += rate * value
    return raw


@pytest.mark.parametrize("monotone, weight, rounds, depth", [({}, None, 2, 3), ({"a": 1, "b": -1}, "w", 4, 3), ({"a": -1}, None, 10, 2)])
def test_boosting_equals_plain_fit(spark, rows, monotone, weight, rounds, depth):
    model = boosting.fit(rows, FEATURES, "y", EDGES, monotone, rounds=rounds, depth=depth, rate=0.3, least_rows=10, weight=weight)
    got = {r.id: r.raw for r in rows.select("id", model.raw(model.bins()).alias("raw")).collect()}
    want = plain_fit(table(), EDGES, [monotone.get(f, 0) for f in FEATURES], rounds, depth, 0.3, 1.0, 10, weight is not None)
    assert max(abs(got[k] - w) for k, w in enumerate(want)) < 1e-9


def test_scores_are_monotone_on_a_grid(spark, rows):
    edges = boosting.quantile_edges(rows, FEATURES, 16)
    assert all(len(e) <= 16 for e in edges)
    grid = spark.range(20).select((F.col("id") / 2).alias("a")).crossJoin(spark.range(20).select((F.col("id") / 2).alias("b"))).withColumn("noise", F.lit(3.0))
    free = boosting.fit(rows, FEATURES, "y", edges, rounds=12, rate=0.3, least_rows=5)
    bound = boosting.fit(rows, FEATURES, "y", edges, {"a": 1, "b": -1}, rounds=12, rate=0.3, least_rows=5)

    def breaks(model):
        at = {(r.a, r.b): r.score for r in model.predict(grid).collect()}
        return sum(at[a, b] > at[a + 0.5, b] + 1e-12 for a, b in at if a < 9.5) + sum(at[a, b] < at[a, b + 0.5] - 1e-12 for a, b in at if b < 9.5)

    assert breaks(free) > 0 and breaks(bound) == 0


def test_limits_of_trees(spark, rows):
    model = boosting.fit(rows, FEATURES, "y", EDGES, rounds=2, depth=5, least_rows=10, most_leaves=4)
    assert all(sum(n.feature is None for n in t.values()) <= 4 for t in model.trees)
    none = boosting.fit(rows.limit(0), FEATURES, "y", EDGES)
    assert none.trees == [] and {r.score for r in none.predict(rows).collect()} == {0.5}
    one = boosting.fit(rows.withColumn("y", F.lit(1)), FEATURES, "y", EDGES)
    assert {r.score for r in one.predict(rows).collect()} == {1.0}
    clash = rows.withColumn("_x", F.lit(1)).withColumn("score", F.lit("x"))
    assert boosting.fit(clash, FEATURES, "y", EDGES, rounds=1).predict(clash, "p").count() == 600


def test_logistic_equals_newton(spark, rows):
    full = rows.where("a is not null and b is not null and not isnan(b)")
    model = learn.logistic(full, ["a", "b"], "y")
    data = [r for r in table() if r[1] is not None and r[2] is not None and not math.isnan(r[2]) and r[4] is not None]
    x, y = np.array([r[1:3] for r in data]), np.array([r[4] for r in data])
    x = np.column_stack([np.ones(len(x)), (x - x.mean(0)) / x.std(0)])
    w = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        w += np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + np.diag([0, 1, 1]), x.T @ (y - p) - np.array([0, 1, 1]) * w)
    assert np.abs(np.array(model.weights) - w).max() < 1e-8
    flat = learn.logistic(full.withColumn("one", F.lit(5.0)), ["a", "one"], "y")
    assert abs(flat.weights[2]) < 1e-8 and learn.logistic(full.limit(0), ["a"], "y").weights == [0.0, 0.0]


def test_classes_weigh_the_same_and_the_gate_holds(spark, rows):
    named = rows.withColumn("status", F.when(F.col("y").isNull(), None).when(F.col("y") == 1, "SOWN").otherwise("BURNT"))
    train = learn.class_weights(named, "status", "cw")
    sums = {r.status: r.s for r in train.groupBy("status").agg(F.sum("cw").alias("s")).collect()}
    assert sums["SOWN"] == pytest.approx(sums["BURNT"]) and None not in sums
    models = learn.one_against_rest(train, FEATURES, "status", ["SOWN", "BURNT"], EDGES, "cw", rounds=5, rate=0.3)
    out = learn.most_likely(named, models)
    assert out.where("status = predicted").count() > 0.7 * out.where("status is not null").count()
    mark = learn.fingerprint("v1", FEATURES)
    assert not learn.infer(out, "EXPERIMENTAL_MODEL", mark, "v1", FEATURES).first().may_decide and learn.infer(out, "VALIDATED_MODEL", mark, "v1", FEATURES).first().may_decide
    with pytest.raises(ValueError):
        learn.infer(out, "VALIDATED_MODEL", mark, "v2", FEATURES)
    forest = learn.forest(FEATURES, "status", "cw", trees=5).fit(train.where("not isnan(b) or b is null"))
    assert forest.transform(train.where("not isnan(b) or b is null")).count() > 0


def test_latest_rows_of_repeated_numbers_are_the_files_first(spark, tmp_path):
    """Lines that repeat a number: the first in the file stays, as in the SQL on one thread, and scores are rounded as there."""
    import duckdb

    from terracadence.plans import queries_records as Q

    duck = duckdb.connect()
    duck.execute("set threads = 1")
    (tmp_path / "lineitem.parquet").mkdir()
    for name, low, high in (("a", 0, 5_000), ("b", 5_000, 60_000)):  # Spark takes large files first
        duck.execute(f"copy (select i * 7919 % 3000 as l_orderkey, i * 31 % 20000 as l_partkey, i * 17 % 1000 as l_suppkey, (1 + i % 3)::integer as l_linenumber from range({low}, {high}) t(i)) to '{tmp_path}/lineitem.parquet/{name}.parquet'")
    duck.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet/*.parquet'")
    Q.field_intelligence(spark, str(tmp_path)).write.parquet(f"{tmp_path}/out")
    cols = ", ".join(f'"{r[0]}"' for r in duck.execute(f"describe {Q.SQL['field_intelligence']}").fetchall())
    a, b = f"select {cols} from '{tmp_path}/out/*.parquet'", f"select {cols} from ({Q.SQL['field_intelligence']})"
    assert duck.execute(f"{a} except all {b}").fetchall() == [] and duck.execute(f"{b} except all {a}").fetchall() == []


def test_rounded_as_engines_do(spark):
    from terracadence.functions.numbers import rounded

    r = spark.createDataFrame([(0.51557031249999995,), (0.5,), (None,)], "x double").select(rounded(F.col("x"), 9).alias("r")).collect()
    assert [x.r for x in r] == [round(0.51557031249999995 * 1e9) / 1e9, 0.5, None]
