"""Registered compositions: event detection, panels, replay, matching. Those that SQL can express have it."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..operators import aggregates as A
from ..operators import simulate
from . import events as E
from . import panels as P
from .tables import OBS, observations, points, read

QUERIES, SQL = {}, {}
c = F.col


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def field_dates(spark, sf):
    """Line items as a dense series: a part is a field, ship dates its acquisitions, whole ratios its bands."""
    # lines are moved once, by their field, before the bands make them wide
    li = read(spark, sf, "lineitem").select(c("l_partkey").alias("field_id"), F.to_date("l_shipdate").alias("date"), c("l_orderkey").alias("o"), c("l_linenumber").alias("n"), c("l_suppkey").alias("s")).repartition("field_id")
    from ..operators.windows import keep_one

    band = lambda k, m: F.pmod(c("o") * k + c("n") * m, F.lit(41)).cast("double") / 128
    return keep_one(li, ["field_id", "date"], [c("o"), c("n")])[0].select(
        "field_id", "date", (band(3, 1) / 2).alias("B02"), (band(5, 2) / 2).alias("B04"), band(7, 3).alias("B06"), band(11, 5).alias("B07"), band(13, 7).alias("B08"), band(17, 11).alias("B8A"), band(19, 13).alias("B11"), (band(23, 17) / 2).alias("B12"),
        (F.pmod(c("o"), F.lit(10)) / 10).alias("char_frac"), F.lit(40).alias("n_valid"), F.pmod(c("s"), F.lit(40)).alias("n_cloud"),
    )


ROWS = """r as (select l_partkey as field_id, cast(l_shipdate as date) as date, row_number() over (partition by l_partkey, cast(l_shipdate as date) order by l_orderkey, l_linenumber) as k,
    ((l_orderkey * 3 + l_linenumber) % 41)::double / 128 / 2 as b02, ((l_orderkey * 5 + l_linenumber * 2) % 41)::double / 128 / 2 as b04, ((l_orderkey * 13 + l_linenumber * 7) % 41)::double / 128 as b08, ((l_orderkey * 17 + l_linenumber * 11) % 41)::double / 128 as b8a,
    ((l_orderkey * 23 + l_linenumber * 17) % 41)::double / 128 / 2 as b12, (l_orderkey % 10) / 10 as ch, 40 / greatest(40 + l_suppkey % 40, 1) as vf from lineitem),
    i as (select *, (b08 - b04) / nullif(b08 + b04, 0) as ndvi, (b8a - b12) / nullif(b8a + b12, 0) as nbr, case when vf < 0.6 then 'CLOUD' when b02 >= 0.2 then 'SMOKE' when b02 >= 0.1 then 'HAZE' else 'CLEAR' end as hz from r where k = 1),
    u as (select *, lag(date) over w as pd, lag(nbr) over w as pn, lag(b8a) over w as p8, lag(b12) over w as p12, lag(hz) over w as ph, lead(nbr) over w as nn, max(nbr) over (w rows between unbounded preceding and current row) as cm
        from i where hz in ('HAZE', 'CLEAR') and nbr is not null window w as (partition by field_id order by date)),
    h as (select field_id, min(case when cm >= 0.5 and nbr < 0.3 then date end) as hd from u group by field_id),
    f as (select u.*, hd, coalesce(date >= hd, false) and (coalesce(b8a < 0.15 and b12 < 0.17 and nbr < 0.03 and p8 - b8a > 0.06 and p12 - b12 > 0.03 and pn - nbr > 0.08, false) or coalesce(ch >= 0.25, false)) as lo from u join h using (field_id)),
    s as (select *, lo and (coalesce(b8a < 0.12 and b12 < 0.14 and nbr < 0 and p8 - b8a > 0.06 and p12 - b12 > 0.03 and pn - nbr > 0.08 and pn - nbr >= 0.1, false) or coalesce(ch >= 0.4 and pn - nbr >= 0.1 and p8 - b8a > 0.06, false)) and coalesce(ph = 'CLEAR', false) and coalesce(nn <= pn - 0.05, false) as st from f),
    g as (select field_id, count(*) as n_usable, count(*) filter (hz = 'CLEAR') as n_clear, max(nbr) as peak_nbr, max(case when hz = 'CLEAR' then ndvi end) as peak_ndvi, any_value(hd) as harvest_date, min(case when st then date end) as sd, min(case when lo then date end) as ld from s group by field_id)"""


@query(f"""with {ROWS} select field_id, n_usable, n_clear, peak_nbr, peak_ndvi, harvest_date, coalesce(sd, ld) as burn_date, case when sd is not null then 'STRICT_BURN_CANDIDATE' when ld is not null then 'LOOSE_BURN_CANDIDATE' end as burn_tier, date_diff('day', harvest_date, coalesce(sd, ld))::integer as harvest_to_burn_days from g""")
def event_detection(spark, sf):
    """B-04, B-05, A-09 to A-11, F-07 to F-09, J-07, T-01."""
    out = E.detect(E.annotate(field_dates(spark, sf)))
    return out.select("field_id", "n_usable", "n_clear", "peak_nbr", "peak_ndvi", "harvest_date", "burn_date", "burn_tier", "harvest_to_burn_days")


@query(None)
def event_table(spark, sf):
    """B-06, J-18, F-31, P-05, P-10."""
    noted = E.annotate(field_dates(spark, sf))
    ids = points(spark, sf, "part", "p_partkey").select(c("id").alias("field_id"), (c("x") * 10).alias("x"), (c("y") * 10).alias("y"), F.lit(1.0).alias("area"))
    fires = points(spark, sf, "orders", "o_orderkey").join(read(spark, sf, "orders").select(c("o_orderkey").alias("id"), F.to_date("o_orderdate").alias("fire_date"), "o_orderstatus"), "id")
    fires = fires.select((c("x") * 10).alias("fx"), (c("y") * 10).alias("fy"), "fire_date", F.when(c("o_orderstatus") == "F", "MODIS").otherwise("S-NPP").alias("sensor"))
    return E.event_table(noted, E.detect(noted), ids, fires, ("1996-01-01", "2000-12-31"))


def season_fields(spark, sf, year: int):
    """Customers as fields of a season, orders as what happens to them."""
    o = read(spark, sf, "orders").where(F.year("o_orderdate") == year).groupBy(c("o_custkey").alias("id")).agg(F.min(F.to_date("o_orderdate")).alias("harvest_date"), F.max(F.to_date("o_orderdate")).alias("last"), F.count(F.lit(1)).alias("n"))
    rows = points(spark, sf, "customer", "c_custkey").join(o, "id")
    burned = c("n") >= 2
    return rows.select(
        c("id").alias("field_id"), (c("x") * 10).alias("x"), (c("y") * 10).alias("y"), F.floor(c("x") * 10 / 500).cast("long").alias("ix"), F.floor(c("y") * 10 / 500).cast("long").alias("iy"), "harvest_date",
        F.when(burned, c("last")).alias("burn_date"), F.when(burned, F.date_sub("last", 1)).alias("burn_prev_date"), burned.alias("burned"), (F.lit(0.5) + c("id") % 5 / 10).alias("peak_ndvi"), (c("id") % 40 / 10).alias("pixel_area_ha"),
    )


def _season_sql(year: int, name: str) -> str:
    return f"""{name} as (select c_custkey as field_id, floor((c_custkey * 7919 % 1000)::double * 10 / 500)::bigint as ix, floor((c_custkey * 104729 % 997)::double * 10 / 500)::bigint as iy, min(cast(o_orderdate as date)) as hd, case when count(*) >= 2 then max(cast(o_orderdate as date)) end as bd, count(*) >= 2 as burned, 0.5 + c_custkey % 5 / 10 as ndvi
        from customer join orders on o_custkey = c_custkey where year(o_orderdate) = {year} group by c_custkey)"""


@query(f"""with {_season_sql(1997, 'n')}, {_season_sql(1996, 'p')}, q as (select * from n where ndvi >= 0.6), k as (select * from p where ndvi >= 0.6), cells as (select distinct ix, iy from k),
    rt as (select cells.ix, cells.iy, count(*) filter (k.burned) / greatest(count(*), 1) as rate from cells join k on abs(k.ix - cells.ix) <= 1 and abs(k.iy - cells.iy) <= 1 group by all)
    select q.field_id, coalesce((select p.burned::int from p where p.field_id = q.field_id), 0) as prior_burn, coalesce(rt.rate, 0) as nbhd_prior_rate,
    (select count(*) from q b where abs(b.ix - q.ix) <= 1 and abs(b.iy - q.iy) <= 1 and b.bd < q.hd) as nbhd_burned_before, (select count(*) from q b where abs(b.ix - q.ix) <= 1 and abs(b.iy - q.iy) <= 1 and b.hd < q.hd) as nbhd_harvested_before, dayofyear(q.hd)::integer as harvest_doy
    from q left join rt on rt.ix = q.ix and rt.iy = q.iy""")
def risk_panel(spark, sf):
    """B-07, J-24, A-16, A-17."""
    out = P.risk_features(season_fields(spark, sf, 1997), season_fields(spark, sf, 1996))
    return out.select("field_id", "prior_burn", "nbhd_prior_rate", "nbhd_burned_before", "nbhd_harvested_before", "harvest_doy")


def rain_and_passes(spark, sf, year: int):
    """Customers as passes every few days, suppliers as rain gauges."""
    day = lambda k: F.date_add(F.lit(f"{year}-01-01").cast("date"), k.cast("int"))
    passes = read(spark, sf, "customer").select(day(5 * (c("c_custkey") % 80)).alias("t")).distinct()
    return passes, read(spark, sf, "supplier").select(day(c("s_suppkey") % 300).alias("day"), (c("s_suppkey") % 7).cast("double").alias("mm"))


@query(f"""with {_season_sql(1997, 'n')}, t as (select distinct date '1997-01-01' + (5 * (c_custkey % 80))::integer as t from customer),
    r as (select day, sum(mm) / count(mm) as mm from (select date '1997-01-01' + (s_suppkey % 300)::integer as day, (s_suppkey % 7)::double as mm from supplier) group by day),
    x as (select n.*, t.t from n join t on hd <= t and t <= hd + 30 and not (burned and bd - 1 < t))
    select field_id, t, (t - hd)::integer as days_since_harvest, coalesce(burned and bd - 1 = t, false)::int as label,
    (select count(*) from n b where b.burned and abs(b.ix - x.ix) <= 1 and abs(b.iy - x.iy) <= 1 and b.bd <= x.t and b.bd > x.t - 10) as recent_burns_3, (select count(*) from n b where b.burned and abs(b.ix - x.ix) <= 4 and abs(b.iy - x.iy) <= 4 and b.bd <= x.t and b.bd > x.t - 10) as recent_burns_9,
    coalesce((select sum(mm) from r where day between x.t - 3 and x.t - 1), 0) as rain_before, coalesce((select sum(mm) from r where day between x.t and x.t + 4), 0) as rain_after from x""")
def hazard_panel(spark, sf):
    """B-08, A-15."""
    passes, rain = rain_and_passes(spark, sf, 1997)
    return P.hazard_panel(season_fields(spark, sf, 1997), passes, rain).select("field_id", "t", "days_since_harvest", "label", "recent_burns_3", "recent_burns_9", "rain_before", "rain_after")


@query(f"""with {_season_sql(1997, 'n')}, k as (select * from n where ndvi >= 0.6), d as (select dayofyear(hd)::integer as doy, count(*) as k from k group by 1) select 1997 as year, doy, sum(k) over (order by doy) / (select count(*) from k) as share, sum(k) over (order by doy range between 6 preceding and current row) / (select count(*) from k) as week_share from d""")
def harvest_curve(spark, sf):
    """B-10."""
    rows = season_fields(spark, sf, 1997).withColumns({"year": F.lit(1997), "harvested": F.lit(True)})
    return P.harvest_curve(rows)


def _replay_sql() -> str:
    """Day by day: of what waits, is not too old and has not burned, the first goes, and what follows while the day's area lasts."""
    waits = "x.ready <= day + 1 and day + 1 <= x.ready + 20 and not (x.burned and x.burn_day <= day + 1)"
    return f"""with recursive {_season_sql(1997, "s")}, r as (select ix % 7 as zone, field_id as key, field_id % 40 / 10 as area, (hd - date '1997-01-01')::double as ready, burned, (bd - date '1997-01-01')::double as burn_day, field_id * 7919 % 100 / 100 as score from s),
        g as (select zone, -1::bigint as day, max(ready) + 20 as last, list({{'key': key, 'area': area, 'ready': ready, 'burned': burned, 'burn_day': burn_day, 'score': score}}) as rest, []::bigint[] as served from r group by zone
            union all select zone, day + 1, last, list_filter(rest, lambda x: not list_contains(now, x.key)), now from (
                select zone, day, last, rest, list_transform(list_filter(q, lambda x, i: i = 1 or list_sum(list_transform(q[1:i], lambda y: y.area)) <= 4), lambda x: x.key) as now from (
                    select *, case when day + 1 in (40, 41, 42) then [] else list_sort(list_transform(list_filter(rest, lambda x: {waits}), lambda x: {{'rank': -(x.score + (day + 1 - x.ready) * 0.0001::double), 'key': x.key, 'area': x.area}})) end as q from g where day < last))),
        d as (select zone, unnest(served) as key, day from g)
        select zone, key, day as served_day, coalesce(burned and day <= burn_day - 1, false) as preempted from r left join d using (zone, key)"""


@query(_replay_sql())
def replay_zone_greedy(spark, sf):
    """N-01, G-13, W-20. Sequential by day within a zone."""
    f = season_fields(spark, sf, 1997)
    day = lambda d: F.datediff(d, F.lit("1997-01-01").cast("date")).cast("double")
    rows = f.select((c("ix") % 7).alias("zone"), c("field_id").alias("key"), c("pixel_area_ha").alias("area"), day("harvest_date").alias("ready"), "burned", day("burn_date").alias("burn_day"), day("burn_prev_date").alias("last_clear"), (c("field_id") * 7919 % 100 / 100).alias("score"), F.lit(None).cast("array<struct<day:int,score:double>>").alias("dynamic"))
    return simulate.replay(rows, [40, 41, 42], "risk")


def _greedy_sql() -> str:
    """The queue of a market served one by one: a state of what room its buyers have left goes from field to field."""
    half = lambda a, b: f"power(sin(radians({a} - {b}) / 2), 2)"
    km = f"2 * 6371.0088 * asin(sqrt(least(greatest({half('bla', 'la')} + cos(radians(la)) * cos(radians(bla)) * {half('blo', 'lo')}, 0), 1)))"
    left = "list_filter(g.rooms, lambda r: r.b = x.b)[1].room"
    offer = f"{{'s': 50.0::double + 25.0::double * least(1.0::double, {left} / 400.0::double) + 25.0::double * greatest(0.0::double, 1 - x.km / 250.0::double), 'nk': -x.km, 'b': x.b, 'room': {left}}}"
    return f"""with recursive f as (select c_custkey as field_id, c_nationkey as market, 30 + c_custkey % 100 / 50 as la, 75 + c_custkey % 70 / 50 as lo, c_acctbal / 10000 as score, round(c_acctbal / 100) as tonnes from customer where c_acctbal > 0),
        b as (select s_suppkey as buyer_id, s_nationkey as market, 30 + s_suppkey % 50 / 50 as bla, 75 + s_suppkey % 60 / 50 as blo, s_suppkey % 9 = 0 as paused from supplier),
        p as (select f.*, buyer_id, paused, {km} as km from f join b using (market)),
        o as (select *, row_number() over (partition by market order by score desc, tonnes desc, field_id) as n from (select market, field_id, score, tonnes, list({{'b': buyer_id, 'km': km}}) as offers from p where not paused and km <= 250 group by all)),
        g as (select market, 0::bigint as n, null::bigint as field_id, null::double as tonnes, null::struct(s double, nk double, b bigint, room double) as best, list({{'b': buyer_id, 'room': 300.0::double}}) as rooms from b group by market
            union all select market, n, field_id, tonnes, best, list_transform(rooms, lambda r: {{'b': r.b, 'room': case when best is not null and r.b = best.b then greatest(0.0::double, r.room - tonnes) else r.room end}}) from (
                select g.market, o.n, o.field_id, o.tonnes, g.rooms, list_reverse_sort(list_filter(list_transform(o.offers, lambda x: {offer}), lambda y: o.tonnes <= y.room + 0.000001::double))[1] as best from g join o on o.market = g.market and o.n = g.n + 1)),
        w as (select field_id, bool_or(not paused) as open, bool_or(not paused and km > 250) as far from p group by field_id), t as (select * from g where best is not null)
        select field_id, best.b as buyer_id, round(best.s, 3) as match_score, round(-best.nk, 3) as km, t.tonnes, case when best is not null then greatest(0.0::double, best.room - t.tonnes) end as room_left, case when best is null then case when not coalesce(open, false) then 'NO_COMPATIBLE_BUYER' when far then 'DISTANCE_LIMIT' else 'NO_BUYER_CAPACITY' end end as reason
        from f left join t using (field_id) left join w using (field_id)"""


@query(_greedy_sql())
def buyer_greedy(spark, sf):
    """N-08, P-15. Capacity is shared within a nation's market."""
    f = read(spark, sf, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("field_id"), c("c_nationkey").alias("market"), (F.lit(30) + c("c_custkey") % 100 / 50).alias("field_lat"), (F.lit(75) + c("c_custkey") % 70 / 50).alias("field_lon"), F.lit("straw").alias("residue"), F.lit(12.0).alias("moisture"), (c("c_acctbal") / 10000).alias("score"), F.round(c("c_acctbal") / 100).alias("tonnes"))
    out = simulate.match_buyers(f, buyers(spark, sf), ["market"], arrival_minute=600)
    return out.withColumns({"match_score": F.round("match_score", 3), "km": F.round("km", 3)})


def buyers(spark, sf):
    """Suppliers as buyers."""
    return read(spark, sf, "supplier").select(c("s_suppkey").alias("buyer_id"), c("s_nationkey").alias("market"), (F.lit(30) + c("s_suppkey") % 50 / 50).alias("buyer_lat"), (F.lit(75) + c("s_suppkey") % 60 / 50).alias("buyer_lon"), F.when(c("s_suppkey") % 9 == 0, "PAUSED").otherwise("AVAILABLE").alias("buyer_status"), F.array(F.lit("STRAW")).alias("accepted"), F.lit(15.0).alias("max_moisture"), F.lit("06:00").alias("opens"), F.lit("20:00").alias("closes"), F.lit(400.0).alias("demand"), F.lit(300.0).alias("room"))


def depots(spark, sf):
    """Customers as fields and suppliers as units of their nation's depot."""
    f = read(spark, sf, "customer").where("c_acctbal > 5000").select(c("c_custkey").alias("field_id"), c("c_nationkey").alias("depot"), (F.lit(30) + c("c_custkey") % 100 / 200).alias("lat"), (F.lit(75) + c("c_custkey") % 70 / 200).alias("lon"), (F.lit(1) + c("c_custkey") % 9).cast("double").alias("acres"), F.round(c("c_acctbal") / 1000).alias("tonnes"), (c("c_acctbal") / 10000).alias("score"))
    u = read(spark, sf, "supplier").select(c("s_suppkey").alias("unit_id"), c("s_nationkey").alias("depot"), F.lit(30.2).alias("lat"), F.lit(75.2).alias("lon"), F.lit(20.0).alias("max_acres"), F.lit(40.0).alias("max_straw"), F.lit(480).alias("shift_minutes"), F.lit(3.0).alias("acres_per_hour"))
    return f, u


def _tours_sql() -> str:
    """The fields of a depot one by one: a state of where its units stand and what they carry goes from field to field."""
    km = lambda a, b, c, d: f"2 * 6371.0088 * asin(least(1.0, sqrt(power(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * power(sin(radians({d} - {b}) / 2), 2))))"
    way, home = km("x.la", "x.lo", "o.la", "o.lo"), km("o.la", "o.lo", "30.2::double", "75.2::double")
    work = "ceil(o.acres / 3.0::double * 60)::bigint"
    ok = f"x.acres + o.acres <= 20 and x.straw + o.tonnes <= 40 and x.minutes + {work} <= 480 and x.km + {way} + {home} <= 300"
    option = f"{{'tour': x.km + {way} + {home}, 'u': x.u, 'work': {work}, 'way': {way}, 'ok': {ok}}}"
    served = "{'u': r.u, 'la': la, 'lo': lo, 'acres': r.acres + acres, 'straw': r.straw + tonnes, 'minutes': r.minutes + best.work, 'km': r.km + best.way, 'stops': r.stops + 1}"
    start = "{'u': s_suppkey, 'la': 30.2::double, 'lo': 75.2::double, 'acres': 0.0::double, 'straw': 0.0::double, 'minutes': 0::bigint, 'km': 0.0::double, 'stops': 0::bigint}"
    return f"""with recursive o as (select c_custkey as field_id, c_nationkey as depot, 30 + c_custkey % 100 / 200 as la, 75 + c_custkey % 70 / 200 as lo, (1 + c_custkey % 9)::double as acres, round(c_acctbal / 1000) as tonnes, row_number() over (partition by c_nationkey order by c_acctbal / 10000 desc, round(c_acctbal / 1000) desc, c_custkey) as n from customer where c_acctbal > 5000),
        g as (select s_nationkey as depot, 0::bigint as n, null::bigint as field_id, null::struct(tour double, u bigint, work bigint, way double, ok boolean) as best, list({start}) as units from supplier group by 1
            union all select depot, n, field_id, best, list_transform(units, lambda r: case when best is not null and r.u = best.u then {served} else r end) from (
                select g.depot, o.n, o.field_id, o.la, o.lo, o.acres, o.tonnes, g.units, list_sort(list_filter(list_transform(g.units, lambda x: {option}), lambda y: y.ok))[1] as best from g join o on o.depot = g.depot and o.n = g.n + 1))
        select o.field_id, best.u as unit_id, list_filter(units, lambda r: r.u = best.u)[1].stops as stop, round(best.way, 3) as leg_km from o left join g using (field_id)"""


@query(_tours_sql())
def greedy_tours(spark, sf):
    """N-10."""
    return simulate.route(*depots(spark, sf), "depot").withColumn("leg_km", F.round("leg_km", 3))


@query("""with f as (select c_custkey as field_id, c_nationkey as depot, 30 + c_custkey % 100 / 20 as la, 75 + c_custkey % 70 / 20 as lo, (c_custkey % 40)::double as acres, round(c_acctbal / 200) as tonnes from customer),
    p as (select f.*, 2 * 6371.0088 * asin(sqrt(power(sin(radians(la - 30.2) / 2), 2) + cos(radians(30.2)) * cos(radians(la)) * power(sin(radians(lo - 75.2) / 2), 2))) as km, 20 + s_suppkey % 3 * 5 as most from f join supplier on s_nationkey = depot)
    select field_id, case when bool_and(acres > most) then 'CAPACITY_EXCEEDED' when bool_and(ceil(acres / 3.0::double * 60) > 480) then 'WORKING_HOURS_EXCEEDED' when bool_and(km > 300) then 'DISTANCE_LIMIT' when bool_and(tonnes > 40) then 'CAPACITY_EXCEEDED' else 'CAPACITY_OR_ROUTE_LIMIT' end as reason from p group by field_id""")
def dropped_fields(spark, sf):
    """N-11: what each field lacks with every unit of its nation's depot."""
    k = c("c_custkey")
    f = read(spark, sf, "customer").select(k.alias("field_id"), c("c_nationkey").alias("depot"), (F.lit(30) + k % 100 / 20).alias("lat"), (F.lit(75) + k % 70 / 20).alias("lon"), (k % 40).cast("double").alias("acres"), F.round(c("c_acctbal") / 200).alias("tonnes"))
    u = depots(spark, sf)[1].withColumn("max_acres", (F.lit(20) + c("unit_id") % 3 * 5).cast("double"))
    return simulate.drop_reasons(f, u, "depot")


@query("""with f as (select c_custkey as field_id, c_nationkey as depot from customer where c_acctbal > 5000), u as (select distinct s_nationkey as depot from supplier)
    select field_id, true as once, true as within_limits, true as no_dearer, case when depot not in (select depot from u) then false end as served_without_units from f""")
def guided_tours(spark, sf):
    """N-09: what holds of every tour: each field once, units within area, straw, shift and distance, no depot dearer than its greedy tours, depots without units serve nothing. Tours themselves are held against the limits here and by tests."""
    from ..operators.routing import guided_routes
    from ..sources.staging import staged

    f, u = depots(spark, sf)
    out = staged(guided_routes(f, u, "depot", steps=1_000)).join(f.select("field_id", "depot", "acres", "tonnes", "lat", "lon"), "field_id")
    home = G.haversine_km(c("lat"), c("lon"), F.lit(30.2), F.lit(75.2))
    last = F.max(F.struct("stop", home.alias("km")))["km"]
    tour = out.where("unit_id is not null").groupBy("unit_id").agg((F.sum("acres") <= 20).alias("a"), (F.sum("tonnes") <= 40).alias("t"), (F.sum(F.ceil(c("acres") / 3 * 60)) <= 480).alias("m"), (F.sum("leg_km") + last <= 300).alias("k"), (F.max("stop") == F.count(F.lit(1))).alias("s"))
    times = out.groupBy("field_id").agg((F.count(F.lit(1)) == 1).alias("once"))
    rows = out.join(times, "field_id").join(tour, "unit_id", "left").join(u.select("depot").distinct().withColumn("has", F.lit(True)), "depot", "left")
    limits = F.coalesce(c("a") & c("t") & c("m") & c("k") & c("s"), F.lit(True))
    return rows.select("field_id", "once", limits.alias("within_limits"), (c("depot_cost") <= c("greedy_cost")).alias("no_dearer"), F.when(c("has").isNull(), c("unit_id").isNotNull()).alias("served_without_units"))


@query(None)
def action_plan(spark, sf):
    """N-12: fields that a buyer would take, their tours, and the buyers of what was collected."""
    f, u = depots(spark, sf)
    fields = f.select("*", c("lat").alias("field_lat"), c("lon").alias("field_lon"), F.lit("straw").alias("residue"), F.lit(12.0).alias("moisture"), c("depot").alias("market"))
    plan = simulate.plan_action(fields, buyers(spark, sf), u, "depot", ["market"], steps=500)
    tours = plan["tours"].select("field_id", "unit_id", "stop")
    return plan["preview"].select("field_id", "reason").join(tours, "field_id", "left").join(plan["matches"].select("field_id", "buyer_id"), "field_id", "left")


# Grams of each species a kilogram of dry matter gives off, and their deviation.
FACTORS = {"CO2": (1430.0, 230.0), "CH4": (5.7, 6.0), "N2O": (0.09, 0.04), "CO": (76.0, 55.0), "PM2_5": (8.2, 4.4), "BC": (0.42, 0.28), "OC": (4.9, 3.6)}


def _emissions_sql() -> str:
    u = lambda k: f"((('0x' || substr(md5(i || ':{k}:0'), 1, 8))::bigint + 0.5) / 4294967296.0)::double"
    between = lambda a, b, k: f"({a}::double + {b - a}::double * {u(k)})"
    species = [f"dm * greatest({m}::double + {d}::double * (sqrt(-2 * ln({u(10 + 2 * k)})) * cos(2 * pi() * {u(11 + 2 * k)})), {0.1 * m}::double) / 1000 as {s}_t" for k, (s, (m, d)) in enumerate(FACTORS.items())]
    names = ["dry_matter_t", *[f"{s}_t" for s in FACTORS], "co2e_t"]
    rows = " union all ".join(f"select region, '{n}' as measure, round(quantile_cont({n}, 0.05), 3) as p05, round(quantile_cont({n}, 0.5), 3) as median, round(quantile_cont({n}, 0.95), 3) as p95 from e group by region" for n in names)
    return f"""with i as (select unnest(generate_series(0, 19999)) as i), a as (select n_regionkey as region, sum(c_custkey % 40)::double / 10 as area_ha from customer join nation on n_nationkey = c_nationkey group by 1), d as (select region, i, area_ha * {between(5.0, 7.5, 1)} * {between(0.8, 0.9, 2)} * {between(0.7, 0.9, 3)} as dm from a, i),
        s as (select region, dm as dry_matter_t, {", ".join(species)} from d), e as (select *, CH4_t * 27.0::double + N2O_t * 273.0::double as co2e_t from s) {rows}"""


@query(_emissions_sql())
def emissions_mc(spark, sf):
    """A-36: what each region's fields would give off."""
    fields = read(spark, sf, "customer").join(read(spark, sf, "nation"), c("n_nationkey") == c("c_nationkey"))
    areas = fields.groupBy(c("n_regionkey").alias("region")).agg((F.sum(c("c_custkey") % 40) / 10).alias("area_ha"))
    out = A.draw_summary(A.emission_draws(areas, FACTORS), ["dry_matter_t", *[f"{s}_t" for s in FACTORS], "co2e_t"], ("region",))
    return out.select("region", "measure", *[F.round(x, 3).alias(x) for x in ("p05", "median", "p95")])


@query("""select s_suppkey, 2 * 6371.0088 * asin(sqrt(least(greatest(power(sin(radians(d2 - d1) / 2), 2) + cos(radians(d1)) * cos(radians(d2)) * power(sin(radians(l2 - l1) / 2), 2), 0), 1))) > 60 as far from
    (select s_suppkey, 30 + s_suppkey % 50 / 50 as d1, 75 + s_suppkey % 60 / 50 as l1, 30.5::double as d2, 75.5::double as l2 from supplier)""")
def haversine(spark, sf):
    """F-22. The distance itself has literal tests; trigonometry differs in last digits between engines."""
    s = read(spark, sf, "supplier")
    km = G.haversine_km(F.lit(30) + c("s_suppkey") % 50 / 50, F.lit(75) + c("s_suppkey") % 60 / 50, F.lit(30.5), F.lit(75.5))
    return s.select("s_suppkey", (km > 60).alias("far"))


@query("""with g as (select s_suppkey, s_suppkey % 10 as k from supplier), p as (select c_custkey, (c_custkey * 7919 % 1000)::double as x, (c_custkey * 104729 % 997)::double as y from customer)
    select c_custkey, x >= 100 and x <= 600 and y >= 200 and y <= 700 as inside, sqrt(power(greatest(100 - x, 0, x - 600), 2) + power(greatest(200 - y, 0, y - 700), 2)) as distance from p""")
def polygon_membership(spark, sf):
    """J-19, J-23, F-27."""
    p = points(spark, sf, "customer", "c_custkey")
    ring = F.array(*[F.struct(F.lit(float(a)).alias("x"), F.lit(float(b)).alias("y")) for a, b in ((100, 200), (600, 200), (600, 700), (100, 700))])
    return p.select(c("id").alias("c_custkey"), G.in_ring(c("x"), c("y"), ring).alias("inside"), G.polygon_distance(c("x"), c("y"), ring).alias("distance"))


def _temporal_sql() -> str:
    """The single windows' SQL side by side; the second metric is half the first, so its measures are."""
    from .queries_windows import SQL as W

    stats = ["delta_2obs", "rolling_mean_2", "rolling_mean_3", "rolling_std_3", "slope_last_3"]
    scaled = ["prev", "delta", *stats]
    first = [f"v_{c} as NDVI_{c}" for c in [*scaled, "pct_change"]] + [f"v_{c} / 2 as NBR_{c}" for c in scaled] + ["v_pct_change as NBR_pct_change"]
    peak = [f"v_{c} as NDVI_{c}" for c in ("peak", "peak_ts", "drop_from_peak", "drop_fraction", "days_since_peak")]
    back = f"""with {OBS}, g as (select o.event_id, max({{'t': p.ts_us, 'e': p.event_id}}) filter (p.ok) as m, count(p.event_id) filter (p.ok) as n from o left join o p on p.user_id = o.user_id and p.ts_us < o.ts_us group by o.event_id)
        select event_id, m.t as prev_ts_us, m.e as prev_image, case when m is not null then 'GOOD' end as prev_quality, m is not null as has_prev, n as history_count from g"""
    return f"""select o.event_id, o.user_id, o.ts_us, case when ok then 'GOOD' else 'POOR' end as observation_quality, 10 as valid_pixel_count, o.v as NDVI, o.v / 2 as NBR, h.history_count, h.prev_ts_us, h.prev_image, h.prev_quality, h.has_prev,
        (o.ts_us - h.prev_ts_us) / 86400000000 as gap_days, case when h.prev_ts_us is null then null when (o.ts_us - h.prev_ts_us) / 86400000000 <= 14 then 'NORMAL' when (o.ts_us - h.prev_ts_us) / 86400000000 <= 30 then 'MODERATE' else 'LARGE' end as gap_category,
        observation_number, days_since_first, duplicate_timestamp, {", ".join(first + peak)}, 'temporal-1' as feature_schema_version
        from (with {OBS} select * from o) o join ({back}) h using (event_id) join ({W["obs_number_gap"]}) n using (event_id) join ({W["prev_valid_block"]}) b using (event_id)
        join ({W["rolling_valid_means"]}) r using (event_id) join ({W["slope_last3"]}) s using (event_id) join ({W["running_peak"]}) p using (event_id)"""


@query(_temporal_sql())
def temporal_rows(spark, sf):
    """B-03: all windows in one plan; each has its own query with SQL."""
    from .temporal import temporal_rows as build

    o = observations(spark, sf).select("event_id", "user_id", "ts_us", F.when(c("ok"), "GOOD").otherwise("POOR").alias("observation_quality"), F.lit(10).alias("valid_pixel_count"), c("v").alias("NDVI"), (c("v") / 2).alias("NBR"))
    return build(o, ["user_id"], ["NDVI", "NBR"], "NDVI", tie="event_id", radar=False)
