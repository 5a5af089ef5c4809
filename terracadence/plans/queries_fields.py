"""Registered queries of field features and of the geometry pipeline, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import features
from .tables import OBS, observations, read

QUERIES, SQL = {}, {}
c = F.col


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


HOURS = """h as (select epoch_us(o_orderdate::timestamp) + (o_orderkey % 24) * 3600000000 as at_us, sum(o_custkey % 5)::double as rain, max(case when o_orderkey % 3 = 0 then (o_orderkey % 100)::double end) as humidity from orders group by 1)"""


def hours(spark, sf):
    """An hourly series out of orders: rain in whole millimetres, humidity missing at times."""
    from ..functions.times import ts_us

    k = c("o_orderkey")
    at = ts_us(c("o_orderdate").cast("timestamp_ntz")) + (k % 24) * 3_600_000_000
    return read(spark, sf, "orders").select(at.alias("at_us"), (c("o_custkey") % 5).alias("r"), F.when(k % 3 == 0, (k % 100).cast("double")).alias("q")).groupBy("at_us").agg(F.sum("r").cast("double").alias("rain"), F.max("q").alias("humidity"))


@query(f"""with {HOURS}, e as (select l_orderkey, l_linenumber, epoch_us(l_shipdate::timestamp) + (l_linenumber * 3 + 1) * 3600000000 as t from lineitem),
    d as (select distinct t from e), n as (select d.t, max(h.at_us) as seen from d join h on h.at_us <= d.t group by d.t),
    r as (select d.t, n.seen, coalesce(sum(h.rain) filter (h.at_us > d.t - 86400000000), 0) as r24, sum(h.rain) as r72 from d join n using (t) left join h on h.at_us <= d.t and h.at_us > d.t - 259200000000 group by all),
    m as (select d.t, arg_max(h.humidity, h.at_us) as hum from d join h on h.at_us <= d.t and h.humidity is not null group by d.t)
    select l_orderkey, l_linenumber, case when seen > t - 86400000000 then r24 end as rain_24h, case when seen > t - 259200000000 then r72 end as rain_72h, hum as last_humidity from e left join r using (t) left join m using (t)""")
def weather_at_images(spark, sf):
    """B-02: one hourly series for all images."""
    from ..functions.times import ts_us

    t = ts_us(c("l_shipdate").cast("timestamp_ntz")) + (c("l_linenumber") * 3 + 1) * 3_600_000_000
    rows = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", t.cast("long").alias("ts_us"))
    return features.weather_features(rows, hours(spark, sf)).drop("ts_us")


def _square(x, y, side):
    corner = lambda dx, dy: F.struct((x + dx * side).cast("double").alias("x"), (y + dy * side).cast("double").alias("y"))
    return F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1))


SQUARES = "q as (select c_custkey as id, (c_custkey * 7919 % 100000)::double as x, (c_custkey * 104729 % 99991)::double as y, (100 + c_custkey % 5 * 200)::double as side, 1000000000000 + c_custkey as t from customer)"


@query(f"""with {SQUARES}, f as (select o_orderkey, (o_orderkey * 31 % 100000)::double as fx, (o_orderkey * 53 % 99991)::double as fy, 1000000000000 + o_orderkey % 1500 as ft, case when o_orderkey % 3 = 0 then 'M' else 'V' end as src from orders),
    p as (select q.id, sqrt(power(greatest(x - fx, 0, fx - x - side), 2) + power(greatest(y - fy, 0, fy - y - side), 2)) as d from q join f on ft <= q.t),
    g as (select id, count(*) filter (d = 0) as a, count(*) filter (d <= 500) as b, count(*) filter (d <= 1000) as n, min(d) as nearest from p group by id)
    select q.id, coalesce(a, 0) as fires_inside, coalesce(b, 0) as fires_500m, coalesce(n, 0) as fires_1000m, round(nearest, 6) as nearest_m from q left join g using (id)""")
def fires_around_polygons(spark, sf):
    """J-19, F-27: fires up to the image inside and around polygons of very different sizes."""
    k, o = c("c_custkey"), c("o_orderkey")
    rows = read(spark, sf, "customer").select(k.alias("id"), _square(k * 7919 % 100000, k * 104729 % 99991, 100 + k % 5 * 200).alias("ring"), (1_000_000_000_000 + k).alias("ts_us"))
    fires = read(spark, sf, "orders").select((o * 31 % 100000).cast("double").alias("fx"), (o * 53 % 99991).cast("double").alias("fy"), (1_000_000_000_000 + o % 1500).alias("fire_us"), F.when(o % 3 == 0, "M").otherwise("V").alias("source"))
    return features.fire_features(rows, fires, "id", "ring").select("id", "fires_inside", "fires_500m", "fires_1000m", F.round("nearest_m", 6).alias("nearest_m"))


@query(f"""with {SQUARES.replace("100000)", "10000)").replace("99991", "9973")} select a.id as field_id, b.id as other_id, round((least(a.x + a.side, b.x + b.side) - greatest(a.x, b.x)) * (least(a.y + a.side, b.y + b.side) - greatest(a.y, b.y)), 3) as overlap_m2
    from q a join q b on a.id < b.id and a.x < b.x + b.side and b.x < a.x + a.side and a.y < b.y + b.side and b.y < a.y + a.side where (least(a.x + a.side, b.x + b.side) - greatest(a.x, b.x)) * (least(a.y + a.side, b.y + b.side) - greatest(a.y, b.y)) > 1""")
def overlapping_fields(spark, sf):
    """J-22: however far apart the centres of overlapping polygons are."""
    k = c("c_custkey")
    rows = read(spark, sf, "customer").select(k.alias("field_id"), _square(k * 7919 % 10000, k * 104729 % 9973, 100 + k % 5 * 200).alias("xy"))
    return features.overlapping(rows).select("field_id", "other_id", F.round("overlap_m2", 3).alias("overlap_m2"))


def _shape(x, y, s, corners):
    """GeoJSON of a ring; corners in units of the side."""
    at = lambda dx, dy: F.concat(F.lit("["), (x + dx * s).cast("string"), F.lit(","), (y + dy * s).cast("string"), F.lit("]"))
    return F.concat(F.lit("[["), F.concat_ws(",", *[at(*p) for p in corners]), F.lit("]]"))


#: Corners of the shapes that customers hold by their key modulo 6: square, small square, bow tie, spike, square from another corner, flat.
CORNERS = {0: ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0)), 2: ((0, 0), (1, 1), (1, 0), (0, 1), (0, 0)), 3: ((0, 0), (1, 0), (1, 1), (0.5, 1), (0.5, 1.5), (0.5, 1), (0, 1), (0, 0)), 4: ((1, 1), (0, 1), (0, 0), (1, 0), (1, 1)), 5: ((0, 0), (1, 0), (2, 0), (0, 0))}


@query(f"""with g as (select c_custkey as k, case when c_mktsegment = 'BUILDING' and c_custkey % 5 = 0 then null when c_custkey % 10 = 9 then cast(c_custkey - 9 as varchar) else cast(c_custkey as varchar) end as id, 75 + (c_custkey - c_custkey % 12 + case when c_custkey % 12 = 4 then 0 else c_custkey % 12 end) % 700 / 100 as x,
        28 + floor((c_custkey - c_custkey % 12) / 700) / 50 as y, case when c_custkey % 6 = 1 then 0.00005 else 0.001 end as s, c_custkey % 6 as kind, c_acctbal < -900 as far, c_acctbal > 9900 as line from customer),
    p as (select k, unnest(case {" ".join(f"when kind = {n} then [{', '.join(f'[{a}, {b}]' for a, b in CORNERS[n])}]" for n in CORNERS)} else [[0, 0], [1, 0], [1, 1], [0, 1], [0, 0]] end) as d, generate_subscripts(case {" ".join(f"when kind = {n} then range({len(CORNERS[n])})" for n in CORNERS)} else range(5) end, 1) as i from g),
    v as (select k, i, x + d[1] * s as px, case when far then 89.9995 else y end + d[2] * s as py, x, y, s from p join g using (k)),
    e as (select a.k, a.i, a.px as x1, a.py as y1, b.px as x2, b.py as y2 from v a join v b on a.k = b.k and b.i = a.i + 1),
    w as (select k, least(x1 || ':' || y1, x2 || ':' || y2) || '/' || greatest(x1 || ':' || y1, x2 || ':' || y2) as edge, count(*) as n from e group by all),
    t as (select k, max(n) as most from w group by k),
    o as (select a.k, bool_or(((a.x2 - a.x1) * (b.y1 - a.y1) - (a.y2 - a.y1) * (b.x1 - a.x1)) * ((a.x2 - a.x1) * (b.y2 - a.y1) - (a.y2 - a.y1) * (b.x2 - a.x1)) < 0 and ((b.x2 - b.x1) * (a.y1 - b.y1) - (b.y2 - b.y1) * (a.x1 - b.x1)) * ((b.x2 - b.x1) * (a.y2 - b.y1) - (b.y2 - b.y1) * (a.x2 - b.x1)) < 0) as crosses from e a join e b on a.k = b.k and abs(a.i - b.i) > 1 group by a.k),
    f as (select k, sum(x1 * y2 - x2 * y1) / 2 as twice, bool_or(y1 > 90 or y1 < -90) as outside, string_agg(distinct round(x1, 7) || ':' || round(y1, 7), '|' order by round(x1, 7) || ':' || round(y1, 7)) as corners, count(distinct round(y1, 7)) = 1 as flat from e group by k),
    r as (select g.k, g.id, g.line, outside, crosses, corners, flat or (most > 1) as unsafe, not flat and s < 0.0005 as small from g join f using (k) join o using (k) join t using (k)),
    q as (select *, id is not null and row_number() over (partition by id order by k) > 1 as again, not line and not unsafe and row_number() over (partition by (line or unsafe), case when line or unsafe then cast(k as varchar) else corners || crosses end order by k) > 1 as shape_again from r),
    z as (select *, array_to_string(list_filter([case when id is null then 'missing_required_attribute:field_id' end, case when again then 'duplicate_field_id' end, case when line then 'geometry_not_polygon' end, case when outside and not line then 'coordinates_outside_valid_wgs84_bounds' end, case when unsafe and not line then 'invalid_geometry_not_safely_repairable' end, case when shape_again then 'duplicate_geometry' end], lambda i: i is not null), '|') as earlier from q)
    select k as c_custkey, case when earlier = '' and small then 'area_below_minimum' else earlier end as issues, coalesce(crosses, false) and not unsafe and not line as geometry_repaired from z""")
def field_validation(spark, sf):
    """B-12, P-14, F-24, F-25, F-28: squares, squares too small, bow ties, spikes, squares again from another corner and flat rings; rows without an id, with the id of another, off the map and of another kind. The SQL finds crossings, spikes, equal shapes and limits in the coordinates."""
    from .fields import import_fields

    k, home = c("c_custkey"), c("c_custkey") - c("c_custkey") % 12
    x = F.lit(75) + (home + F.when(k % 12 == 4, 0).otherwise(k % 12)) % 700 / 100
    y = F.when(c("c_acctbal") < -900, 89.9995).otherwise(F.lit(28) + F.floor(home / 700) / 50)
    side = F.when(k % 6 == 1, 0.00005).otherwise(0.001)
    ring = F.lit(None).cast("string")
    for n, corners in CORNERS.items():
        ring = F.when(k % 6 == n, _shape(x, y, side, corners)).otherwise(ring)
    ring = F.coalesce(ring, _shape(x, y, side, CORNERS[0]))
    kind = F.when(c("c_acctbal") > 9900, "MultiLineString").otherwise("Polygon")
    name = F.when((c("c_mktsegment") == "BUILDING") & (k % 5 == 0), None).otherwise(F.when(k % 10 == 9, k - 9).otherwise(k).cast("string"))
    raw = read(spark, sf, "customer").select("c_custkey", name.alias("field_id"), F.concat(F.lit('{"type":"'), kind, F.lit('","coordinates":'), ring, F.lit("}")).alias("geometry"))
    out = import_fields(raw, "c_custkey")
    return out.select("c_custkey", F.array_join("issues", "|").alias("issues"), "geometry_repaired")


@query(f"""with {OBS} select event_id, lag(event_id) over (partition by user_id order by ts_us, event_id) as previous, (ts_us - min(ts_us) over (partition by user_id)) // 86400000000 as day from o""")
def series_days(spark, sf):
    """W-10, F-17: the row before and whole days since the first one."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    return observations(spark, sf).select("event_id", F.lag("event_id").over(w.orderBy("ts_us", "event_id")).alias("previous"), F.floor((c("ts_us") - F.min("ts_us").over(w)) / 86_400_000_000).alias("day"))
