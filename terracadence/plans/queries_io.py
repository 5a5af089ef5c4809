"""Registered queries of files and streams: written to the shared folder, read again, and held against the tables they came from."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import times as TM
from ..operators import audit
from ..sources import readers as R
from ..sources import sinks
from ..sources.staging import shared_folder
from ..streaming import verification as V
from .payloads import fires_of_year
from .tables import OBS, observations, read

QUERIES, SQL = {}, {}
c = F.col


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def place(spark) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark.sparkContext)}/{uuid.uuid4().hex}"


@query("select n_nationkey::varchar as n_nationkey, n_name, n_regionkey::varchar as n_regionkey from nation")
def csv_round_trip(spark, sf):
    """S-03, K-01: all columns come back as text."""
    path, columns = place(spark), ["n_nationkey", "n_name", "n_regionkey"]
    sinks.csv(read(spark, sf, "nation"), path, columns)
    return R.csv_text(spark, path, columns)


@query("select o_orderkey, year(o_orderdate)::integer as season from orders where o_totalprice >= 200000")
def season_files(spark, sf):
    """S-04, S-05, K-02: a folder per season; columns and filter reach the scan."""
    path = place(spark)
    sinks.by_season(read(spark, sf, "orders").select("o_orderkey", "o_totalprice", F.year("o_orderdate").alias("season")), path, "season")
    return R.parquet(spark, path, ["o_orderkey", "season"], c("o_totalprice") >= 200000)


@query("select s_suppkey, x, y from (select s_suppkey, (s_suppkey * 7919 % 1000)::double as x, (s_suppkey * 104729 % 997)::double as y from supplier) where x between 200 and 700 and y between 100 and 600")
def bbox_scan(spark, sf):
    """S-06, P-13: a box around coordinates as a pushed filter on files."""
    path, k = place(spark), c("s_suppkey")
    read(spark, sf, "supplier").select("s_suppkey", F.pmod(k * 7919, F.lit(1000)).cast("double").alias("x"), F.pmod(k * 104729, F.lit(997)).cast("double").alias("y")).write.parquet(path)
    return R.parquet(spark, path, ["s_suppkey", "x", "y"], c("x").between(200, 700) & c("y").between(100, 600))


@query("""select s_suppkey as id, case when s_suppkey % 2 = 0 then 'Polygon' else 'MultiPolygon' end as geometry_type, (1 + s_suppkey % 2)::integer as rings, (4 * (1 + s_suppkey % 2))::integer as corners, (s_suppkey % 50)::double as first_x from supplier""")
def geojson_features(spark, sf):
    """S-01: a collection of polygons and multi-polygons, written as documents of bounded size."""
    path, x = place(spark), c("s_suppkey") % 50
    ring = lambda dx: F.format_string("[[%d,0],[%d,1],[%d,1],[%d,0]]", *[(x + dx + k).cast("int") for k in (0, 0, 1, 1)])
    coordinates = F.when(c("s_suppkey") % 2 == 0, F.concat(F.lit("["), ring(0), F.lit("]"))).otherwise(F.concat(F.lit("[["), ring(0), F.lit("],["), ring(5), F.lit("]]")))
    kind = F.when(c("s_suppkey") % 2 == 0, "Polygon").otherwise("MultiPolygon")
    feature = F.format_string('{"properties":{"id":%d},"geometry":{"type":"%s","coordinates":%s}}', c("s_suppkey"), kind, coordinates)
    parts = read(spark, sf, "supplier").groupBy(F.floor(c("s_suppkey") / 500).alias("part")).agg(F.array_join(F.collect_list(feature), ",").alias("all"))  # documents of 500 features, more of them as the table grows
    document = F.concat(F.lit('{"type":"FeatureCollection","features":['), c("all"), F.lit("]}"))
    parts.select("part", document.alias("value")).write.partitionBy("part").text(path)
    out = R.geojson(spark, f"{path}/*", "id long")
    return out.select("id", "geometry_type", F.size("rings").alias("rings"), F.aggregate("rings", F.lit(0), lambda a, r: a + F.size(r)).alias("corners"), c("rings")[0][0]["x"].alias("first_x"))


@query("""select 'f' || (c_custkey % 40) as field_id, c_custkey::varchar as source_image_id, (1 + c_custkey % 3)::integer as pixels, c_custkey % 2 = 0 as first_valid from customer""")
def observation_bundle(spark, sf):
    """S-02, S-29: bundles of one kind, one document a file."""
    path, k = place(spark), c("c_custkey")
    pixels = F.transform(F.sequence(F.lit(1), (1 + k % 3).cast("int")), lambda i: F.struct((i / 10).alias("B8"), (k % 2 == 0).alias("valid")))
    row = F.struct(F.concat(F.lit("f"), k % 40).alias("field_id"), k.cast("string").alias("source_image_id"), pixels.alias("pixels"))
    docs = read(spark, sf, "customer").groupBy(F.floor(k / 1000).alias("part")).agg(F.collect_list(row).alias("s2_observations"))  # documents of a thousand rows, more of them as the table grows
    docs.select("part", F.to_json(F.struct(F.lit("synthetic").alias("fixture_type"), "s2_observations")).alias("value")).write.partitionBy("part").text(path)
    out = R.bundle(spark, f"{path}/*")["optical"]
    return out.select("field_id", "source_image_id", F.size("pixels").alias("pixels"), c("pixels")[0]["valid"].alias("first_valid"))


@query("""select o_orderkey::varchar as id, case o_orderkey % 3 when 0 then 'MODIS' when 1 then 'NOAA-20' else 'S-NPP' end as sensor, (o_custkey % 3)::integer as kind from orders""")
def archive_files(spark, sf):
    """S-16, S-17, S-18: white-space and comma archives under each other, the sensor taken from the file's name."""
    path, k = place(spark), c("o_orderkey")
    o = read(spark, sf, "orders").select(k.cast("string").alias("id"), (c("o_custkey") % 3).cast("string").alias("kind"), (k % 3).alias("r"))
    o.where("r = 0").select(F.concat_ws("   ", "id", "kind")).write.text(f"{path}/fire_archive_modis")
    for r, name in ((1, "fire_nrt_J1V"), (2, "fire_nrt_suomi")):
        sinks.csv(o.where(c("r") == r), f"{path}/{name}", ["id", "kind"])
    tables = [R.whitespace_table(spark, f"{path}/fire_archive_modis", ["id", "kind"]).withColumn("file", F.lit("fire_archive_modis"))]
    tables += [R.csv_text(spark, f"{path}/{name}", ["id", "kind"]).withColumn("file", F.lit(name)) for name in ("fire_nrt_J1V", "fire_nrt_suomi")]
    return R.union_archives(tables).select("id", R.sensor_of_file(c("file")).alias("sensor"), c("kind").cast("int").alias("kind"))


@query("select 'p' || s_suppkey as facility_id, case when s_nationkey % 2 = 0 then 'BALER' else 'PLANT' end as facility_type, (s_suppkey % 90)::double as latitude, (s_suppkey % 180)::double as longitude from supplier")
def facility_file(spark, sf):
    """S-20: required columns and ranges are checked as the file is read."""
    path, k = place(spark), c("s_suppkey")
    columns = ["facility_id", "facility_type", "latitude", "longitude"]
    sinks.csv(read(spark, sf, "supplier").select(F.concat(F.lit("p"), k).alias("facility_id"), F.when(c("s_nationkey") % 2 == 0, "BALER").otherwise("PLANT").alias("facility_type"), (k % 90).alias("latitude"), (k % 180).alias("longitude")), path, columns)
    return R.facilities(R.csv_text(spark, path, columns))


@query("""with f as (select c_custkey as k, 'a' || c_custkey || chr(10) || 'b' as unix from customer), m as (select k, case k % 5 when 0 then 'MISSING' when 1 then 'MATCH' when 2 then 'POINTER' when 3 then 'MATCH_AFTER_LINE_ENDINGS' else 'MISMATCH' end as status from f)
    select status, count(*) as n, count(*) filter (k % 5 = 2) as stubs from m group by status""")
def artifact_statuses(spark, sf):
    """V-07, A-43, S-23, F-35, K-08: files against a manifest of digests, counted by status."""
    k = c("c_custkey")
    unix = F.concat(F.lit("a"), k, F.lit("\nb"))
    content = F.when(k % 5 == 2, "version https://git-lfs.github.com/spec/v1").when(k % 5 == 3, F.replace(unix, F.lit("\n"), F.lit("\r\n"))).when(k % 5 == 4, "other").otherwise(unix)
    rows = read(spark, sf, "customer").select(k.cast("string").alias("path"), k, unix.alias("unix"), content.cast("binary").alias("content"))
    status = audit.artifact_status(rows.where(k % 5 != 0).select("path", "content"), rows.select("path", F.sha2("unix", 256).alias("sha256")))
    stubs = rows.select("path", R.large_file_stub(c("content")).alias("stub"))
    return status.join(stubs, "path").groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.count_if("stub").alias("stubs"))


@query("""select r.o_orderdate::date as acq_date, round(r.o_custkey / 100.0, 5)::double as latitude, case r.o_orderkey % 3 when 1 then 'NOAA-20' else 'S-NPP' end as sensor from orders r where year(o_orderdate) = 1996 and month(o_orderdate) >= 9 and o_orderkey % 3 <> 0 and o_custkey % 4 <> 0 and o_orderkey % 7 <> 0""")
def season_fires(spark, sf):
    """P-06, P-17: sensor, month, district and type filters, a missing type counting as vegetation."""
    k = c("o_orderkey")
    rows = read(spark, sf, "orders").select(c("o_orderdate").cast("date").alias("acq_date"), (c("o_custkey") / 100).alias("latitude"), F.lit(75.0).alias("longitude"), F.lit("high").alias("confidence_class"), F.lit(1.0).alias("frp"), (c("o_custkey") % 4 != 0).alias("in_district"), F.when(k % 7 == 0, 2).when(k % 2 == 0, 0).alias("type"), F.when(k % 3 == 0, "MODIS").when(k % 3 == 1, "NOAA-20").otherwise("S-NPP").alias("sensor"))
    return fires_of_year(rows, 1996).select("acq_date", "latitude", "sensor")


@query("""select o_orderkey, case o_orderkey % 4 when 0 then 0.0 when 1 then 1.0 when 2 then 2.0 end::double as quality, ceil(o_custkey / 3.0)::bigint as demand_units, floor(o_custkey / 3.0)::bigint as capacity_units, (o_orderkey % 24 * 60 + o_custkey % 60)::integer as minutes, (o_orderkey % 10)::double * 0.04 as area_ha from orders""")
def encodings(spark, sf):
    """F-40, F-41, F-42, F-44."""
    from ..functions.spectral import pixel_area_ha

    k, u = c("o_orderkey"), c("o_custkey")
    quality = F.when(k % 4 == 0, "POOR").when(k % 4 == 1, "LIMITED").when(k % 4 == 2, "GOOD").otherwise("OTHER")
    return read(spark, sf, "orders").select(
        k, N.quality_code(quality).alias("quality"), N.units_up(u / 3, 1.0).alias("demand_units"), N.units_down(u / 3, 1.0).alias("capacity_units"),
        TM.minutes(F.format_string("%02d:%02d", k % 24, u % 60)).alias("minutes"), pixel_area_ha(k % 10).cast("double").alias("area_ha"),
    )


@query(f"""with {OBS}, g as (select event_id, (ts_us - lag(ts_us) over (partition by user_id order by ts_us, event_id)) / 3600000000 as hours from o)
    select event_id, case when hours is null then null when hours <= 14 then 'NORMAL' when hours <= 30 then 'MODERATE' else 'LARGE' end as gap from g""")
def gap_categories(spark, sf):
    """P-12, W-14."""
    from pyspark.sql import Window

    from ..functions.spectral import gap_category

    hours = (c("ts_us") - F.lag("ts_us").over(Window.partitionBy("user_id").orderBy("ts_us", "event_id"))) / 3_600_000_000
    return observations(spark, sf).select("event_id", gap_category(hours).alias("gap"))


@query("select l_suppkey, median(l_quantity)::double as quantity, median(l_discount)::double as discount from lineitem group by l_suppkey")
def medians(spark, sf):
    """A-26."""
    return read(spark, sf, "lineitem").groupBy("l_suppkey").agg(F.median("l_quantity").alias("quantity"), F.median("l_discount").alias("discount"))


def _stream(spark, sf, name: str, columns: list, build, most_files: int = 100):
    """What a stream over files of a table says once all are read: new files in, results to a folder out."""
    source, out, done = place(spark), place(spark), place(spark)
    read(spark, sf, name).select(*columns).write.parquet(source)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.parquet(source).schema)
    built = build(V.new_files(spark, source, schema, most_files))
    shape = built.schema
    built.writeStream.format("parquet").option("path", out).option("checkpointLocation", done).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(shape).parquet(out)


AT = "date_trunc('hour', ts)"


@query(f"select distinct (user_id % 10)::double as latitude, {AT}::timestamp as detected_at, event_type as sensor from events")
def stream_fresh_fires(spark, sf):
    """X-04, X-05: repeated detections of a feed once each, from files as they come."""
    at = F.date_trunc("hour", "ts").cast("timestamp")
    columns = [(c("user_id") % 10).cast("double").alias("latitude"), F.lit(75.0).alias("longitude"), at.alias("detected_at"), c("event_type").alias("sensor"), F.lit("n").alias("confidence")]
    out = _stream(spark, sf, "events", columns, lambda s: V.fresh_fires(s, "4000 days"))
    return out.select("latitude", c("detected_at").cast("timestamp_ntz").alias("detected_at"), "sensor")


SLIDING = """with e as (select user_id % 5 as k, ts, event_id % 9 as v from events), w as (select k, v, ts, unnest(generate_series(0, {n} - 1)) as j from e),
    s as (select k, v, to_timestamp((epoch_us(ts) // 1000000 // {slide} - j) * {slide}) at time zone 'UTC' as start from w where (epoch_us(ts) // 1000000 // {slide} - j) * {slide} + {width} > epoch_us(ts) // 1000000)"""


@query(SLIDING.format(n=3, slide=86400, width=259200) + ", t as (select max(ts) as m from e) select start::timestamp as start, k, sum(v)::bigint as total, count(v) as n from s group by all having start + interval 3 day <= (select m from t) - interval 1 day")
def stream_trailing_sums(spark, sf):
    """X-04, X-07: sums over sliding windows of three days, as far as the watermark has closed them."""
    columns = [(c("user_id") % 5).alias("k"), c("ts").cast("timestamp").alias("at"), (c("event_id") % 9).alias("v")]
    out = _stream(spark, sf, "events", columns, lambda s: V.trailing(s, "k", "v"))
    return out.select(c("window.start").cast("timestamp_ntz").alias("start"), "k", c("total").cast("long").alias("total"), "n")


@query(SLIDING.format(n=2, slide=86400, width=172800).replace("user_id % 5", "user_id % 5") + ", t as (select max(ts) as m from e) select start::timestamp as start, k, count(v) as n from s group by all having count(v) > 10 and start + interval 2 day <= (select m from t) - interval 10 minute")
def stream_attempts(spark, sf):
    """X-04, X-06: who tries too often within a sliding window."""
    columns = [(c("user_id") % 5).cast("string").alias("address"), c("ts").cast("timestamp").alias("at")]
    out = _stream(spark, sf, "events", columns, lambda s: V.attempts(s, 10, "2 days", "1 day"))
    return out.select(c("start").cast("timestamp_ntz").alias("start"), c("address").cast("long").alias("k"), "n")


CASE_SQL = """with o as (
        select (user_id % 400)::varchar as case_id, event_id::varchar as observation_id, ts as seen, timestamp '2024-01-01' + interval 1 day * (user_id % 9) as started, ts + interval 1 hour * (event_id % 7 * 5) + interval 20 hour * (event_id % 29 // 28) - interval 1 hour * (event_id % 83 // 82) as received,
               case when event_type = 'error' and event_id % 31 = 0 then 'UNCLEAR' when event_id % 211 = 0 then 'STRONG' when event_id % 157 = 0 then 'MODERATE' else 'NO_BURN' end as ev, event_id % 401 = 0 as sown from events
    ), e as (select *, seen > received + interval 5 minute as future, seen < started as early from o),
    p as (select *, max(seen) filter (not future and not early) over (partition by case_id order by received, seen, observation_id rows between unbounded preceding and 1 preceding) as last from e),
    a as (select *, case when future then 'FUTURE' when early then 'BEFORE_START' when seen <= last then 'NOT_CHRONOLOGICAL' end as why from p),
    r as (select *, count(*) filter (why is null) over w as n, count(*) filter (why is null and ev = 'STRONG') over w as strong, count(*) filter (why is null and ev in ('UNCLEAR', 'MODERATE')) over w as doubtful, coalesce(bool_or(why is null and sown) over w, false) as any_sown, min(case when why is null then seen end) over w as first, max(case when why is null then seen end) over w as latest
        from a window w as (partition by case_id order by received, seen, observation_id rows between unbounded preceding and current row)),
    s as (select *, latest >= started + interval 10 day as late, n > 1 and epoch_us(latest) - epoch_us(first) >= 6 * 86400000000 as wide from r),
    t as (select *, case when strong > 0 then 'BURN_SIGNAL_DETECTED' when doubtful > 0 then 'MANUAL_REVIEW_REQUIRED' when n >= 3 and wide and (late or any_sown) then 'NO_BURN_VERIFIED' when n > 0 and not coalesce(late, false) then 'MONITORING' else 'INSUFFICIENT_EVIDENCE' end as state from s),
    f as (select *, count(*) filter (state in ('BURN_SIGNAL_DETECTED', 'NO_BURN_VERIFIED')) over (partition by case_id order by received, seen, observation_id rows between unbounded preceding and 1 preceding) > 0 as over_,
            arg_min(state, (received, seen, observation_id)) filter (state in ('BURN_SIGNAL_DETECTED', 'NO_BURN_VERIFIED')) over (partition by case_id) as final, min(n) filter (state in ('BURN_SIGNAL_DETECTED', 'NO_BURN_VERIFIED')) over (partition by case_id) as final_n from t),
    d as (select case_id, arg_max(n, (received, seen, observation_id)) as n, arg_max(strong, (received, seen, observation_id)) as strong, arg_max(doubtful, (received, seen, observation_id)) as doubtful, arg_max(wide, (received, seen, observation_id)) as wide, any_value(started) as started, bool_or(final is not null) as ended from f group by case_id)
    select case_id, observation_id, not over_ and why is null as accepted, case when over_ then 'CASE_ENDED' else why end as reason, case when over_ then final else state end as state, case when over_ then final_n else n end as n from f
    union all select case_id, null, false, 'DEADLINE', case when doubtful > 0 then 'MANUAL_REVIEW_REQUIRED' when n >= 3 and wide then 'NO_BURN_VERIFIED' else 'INSUFFICIENT_EVIDENCE' end, n from d where not ended and started + interval 10 day <= (select max(received) from o) - interval 1 day"""


@query(CASE_SQL)
def case_stream(spark, sf):
    """X-01, X-02, G-09, G-10: observations of cases as they are received, in one run over all that is there; cases past their deadline are judged by the watermark."""
    k, u, h = c("event_id"), c("user_id"), lambda n: F.make_interval(hours=n)
    received = c("ts") + h((k % 7 * 5 + F.when(k % 29 == 28, 20).otherwise(0) - F.when(k % 83 == 82, 1).otherwise(0)).cast("int"))
    blind, strong, moderate = (c("event_type") == "error") & (k % 31 == 0), k % 211 == 0, k % 157 == 0
    change = lambda a, b, z: F.when(strong, a).when(moderate, b).otherwise(z)
    columns = [
        (u % 400).cast("string").alias("case_id"), k.cast("string").alias("observation_id"), c("ts").cast("timestamp").alias("at"), (F.lit("2024-01-01").cast("timestamp_ntz") + F.make_interval(days=(u % 9).cast("int"))).cast("timestamp").alias("started"), received.cast("timestamp").alias("received"),
        F.when(blind, "POOR").otherwise("GOOD").alias("observation_quality"), change(-0.3, -0.16, 0.0).alias("nbr_delta"), change(0.2, 0.11, 0.0).alias("bais2_delta"), change(-0.3, 0.0, 0.0).alias("ndvi_delta"), F.lit(False).alias("fire"), (k % 401 == 0).alias("sown"),
    ]
    with V.keyed_state(spark):
        out = _stream(spark, sf, "events", columns, lambda s: V.cases(s, 10, 3, 6), most_files=1_000_000)
    return out.drop("at")


@query("select event_id, user_id, event_type, ts from events")
def content_increments(spark, sf):
    """S-22, X-04: a feed that delivers some files twice and repeats rows across files is taken once."""
    from ..streaming.ledger import Ledger

    feed, folder = place(spark), place(spark)
    e = read(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    for part, rows in enumerate((e.where("event_type <> 'error'"), e.where("event_type in ('error', 'view')"), e.where("event_type = 'view'"))):
        rows.write.parquet(f"{feed}/{part}")
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz"
    ledger = Ledger(folder, schema)
    for _ in range(2):  # the second run finds nothing new
        ledger.follow(V.new_files(spark, f"{feed}/*", schema), f"{folder}/progress").awaitTermination()
    return ledger.table(spark)


@query("""with m as (select year(o_orderdate)::integer as year, month(o_orderdate)::integer as month, count(*) as n, max(o_orderkey) as latest from orders group by all) select year, month, n, latest, year <= 1997 as cached from m""")
def cached_requests(spark, sf):
    """S-22: requests for months, of which some were answered before."""
    from ..streaming.ledger import cached

    folder, d = place(spark), c("o_orderdate")
    o = read(spark, sf, "orders").select(F.year(d).alias("year"), F.month(d).alias("month"), "o_orderkey")
    asked = o.select("year", "month").distinct()
    answer = lambda wanted: o.join(wanted, ["year", "month"], "left_semi").groupBy("year", "month").agg(F.count(F.lit(1)).alias("n"), F.max("o_orderkey").alias("latest"))
    schema = "year int, month int, n long, latest long"
    cached(asked.where("year <= 1997"), answer, folder, ["year", "month"], schema)
    return cached(asked, answer, folder, ["year", "month"], schema)


@query("""with p as (select p_partkey % 4 as k, p_partkey // 4 // 32 as r, p_partkey // 4 % 32 as col_, p_size::double as a, p_retailprice as b from part where p_partkey // 4 < 32 * 60)
    select k, (r // 3)::bigint as "row", (col_ // 3)::bigint as col, round(avg(a), 6) as size, round(avg(b), 6) as price from p group by k, r // 3, col_ // 3""")
def raster_average(spark, sf):
    """S-07: tables written as tiled rasters and read back as means of three by three pixels, tile by tile."""
    from ..sources.raster import read_raster, write_rasters

    k = F.floor(c("p_partkey") / 4)
    p = read(spark, sf, "part").where(k < 32 * 60).select((c("p_partkey") % 4).alias("k"), F.floor(k / 32).alias("r"), (k % 32).alias("col_"), c("p_size").cast("double").alias("a"), c("p_retailprice").alias("b"))
    paths = write_rasters(p, place(spark), "k", "r", "col_", ["a", "b"], 60, 32, tile=16)
    out = read_raster(spark, paths, factor=3, resampling="average").where(c("bands")[0].isNotNull())
    return out.select(F.regexp_extract("path", r"(\d+)\.tif$", 1).cast("long").alias("k"), "row", "col", F.round(c("bands")[0], 6).alias("size"), F.round(c("bands")[1], 6).alias("price"))


PAINTED = "s as (select c_custkey as k, (c_custkey * 7919 % 10007) / 11.0 + 0.013 as x, (c_custkey * 104729 % 9973) / 11.0 + 0.017 as y, 1 + c_custkey % 7 * 1.9 as r, (1 + c_custkey % 3)::integer as tier from customer)"


@query(f"""with {PAINTED}, p as (select floor(y)::bigint + j as "row", floor(x)::bigint + i as col, tier from s, range(-16, 17) a(i), range(-16, 17) b(j) where abs(floor(x) + i + 0.5 - x) + abs(floor(y) + j + 0.5 - y) < r)
    select "row", col, max(tier)::integer as value from p where "row" between 0 and 899 and col between 0 and 899 group by all""")
def field_painting(spark, sf):
    """K-05, F-45: diamonds of three tiers on a grid of 900 pixels; the SQL tests every pixel's middle."""
    from ..operators.paint import paint, paint_order

    k = c("c_custkey")
    x, y, r = k * 7919 % 10007 / 11 + 0.013, k * 104729 % 9973 / 11 + 0.017, 1 + k % 7 * 1.9
    ring = F.array(*[F.struct((x + dx * r).alias("x"), (y + dy * r).alias("y")) for dx, dy in ((1, 0), (0, 1), (-1, 0), (0, -1))])
    shapes = read(spark, sf, "customer").select(F.array(ring).alias("rings"), F.element_at(F.array(F.lit("CROP"), F.lit("LOOSE"), F.lit("STRICT")), (1 + k % 3).cast("int")).alias("tier"))
    return paint(shapes, "rings", paint_order(c("tier")), 900, 900).select("row", "col", "value")


@query("""select 'optical' as source, count(*) filter (o_orderkey % 5 <> 0) as loaded, count(*) filter (o_orderkey % 5 = 0) as rejected, null::varchar as warning from orders
    union all select 'fires', count(*), 0, null from supplier union all select 'weather', 0, count(*), null from part union all select 'radar', 0, 0, 'radar is unavailable'""")
def demo_acquisition(spark, sf):
    """S-29: four sources as JSON lines, of which one is absent and others hold rows of another type, of none, or that are broken."""
    path, k = place(spark), c("o_orderkey")
    lines = {
        "optical": read(spark, sf, "orders").select(F.when(k % 10 == 0, "{broken").when(k % 5 == 0, F.format_string('{"id":%d}', k)).otherwise(F.format_string('{"id":%d,"dataset_type":"DEMO"}', k)).alias("value")),
        "fires": read(spark, sf, "supplier").select(F.format_string('{"id":%d,"dataset_type":"DEMO"}', c("s_suppkey")).alias("value")),
        "weather": read(spark, sf, "part").select(F.format_string('{"id":%d,"dataset_type":"REAL"}', c("p_partkey")).alias("value")),
    }
    for name, rows in lines.items():
        rows.write.text(f"{path}/{name}")
    names = (*lines, "radar")
    return R.demo_sources(spark, {n: f"{path}/{n}" for n in names}, dict.fromkeys(names, "id long, dataset_type string"))[1]
