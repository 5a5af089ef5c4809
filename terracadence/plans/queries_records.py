"""Registered queries of feature records, event tables, summaries and controls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import spectral as S
from ..functions.numbers import rounded
from ..functions.times import ts_us
from ..operators import aggregates as A
from ..operators import audit, sampling, simulate
from ..operators import windows as W
from ..sources import readers
from . import events as E
from . import features, payloads
from . import panels as P
from .queries_fields import HOURS, hours
from .queries_measures import CLASS, HAZE
from .queries_plans import ROWS, field_dates
from .tables import SPECTRA, points, read, spectra

QUERIES, SQL = {}, {}
c = F.col


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query("""with r as (select c_custkey as id, case when c_custkey % 11 > 0 then c_acctbal / 10000 end as mean, case when c_custkey % 7 > 0 then c_custkey % 40 - 1 end as valid, case when c_custkey % 5 > 0 then 36 end as total, (c_custkey % 9)::bigint as cloud, case when c_custkey % 13 = 0 then c_custkey % 17 / 10 end as given from customer),
    f as (select *, coalesce(valid, 0) as v, coalesce(total, 0) as t, coalesce(given, case when total <> 0 then coalesce(valid, 0) / total end) as vf, case when total <> 0 then cloud / total end as cf from r)
    select id, mean as NDVI_mean, v::bigint as valid_pixel_count, t::bigint as total_pixel_count, vf as valid_pixel_fraction, cf as cloud_fraction, array_to_string(list_filter([case when v < 0 or t < 0 or v > t then 'inconsistent_pixel_counts' end, case when vf not between 0 and 1 then 'invalid_valid_pixel_fraction' end, case when cf not between 0 and 1 then 'invalid_cloud_fraction' end], lambda x: x is not null), '|') as errors from f""")
def reducer_features(spark, sf):
    """A-02: summaries that a server's reducer made, with missing parts and inconsistent counts and shares."""
    k = c("c_custkey")
    indices = F.create_map(F.lit("NDVI"), F.struct(F.when(k % 11 > 0, c("c_acctbal") / 10000).alias("mean"), *[F.lit(None).cast("double").alias(m) for m in features.STATISTICS[1:]]))
    bands = F.create_map(F.lit("B4"), F.struct(F.lit(0.1).alias("mean")))
    s = F.struct(
        indices.alias("indices"), bands.alias("bands"), F.when(k % 7 > 0, k % 40 - 1).alias("valid_pixel_count"), F.when(k % 5 > 0, 36).cast("long").alias("total_pixel_count"), (k % 9).alias("cloud_pixel_count"),
        F.when(k % 13 == 0, k % 17 / 10).alias("valid_pixel_fraction"), F.lit(None).cast("double").alias("cloud_fraction"),
    )
    out = features.reduced_features(read(spark, sf, "customer").select(k.alias("id"), s.cast(features.REDUCED).alias("s")), "s")
    return out.select("id", "NDVI_mean", "valid_pixel_count", "total_pixel_count", "valid_pixel_fraction", "cloud_fraction", F.array_join("errors", "|").alias("errors"))


IMAGES = """b as (select l_orderkey, l_linenumber, l_suppkey % 9 = 0 as cloudy, l_partkey % 8 > 0 as valid, ((l_orderkey * 5 + l_linenumber * 2) % 41)::double / 128 as b4, ((l_orderkey * 13 + l_linenumber * 7) % 41)::double / 128 as b8 from lineitem),
    im as (select 'f' || o_custkey % 60 as field_id, o_orderkey as image, epoch_us(o_orderdate::timestamp) + o_orderkey % 24 * 3600000000 as t from orders),
    px as (select im.field_id, im.image, im.t, b.l_orderkey is not null as there, coalesce(valid and not cloudy, false) as ok, coalesce(cloudy, false) as cloudy, b4, b8 from im left join b on l_orderkey = image),
    op as (select field_id, image, t, count(*) filter (ok) as valid_pixel_count, count(*) filter (there) as total_pixel_count, count(*) filter (cloudy) as clouds, sum(case when ok and b8 + b4 <> 0 then (b8 - b4) / (b8 + b4) end) / count(case when ok and b8 + b4 <> 0 then 1 end) as ndvi from px group by all),
    on_ as (select *, valid_pixel_count / nullif(total_pixel_count, 0) as vf, clouds / nullif(total_pixel_count, 0) as cf from op qualify row_number() over (partition by field_id, t order by image::varchar) = 1),
    sp as (select 'f' || c_custkey % 60 as field_id, c_custkey as pass, epoch_us(timestamp '1995-01-01') + (c_custkey * 7919 % 2400) * 86400000000::bigint as t, -(8 + c_custkey % 5)::double as vv, case when c_custkey % 4 > 0 then -(14 + c_custkey % 7)::double end as vh from customer where c_custkey % 6 > 0 and c_custkey % 5 > 0),
    sa as (select on_.image, max((sp.t, sp.pass::varchar, vv, vh)) as s from on_ join sp on sp.field_id = on_.field_id and sp.t <= on_.t and sp.t >= on_.t - 12 * 86400000000::bigint group by all)"""


@query(f"""with {HOURS}, {IMAGES}, d as (select distinct t from on_), n as (select d.t, max(h.at_us) as seen from d join h on h.at_us <= d.t group by d.t),
    r as (select d.t, n.seen, coalesce(sum(h.rain) filter (h.at_us > d.t - 86400000000), 0) as r24, sum(h.rain) as r72 from d join n using (t) left join h on h.at_us <= d.t and h.at_us > d.t - 259200000000 group by all),
    m as (select d.t, arg_max(h.humidity, h.at_us) as hum from d join h on h.at_us <= d.t and h.humidity is not null group by d.t),
    fi as (select (l_orderkey * 31 % 90000)::double as fx, (l_orderkey * 53 % 89989)::double as fy, epoch_us(l_shipdate::timestamp) as ft from lineitem where l_linenumber = 1),
    fl as (select 'f' || i as field_id, (i * 1370 % 80000)::double + 0.5 as x, (i * 2110 % 80000)::double + 0.5 as y from range(60) t(i)),
    fd as (select on_.image, sqrt(power(greatest(x - fx, 0, fx - x - 300), 2) + power(greatest(y - fy, 0, fy - y - 300), 2)) as d, on_.t - ft as age from on_ join fl using (field_id) join fi on ft <= on_.t),
    ff as (select image, count(*) filter (d = 0) as fires_inside, count(*) filter (d <= 500) as fires_500m, min(d) as nearest, coalesce(bool_or(age <= 72 * 3600000000::bigint) filter (d <= 1000), false) as fire_72h from fd group by image),
    q as (select on_.*, s, seen, case when seen > on_.t - 86400000000 then r24 end as rain_24h, case when seen > on_.t - 259200000000 then r72 end as rain_72h, hum, coalesce(fires_inside, 0) as fires_inside, coalesce(fires_500m, 0) as fires_500m, nearest, coalesce(fire_72h, false) as fire_72h from on_ left join sa using (image) left join r on r.t = on_.t left join m on m.t = on_.t left join ff using (image)),
    g as (select *, list_filter([case when not coalesce(valid_pixel_count > 0, false) then 'no_valid_optical_pixels' end, case when valid_pixel_count > 0 and not coalesce(vf >= 0.5, false) then 'low_valid_pixel_fraction' end, case when cf > 0.5 then 'high_cloud_fraction' end, case when s is null then 's1_missing' end, case when s is not null and s[4] is null then 'vh_missing' end, case when rain_72h is null then 'weather_missing' end], lambda x: x is not null) as flags from q)
    select field_id, image::varchar as source_image_id, valid_pixel_count, total_pixel_count, vf as valid_pixel_fraction, cf as cloud_fraction, round(ndvi, 9) as ndvi_mean, s[2] as source_image_id_s1, round(s[3] - s[4], 9) as vv_minus_vh, rain_24h, rain_72h, hum as last_humidity, fires_inside, fires_500m, round(nearest, 6) as nearest_m, fire_72h,
        case when not coalesce(valid_pixel_count > 0, false) then 'POOR' when len(flags) = 0 then 'GOOD' else 'LIMITED' end as observation_quality, array_to_string(flags, '|') as quality_flags from g""")
def feature_rows(spark, sf):
    """B-01, B-02, P-07, J-09, J-19, W-24: the joined table: images with the latest radar pass, weather and fires up to each, and the quality of all."""
    li, o, k = read(spark, sf, "lineitem"), read(spark, sf, "orders"), c("o_orderkey")
    band = lambda a, b: F.pmod(c("l_orderkey") * a + c("l_linenumber") * b, F.lit(41)).cast("double") / 128
    pixel = F.struct(band(5, 2).alias("B4"), band(13, 7).alias("B8"), *[F.lit(None).cast("double").alias(b) for b in ("B6", "B7", "B8A", "B12")], (c("l_partkey") % 8 > 0).alias("valid"), (c("l_suppkey") % 9 == 0).alias("cloudy"))
    pixels = li.groupBy("l_orderkey").agg(F.collect_list(pixel).alias("pixels"))  # an image's lines
    at = F.timestamp_micros(ts_us(c("o_orderdate").cast("timestamp_ntz")) + k % 24 * 3_600_000_000)
    optical = o.join(pixels, c("l_orderkey") == k, "left").select(F.concat(F.lit("f"), c("o_custkey") % 60).alias("field_id"), k.cast("string").alias("source_image_id"), at.alias("acquisition_datetime"), F.lit(1.0).alias("value_scale"), "pixels")
    u = c("c_custkey")
    passed = F.timestamp_micros(F.unix_micros(F.lit("1995-01-01").cast("timestamp")) + (u * 7919 % 2400) * 86_400_000_000)
    radar = read(spark, sf, "customer").select(
        F.concat(F.lit("f"), u % 60).alias("field_id"), u.cast("string").alias("source_image_id"), passed.alias("acquisition_datetime"), F.when(u % 6 > 0, "IW").otherwise("EW").alias("instrument_mode"), F.when(u % 5 > 0, F.array(F.lit("VV"), F.lit("VH"))).otherwise(F.array(F.lit("HH"))).alias("polarizations"),
        F.array(-(8 + u % 5).cast("double")).alias("VV_dB"), F.when(u % 4 > 0, F.array(-(14 + u % 7).cast("double"))).alias("VH_dB"),
    )
    i = c("id")
    corner = lambda dx, dy: F.struct(((i * 1370 % 80000).cast("double") + 0.5 + dx).alias("x"), ((i * 2110 % 80000).cast("double") + 0.5 + dy).alias("y"))
    names = o.select((c("o_custkey") % 60).alias("id")).distinct()
    fields = names.select(F.concat(F.lit("f"), i).alias("field_id"), F.array(corner(0, 0), corner(300, 0), corner(300, 300), corner(0, 300)).alias("ring"))
    fires = li.where("l_linenumber = 1").select((c("l_orderkey") * 31 % 90000).cast("double").alias("fx"), (c("l_orderkey") * 53 % 89989).cast("double").alias("fy"), ts_us(c("l_shipdate").cast("timestamp_ntz")).alias("fire_us"), F.lit("V").alias("source"))
    out = features.feature_rows({"optical": optical, "radar": radar, "weather": hours(spark, sf), "fires": fires, "fields": fields}, F.unix_micros)
    return out.select(
        "field_id", "source_image_id", "valid_pixel_count", "total_pixel_count", "valid_pixel_fraction", "cloud_fraction", F.round("NDVI_mean", 9).alias("ndvi_mean"), c("s1_source_image_id_s1").alias("source_image_id_s1"), F.round("s1_vv_minus_vh_db", 9).alias("vv_minus_vh"), "rain_24h", "rain_72h", "last_humidity",
        "fires_inside", "fires_500m", F.round("nearest_m", 6).alias("nearest_m"), "fire_72h", "observation_quality", "quality_flags",
    )


EVENT_SQL = f"""with {ROWS},
    e as (select s.field_id, n_usable, peak_ndvi, harvest_date, max(s.date) as last_date, coalesce(min(case when st then struct_pack(d := date, p := pd) end), min(case when lo then struct_pack(d := date, p := pd) end)) as ev, min(case when date = harvest_date then pd end) as green, bool_or(st) as strict, bool_or(lo and not st and coalesce(pn - nbr >= 0.1, false) and coalesce(ph = 'HAZE', false)) as hazed
        from s join g using (field_id) group by all),
    w as (select *, ev.d as burn_date, coalesce(ev.d, harvest_date) as event_date, case when ev is not null then ev.p - 1 else coalesce(green, harvest_date) - 1 end as ws, case when ev is not null then ev.d + 1 else last_date + 1 end as we, p_partkey * 7919 % 1000 * 10.0::double as x, p_partkey * 104729 % 997 * 10.0::double as y from e join part on p_partkey = field_id where peak_ndvi >= 0.6 and harvest_date is not null),
    fi as (select (o_orderkey * 7919 % 1000 * 10)::double as fx, (o_orderkey * 104729 % 997 * 10)::double as fy, cast(o_orderdate as date) as fd, o_orderstatus = 'F' as modis from orders),
    n as (select field_id, count(*) as n, count(*) filter (modis) as n_modis, min(sqrt(power(x - fx, 2) + power(y - fy, 2))) as nearest from w join fi on fd between ws and we and sqrt(power(x - fx, 2) + power(y - fy, 2)) <= 1000 group by field_id),
    v as (select w.*, coalesce(ws >= date '1996-01-01' and we <= date '2000-12-31', false) as covered, n.n, n_modis, nearest, u.hz, u.vf, (select min(date) from u z where z.field_id = w.field_id and z.date > w.event_date) as next_date from w left join n using (field_id) left join u on u.field_id = w.field_id and u.date = w.event_date)
    select field_id, event_date::date as event_date, case when strict then 'STRICT_BURN_CANDIDATE' when burn_date is not null then 'LOOSE_BURN_CANDIDATE' end as burn_tier, ws::date as window_start, we::date as window_end, covered as firms_covered,
        case when covered then coalesce(n, 0) end as firms_detections, case when covered then coalesce(n_modis, 0) end as firms_modis, case when covered then coalesce(nearest <= 500, false) end as firms_within_near, case when covered then round(nearest, 6) end as firms_nearest_m, next_date is null as no_later_image from v"""


@query(EVENT_SQL)
def event_table_rows(spark, sf):
    """B-06, J-18, P-05: harvested crop fields with their windows and the fires in them, as SQL tells it from the bands on."""
    from .queries_plans import event_table

    out = event_table(spark, sf)
    return out.select("field_id", "event_date", "burn_tier", "window_start", "window_end", "firms_covered", "firms_detections", "firms_modis", "firms_within_near", F.round("firms_nearest_m", 6).alias("firms_nearest_m"), c("next_date").isNull().alias("no_later_image"))


@query(f"""with {ROWS}, q as (select field_id, date, case when hz = 'CLEAR' then 'GOOD' when hz = 'HAZE' then 'HAZE_DOWNGRADED' end as hz, nn is null as last_, vf from u) select field_id, date, case when last_ then 'NO_LATER' else '' end || hz as k from q""")
def usable_rows(spark, sf):
    """P-03, P-04, P-10, W-10: the usable rows of every field with their haze class and whether a later image follows."""
    noted = E.annotate(field_dates(spark, sf))
    kind = F.when(c("haze_class") == "CLEAR", "GOOD").when(c("haze_class") == "HAZE_DOWNGRADED", "HAZE_DOWNGRADED")
    return noted.select("field_id", "date", F.concat(F.when(c("next_nbr").isNull(), "NO_LATER").otherwise(""), kind).alias("k"))


@query(f"""with {SPECTRA}, {HAZE}, k as (select h.*, {CLASS} as k, cast(l_shipdate as date) as date from h join lineitem l using (l_orderkey, l_linenumber)),
    s as (select date, l_orderkey % 5 as item, count(*) as n, count(*) filter (k = 'HAZE_DOWNGRADED') as hazy, count(*) filter (k not in ('CLEAR', 'HAZE_DOWNGRADED')) as out_ from k group by all), t as (select year(date)::integer as year, case when out_ / n >= 0.5 then 'EXCLUDED' when hazy / n >= 0.5 then 'HAZE_DOWNGRADED' else 'USABLE' end as status from s)
    select year, count(*) as scenes, count(*) filter (status = 'USABLE') as usable, count(*) filter (status = 'HAZE_DOWNGRADED') as haze_downgraded, count(*) filter (status = 'EXCLUDED') as excluded from t group by year""")
def season_haze(spark, sf):
    """A-12, A-45, P-11: scenes of each season by their status."""
    h = spectra(spark, sf).withColumns({"vf": S.valid_fraction(c("n_valid"), c("n_cloud")), "B02": F.when(c("l_orderkey") % 31 != 0, c("b02"))})
    dates = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.to_date("l_shipdate").alias("date"))
    h = h.withColumn("haze_class", S.haze_class(c("B02"), c("b8a"), c("b12"), c("vf"))).join(dates, ["l_orderkey", "l_linenumber"]).withColumn("item_id", c("l_orderkey") % 5)
    return P.season_haze(P.haze_audit(h))


@query("""with f as (select c_nationkey as zone, c_custkey, case c_custkey % 3 when 0 then 'HARVESTED' when 1 then 'STANDING' end as status, case when c_acctbal > 8000 then 'CRITICAL' when c_acctbal > 5000 then 'HIGH' when c_acctbal > 0 then 'LOW' end as level, (c_custkey % 40)::double as straw_t from customer)
    select count(*) as fields, count(*) filter (status = 'HARVESTED') as harvested, count(*) filter (level in ('HIGH', 'CRITICAL')) as at_risk, sum(straw_t) as straw_t from f""")
def dashboard(spark, sf):
    """A-37: the figures of the overview."""
    k, b = c("c_custkey"), c("c_acctbal")
    f = read(spark, sf, "customer").select(F.when(k % 3 == 0, "HARVESTED").when(k % 3 == 1, "STANDING").alias("status"), F.when(b > 8000, "CRITICAL").when(b > 5000, "HIGH").when(b > 0, "LOW").alias("level"), (k % 40).cast("double").alias("straw_t"))
    return payloads.dashboard(f)


@query("""with s as (select c_custkey as id, (c_custkey * 7919 % 1000)::double * 10 as x, (c_custkey * 104729 % 997)::double * 10 as y, 1000 + c_custkey % 300 as day from customer), f as (select (o_orderkey * 7919 % 1000)::double * 10 as fx, (o_orderkey * 104729 % 997)::double * 10 as fy, 1000 + o_orderkey % 300 as d, o_orderkey % 2 = 0 as fire from orders),
    p as (select id, fire, day - d as age, sqrt(power(x - fx, 2) + power(y - fy, 2)) as m from s join f on day - d between 0 and 30 and sqrt(power(x - fx, 2) + power(y - fy, 2)) <= 1000)
    select s.id, count(*) filter (fire and age < 30) as n_fires, count(*) filter (not fire and age > 0 and m <= 500) as n_burned_pixels from s left join p using (id) group by s.id""")
def reviewer_context(spark, sf):
    """B-13, J-14, J-15: fires within a kilometre and burned pixels within half of it, of the days before."""
    place = lambda t, key: points(spark, sf, t, key).select("id", (c("x") * 10).alias("x"), (c("y") * 10).alias("y"), (1000 + c("id") % 300).alias("day"))
    o = place("orders", "o_orderkey")
    fires, burned = o.where("id % 2 = 0").select(c("x").alias("fx"), c("y").alias("fy"), c("day").alias("fire_day")), o.where("id % 2 = 1").select(c("x").alias("bx"), c("y").alias("by"), c("day").alias("burn_day"))
    out = P.reviewer_context(place("customer", "c_custkey").withColumnRenamed("id", "field_id"), fires, burned)
    return out.select(c("field_id").alias("id"), "n_fires", "n_burned_pixels")


@query("""with s as (select distinct user_id, case when event_type in ('view', 'click') then 'browse' when event_type = 'error' then 'fail' else 'act' end as split from events where user_id % 3 > 0 or event_type = 'view') select x.split as a, y.split as b, count(*) as keys from s x join s y on x.user_id = y.user_id and x.split < y.split group by all""")
def shared_between_splits(spark, sf):
    """U-05: keys that two splits share."""
    e = read(spark, sf, "events").where("user_id % 3 > 0 or event_type = 'view'")
    kind = F.when(c("event_type").isin("view", "click"), "browse").when(c("event_type") == "error", "fail").otherwise("act")
    return audit.shared_keys(e.select("user_id", kind.alias("split")), "user_id", "split")


@query("""with d as (select o_orderkey, o_orderdate::date as day, o_totalprice as v, row_number() over (order by md5(o_orderkey || ':1'), o_orderkey) as slot from orders where o_orderstatus = 'F'), n as (select count(*) as n from d)
    select c_custkey, d.day, d.v from customer, n join d on slot = ('0x' || substr(md5(c_custkey || ':1'), 1, 12))::bigint % n + 1""")
def resampled_control(spark, sf):
    """B-11: every field with the interval of a donor drawn by hash."""
    donors = read(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_orderkey", F.to_date("o_orderdate").alias("day"), c("o_totalprice").alias("v"))
    rows = read(spark, sf, "customer").select("c_custkey", F.lit(None).cast("date").alias("day"), F.lit(None).cast("double").alias("v"))
    return sampling.resampled(rows, "c_custkey", ["day", "v"], donors, "o_orderkey").select("c_custkey", "day", "v")


def _zones_sql(k: int, rounds: int) -> str:
    ctes = ["f as (select c_custkey, (c_custkey * 7919 % 1000)::double as x, (c_custkey * 104729 % 997)::double as y, (1 + c_custkey % 40)::double as w from customer)", f"c0 as materialized (select row_number() over (order by mw desc, mk) - 1 as zone, x, y from (select x, y, max(w) as mw, arg_min(c_custkey, (-w, c_custkey)) as mk from f group by x, y) order by mw desc, mk limit {k})"]
    near = lambda r: f"(select f.*, arg_min(zone, (power(f.x - c.x, 2) + power(f.y - c.y, 2), zone)) as zone from f, c{r} c group by all)"
    for r in range(rounds):
        ctes.append(f"c{r + 1} as materialized (select c.zone, coalesce(m.x, c.x) as x, coalesce(m.y, c.y) as y from c{r} c left join (select zone, sum(w * x) / sum(w) as x, sum(w * y) / sum(w) as y from {near(r)} group by zone) m using (zone))")
    return "with " + ",\n".join(ctes) + f"\nselect c_custkey, zone::integer as zone from {near(rounds)}"


@query(_zones_sql(12, 4))
def weighted_zones(spark, sf):
    """N-02: zones of fields by area-weighted means."""
    p = points(spark, sf, "customer", "c_custkey").select(c("id").alias("c_custkey"), "x", "y", (1 + c("id") % 40).alias("w"))
    return simulate.zones(p, "c_custkey", "x", "y", "w", 12, 4).select("c_custkey", "zone")


def _geodesic_sql() -> str:
    """The inverse series with its rounds written out one after the other."""
    f, a = G.FLATTENING, G.A
    ctes = [f"p as (select c_custkey, 30 + c_custkey % 7 / 10 as lat0, 75 + c_custkey % 5 / 10 as lon0, 30 + c_custkey % 7 / 10 + (c_custkey * 37 % 601 - 300) / 1000 as lat, 75 + c_custkey % 5 / 10 + (c_custkey * 53 % 599 - 299) / 1000 as lon from customer)", f"r0 as (select *, radians(lon - lon0) as turn, radians(lon - lon0) as l, atan((1 - {f}) * tan(radians(lat0))) as u1, atan((1 - {f}) * tan(radians(lat))) as u2 from p)"]
    for k in range(6):
        ctes += [
            f"a{k} as (select c_custkey, lat0, lon0, lat, lon, turn, u1, u2, l, sqrt(power(cos(u2) * sin(l), 2) + power(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l), 2)) as ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(l) as cs from r{k})",
            f"b{k} as (select *, atan2(ss, cs) as sg, case when ss <> 0 then cos(u1) * cos(u2) * sin(l) / ss else 0 end as sa from a{k})",
            f"d{k} as (select *, 1 - sa * sa as ca, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) as cm from b{k})",
            f"e{k} as (select *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) as cc from d{k})",
            f"r{k + 1} as (select c_custkey, lat0, lon0, lat, lon, turn, u1, u2, ss, cs, sg, ca, cm, turn + (1 - cc) * {f} * sa * (sg + cc * ss * (cm + cc * cs * (2 * cm * cm - 1))) as l from e{k})",
        ]
    return "with " + ",\n".join(ctes) + f""",
        q as (select *, ca * (1 / power(1 - {f}, 2) - 1) as q from r6), s as (select *, 1 + q / 16384 * (4096 + q * (q * (320 - 175 * q) - 768)) as big, q / 1024 * (256 + q * (q * (74 - 47 * q) - 128)) as small from q),
        o as (select *, small * ss * (cm + small / 4 * (cs * (2 * cm * cm - 1) - small / 6 * cm * (4 * ss * ss - 3) * (4 * cm * cm - 3))) as off_, atan2(cos(u2) * sin(l), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(l)) as az from s)
        select c_custkey, round({a} * (1 - {f}) * big * (sg - off_) * sin(az), 3) as east, round({a} * (1 - {f}) * big * (sg - off_) * cos(az), 3) as north, round(111.2 * sqrt(power(lat0 - lat, 2) + power((lon0 - lon) * cos(radians(lat0)), 2)), 6) as degree_km from o"""


@query(_geodesic_sql())
def local_projection(spark, sf):
    """F-23, F-26: metres east and north of a centre within some thirty kilometres, and the rough distance by degrees."""
    k = c("c_custkey")
    p = read(spark, sf, "customer").select(k, (30 + k % 7 / 10).alias("lat0"), (75 + k % 5 / 10).alias("lon0"))
    p = p.withColumns({"lat": c("lat0") + (k * 37 % 601 - 300) / 1000, "lon": c("lon0") + (k * 53 % 599 - 299) / 1000})
    x, y = G.local_xy(c("lat"), c("lon"), c("lat0"), c("lon0"))
    return p.select("c_custkey", F.round(x, 3).alias("east"), F.round(y, 3).alias("north"), F.round(G.degree_km(c("lat0"), c("lon0"), c("lat"), c("lon")), 6).alias("degree_km"))


@query("""with o as (select o_custkey as v, count(*) as n, arg_min(o_orderkey, (o_orderdate, o_orderkey)) as a, arg_max(o_orderkey, (o_orderdate, o_orderkey)) as b, max(o_orderdate) as at from orders group by 1)
    select c_custkey as verification_id, n as observations, a as first_image, b as last_image, sha256('{"field_id":"' || c_name || '","first_image":"' || a || '","last_image":"' || b || '","observations":"' || n || '","verification_id":"' || c_custkey || '"}') as sha256 from customer join o on v = c_custkey where c_acctbal > 0""")
def certificates(spark, sf):
    """2.16, G-15, F-34: certificates of the cases that allow one."""
    from ..functions.texts import canonical_hash

    cases = read(spark, sf, "customer").select(c("c_custkey").alias("verification_id"), c("c_name").alias("field_id"), F.when(c("c_acctbal") > 0, "NO_BURN_VERIFIED").otherwise("MONITORING").alias("state"))
    seen = read(spark, sf, "orders").select(c("o_custkey").alias("verification_id"), c("o_orderdate").alias("at"), c("o_orderkey").alias("image"))
    out = payloads.certificates(cases, seen)
    named = ("field_id", "first_image", "last_image", "observations", "verification_id")
    return out.withColumn("sha256", canonical_hash({n: c(n).cast("string") for n in named})).select("verification_id", "observations", "first_image", "last_image", "sha256")


@query("""with o as (select o_orderkey as id, o_orderdate::date - (o_orderkey % 50)::integer as a, o_orderdate::date + (o_orderkey % 30)::integer as b, date '1996-06-15' as t from orders), p as (
        select id, 'archive' as provider, a as from_day, least(b, t - 1) as to_day, 0 as days_missing from o where a < t
        union all select id, 'forecast', greatest(a, t), least(b, t + 15), greatest(b - (t + 15), 0) from o where b >= t and a <= t + 15
        union all select id, 'none', null, null, b - a + 1 from o where a > t + 15)
    select id, provider, from_day, to_day, days_missing::integer as days_missing from p""")
def weather_requests(spark, sf):
    """S-13: the days around each order, asked of the archive or the forecast."""
    k, d = c("o_orderkey"), F.to_date("o_orderdate")
    wanted = read(spark, sf, "orders").select(k.alias("id"), F.date_sub(d, (k % 50).cast("int")).alias("a"), F.date_add(d, (k % 30).cast("int")).alias("b"))
    return readers.provider_requests(wanted, "a", "b", F.lit("1996-06-15").cast("date")).drop("a", "b")


@query("""select c_custkey, (1000 + c_custkey % 4000)::double as km2 from customer where lower(trim('  ' || upper(c_name) || ' ')) = 'customer#000000007'""")
def district_area(spark, sf):
    """S-28: the one area of an accepted name, whatever its case and margins."""
    areas = read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("  "), F.upper("c_name"), F.lit(" ")).alias("name"), (1000 + c("c_custkey") % 4000).cast("double").alias("km2"))
    return readers.one_district(areas, "name", (" Customer#000000007", "customer no. 7"), "km2").select("c_custkey", "km2")


def _intelligence_sql() -> str:
    # Weights of the components, in the published order.
    parts = [("tp", 0.25), ("dry", 0.2), ("fc", 0.15), ("hum", 0.1), ("hist", 0.15), ("bal", 0.05), ("buy", 0.02), ("vol", 0.04), ("near", 0.04)]
    weight = "0.0::double" + "".join(f" + case when {n} is null then 0.0::double else {w}::double end" for n, w in parts)
    total = "0.0::double" + "".join(f" + coalesce({n} * {w}::double, 0.0::double)" for n, w in parts)
    clip = lambda x: f"least(greatest({x}, 0.0::double), 1.0::double)"
    return f"""with {SPECTRA}, l as (select *, row_number() over (partition by l_orderkey order by l_linenumber desc) as n from b),
        r as (select *, case when l_orderkey % 23 <> 0 then b08 end as v, coalesce(-b06 <= -0.25, false) or coalesce(b04 - 0.4 <= -0.2, false) as f, b07 - 0.5 <= -0.15 as nb, b11 - 0.3 >= 0.1 as ba, b04 - 0.4 as dv from l where n = 1),
        s as (select *, case when v is null then null when f and nb and ba then 'BURNT' when f then 'HARVESTED' when dv >= 0.12 and v >= 0.3 then 'SOWN' when v >= 0.55 and dv > -0.15 then 'STANDING' end as status, v is not null and f and nb as moderate from r),
        t as (select *, coalesce(status = 'HARVESTED' and moderate, false) as founded, (n_valid - 2)::double as area, least(greatest(1 + 0.25::double * (b02 - 0.75::double), 0.85::double), 1.1::double) as factor from s),
        e as (select *, case when founded and area > 0 then area * 6.0::double * factor end as tonnes from t),
        p as (select *, case when n_valid % 4 < 2 then {clip("n_cloud / 10.0::double")} end as tp, {clip("1 - (n_cloud / 2.0::double) / 12.0::double")} as dry, case when l_linenumber % 3 <= 1 then {clip("1 - (b12 * 20) / 12.0::double")} end as fc, {clip("(100 - b8a * 100) / 100")} as hum, b02 as hist,
            {clip("(n_cloud * 1000)::double / 20000.0::double")} as bal, case when n_cloud % 2 = 0 then {clip("(n_valid * 1000)::double / 50000.0::double")} end as buy, {clip("tonnes / 20.0::double")} as vol, (l_orderkey % 2 = 0)::integer::double as near from e),
        q as (select *, case when tonnes is null then null else vol end as vol_ from p), z as (select * exclude (vol, vol_), vol_ as vol from q),
        g as (select *, round(({total}) / ({weight}), 9) as score from z)
        select l_orderkey, status, case when moderate then 'MODERATE' else 'LOW' end as band, case when founded and area > 0 then 'PRELIMINARY_ESTIMATE' when founded then 'INSUFFICIENT_INPUT' else 'NOT_ELIGIBLE' end as straw_state, round(tonnes, 6) as tonnes,
        case when founded then 'SCORED' else 'NOT_APPLICABLE_INSUFFICIENT_HARVEST_EVIDENCE' end as risk_state, case when founded then score end as score from g"""


@query(_intelligence_sql())
def field_intelligence(spark, sf):
    """G-05, W-31: the latest row of each field through status, straw and risk. Lines that repeat a number are open in the SQL: the first in the file stays, as with one thread."""
    b = spectra(spark, sf, told=("_file", "_row"))
    last = W.keep_one(b, ["l_orderkey"], [c("l_linenumber").desc(), c("_file"), c("_row")])[0].drop("_file", "_row")
    cloud, key, line, clear = c("n_cloud"), c("l_orderkey"), c("l_linenumber"), c("n_valid")
    rows = last.select(
        "l_orderkey", F.when(key % 23 != 0, c("b08")).alias("NDVI_mean"), (c("b04") - 0.4).alias("NDVI_delta"), (-c("b06")).alias("NDVI_drop_from_peak"), (c("b07") - 0.5).alias("NBR_delta"), (c("b11") - 0.3).alias("BAIS2_delta"), (key % 3 == 0).alias("recent_fire_24h"),
        (clear - 2).cast("double").alias("area_ha"), c("b02").alias("peak_NDVI"), cloud.cast("double").alias("days_since_harvest"), F.when(clear % 4 == 0, "CONFIRMED").when(clear % 4 == 1, "MODEL_INFERRED").when(clear % 4 == 2, "UNKNOWN").alias("harvest_state"),
        (cloud / 2).alias("rain_72h"), (c("b12") * 20).alias("forecast_rain"), (line % 3).alias("forecast_issued"), F.lit(1).alias("observed"), (c("b8a") * 100).alias("humidity_pct"), (cloud * 1000).cast("double").alias("baler_m"), F.when(cloud % 2 == 0, (clear * 1000).cast("double")).alias("buyer_m"),
        c("b02").alias("burn_rate"), (key % 2 == 0).alias("recent_fire_72h"),
    )
    out = payloads.intelligence(rows)
    return out.select("l_orderkey", "status.status", "status.band", c("straw.state").alias("straw_state"), rounded(c("straw.estimate_t"), 6).alias("tonnes"), "risk_state", rounded(c("risk.score"), 9).alias("score"))
