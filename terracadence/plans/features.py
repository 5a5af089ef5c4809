"""Feature rows (B-01, B-02) and the geometry pipeline (B-12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions import spectral as S
from ..functions.texts import reasons, sorted_set
from ..operators.aggregates import db_array_summary, number_stats
from ..operators.joins import asof
from ..operators.pyramid import nearest_before
from ..operators.simulate import spread
from ..operators.windows import keep_one
from ..sources.staging import staged

HOUR_US = 3_600_000_000


def optical_features(optical: DataFrame) -> DataFrame:
    """A-01: index statistics of the valid, cloudless pixels of each image, with counts and shares."""
    px = optical.select("field_id", "source_image_id", "acquisition_datetime", F.coalesce("value_scale", F.lit(1.0)).alias("k"), F.explode_outer("pixels").alias("p"))
    ok = F.coalesce(F.col("p.valid"), F.lit(True)) & ~F.coalesce(F.col("p.cloudy"), F.lit(False)) & F.col("p").isNotNull()
    b = lambda n: F.when(ok, F.col(f"p.{n}") * F.col("k"))
    stats = number_stats(S.ndvi(b("B8"), b("B4")), "NDVI") + number_stats(S.nbr(b("B8A"), b("B12")), "NBR") + number_stats(S.bais2_strict(b("B4"), b("B6"), b("B7"), b("B8A"), b("B12")), "BAIS2")
    rows = px.groupBy("field_id", "source_image_id", "acquisition_datetime").agg(F.count_if(ok).alias("valid_pixel_count"), F.count("p").alias("total_pixel_count"), F.count_if(F.col("p.cloudy")).alias("_c"), *stats)
    return rows.withColumns({"valid_pixel_fraction": F.try_divide("valid_pixel_count", "total_pixel_count"), "cloud_fraction": F.try_divide("_c", "total_pixel_count")}).drop("_c")


STATISTICS = ("mean", "median", "std", "min", "max")
REDUCED = "struct<indices:map<string,struct<mean:double,median:double,std:double,min:double,max:double>>,bands:map<string,struct<mean:double>>,valid_pixel_count:bigint,total_pixel_count:bigint,cloud_pixel_count:bigint,valid_pixel_fraction:double,cloud_fraction:double>"


def reduced_features(rows: DataFrame, statistics: str, indices: tuple[str, ...] = ("NDVI", "NBR", "BAIS2"), bands: tuple[str, ...] = ()) -> DataFrame:
    """A-02: what a server's reducer already summed up (a column of type REDUCED), in the columns of optical_features, with what is inconsistent about it in errors.

    Missing counts are 0; missing shares come from the counts where there is a total, else stay NULL; values that are not
    finite are NULL. Rows with errors are kept, marked: counts below 0 or more valid pixels than pixels, and shares
    outside 0 to 1.
    """
    from ..functions.numbers import finite

    s = F.col(statistics)
    whole = lambda n: F.coalesce(s[n], F.lit(0).cast("long"))
    share = lambda given, part: F.coalesce(s[given], F.when(s["total_pixel_count"] != 0, part / s["total_pixel_count"]))
    out = rows.withColumns({f"{i}_{m}": finite(s["indices"][i][m]) for i in indices for m in STATISTICS} | {f"{b}_mean": finite(s["bands"][b]["mean"]) for b in bands})
    out = out.withColumns({"valid_pixel_count": whole("valid_pixel_count"), "total_pixel_count": whole("total_pixel_count"), "valid_pixel_fraction": share("valid_pixel_fraction", whole("valid_pixel_count")), "cloud_fraction": share("cloud_fraction", whole("cloud_pixel_count"))})
    odd = (F.col("valid_pixel_count") < 0) | (F.col("total_pixel_count") < 0) | (F.col("valid_pixel_count") > F.col("total_pixel_count"))
    outside = lambda n: F.col(n).isNotNull() & ~F.coalesce(F.col(n).between(0, 1), F.lit(False))
    return out.withColumn("errors", reasons([(odd, "inconsistent_pixel_counts"), (outside("valid_pixel_fraction"), "invalid_valid_pixel_fraction"), (outside("cloud_fraction"), "invalid_cloud_fraction")]))


#: Width of the time buckets that spread rows over tasks where there is one series only.
BUCKET_US = 7 * 24 * HOUR_US


def _carried(series: DataFrame, wanted: DataFrame, columns: list[str]) -> DataFrame:
    """series in buckets of time (_k), each bucket that is wanted also holding the last row before it, so that a bucket can be looked up alone."""
    from pyspark.sql import Window

    own = series.select(F.floor(F.col("at_us") / BUCKET_US).alias("_k"), "at_us", *columns)
    last = own.groupBy("_k").agg(F.max(F.struct("at_us", *columns)).alias("last"))
    # a row for each week: bounded by the time the tables span
    marks = last.unionByName(wanted.join(last, "_k", "left_anti"), allowMissingColumns=True)
    before = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    marks = marks.withColumn("held", F.last("last", ignorenulls=True).over(before)).where(F.col("held").isNotNull())
    return own.unionByName(marks.select("_k", "held.*"))


def weather_features(rows: DataFrame, weather: DataFrame, ts: str = "ts_us", hours: tuple[int, ...] = (24, 72)) -> DataFrame:
    """B-02: sums of rain over trailing hours (t - h, t], and the last value of each other measure that is not missing at or before t.

    weather: at_us, rain and measures, of the nodes in the column node that rows name too, or of one series. Rain comes
    from an hourly prefix sum and as-of lookups, so no row meets hours one by one; a single series is cut into buckets
    of time, so its rows do not meet in one task.
    """
    from pyspark.sql import Window

    nodes = "node" in weather.columns
    rows = rows if nodes else staged(rows)  # each lookup asks for the buckets of all rows
    hourly = Window.partitionBy("node").orderBy("at_us") if nodes else Window.orderBy("at_us")  # one series is as long as its hours
    run = weather.withColumn("rain_sum", F.sum(F.coalesce("rain", F.lit(0.0))).over(hourly.rangeBetween(Window.unboundedPreceding, 0)))
    measures = [c for c in weather.columns if c not in ("at_us", "rain", "node")]

    def lookup(out: DataFrame, series: DataFrame, at: str, column: str, prefix: str, back_us: int = 0) -> DataFrame:
        if nodes:
            return asof(out, series, ["node"], at, "at_us", [column], prefix=prefix)
        wanted = rows.select(F.floor((F.col(ts) - back_us) / BUCKET_US).alias("_k")).distinct()
        out = out.withColumn("_k", F.floor(F.col(at) / BUCKET_US))
        return asof(out, _carried(series, wanted, [column]), ["_k"], at, "at_us", [column], prefix=prefix).drop("_k")

    out = lookup(rows, run, ts, "rain_sum", "now_")
    for h in hours:
        out = lookup(out.withColumn("_back", F.col(ts) - h * HOUR_US), run, "_back", "rain_sum", "back_", h * HOUR_US)
        out = out.withColumn(f"rain_{h}h", F.when(F.col("now_ts") > F.col("_back"), F.col("now_rain_sum") - F.coalesce("back_rain_sum", F.lit(0.0)))).drop("_back", "back_ts", "back_rain_sum")
    for m in measures:
        out = lookup(out, weather.where(F.col(m).isNotNull()), ts, m, "last_").drop("last_ts")
    return out.drop("now_ts", "now_rain_sum")


def fire_features(rows: DataFrame, fires: DataFrame, row_id: str, ring: str, buffers_m: tuple[float, ...] = (500.0, 1000.0)) -> DataFrame:
    """J-19: detections up to t inside the polygon and within each buffer of it, the nearest however far, recent ones within the largest, and their sources.

    Each polygon covers the grid cells of its own box, widened by the largest buffer; fires are joined by their cell and
    the exact distance to the polygon decides. Polygons without a fire in the largest buffer look further through a
    pyramid of cells. rows: ring in metres, ts_us; fires: fx, fy, fire_us, source. Without a ring counts are 0 and the
    nearest is NULL.
    """
    widest = max(buffers_m)
    cell = lambda v: F.floor(v / (2 * widest)).cast("long")
    span = lambda k: F.sequence(cell(F.array_min(F.transform(ring, lambda p: p[k])) - widest), cell(F.array_max(F.transform(ring, lambda p: p[k])) + widest))
    c = F.col
    ends = {f"_{k}{i}": f(F.transform(ring, lambda p: p[k])) for k in "xy" for i, f in enumerate((F.array_min, F.array_max))}  # noqa: B023
    left = rows.select(row_id, ring, "ts_us", F.explode(span("x")).alias("gx"), span("y").alias("ys"), G.upright(c(ring)).alias("_box"), *[v.alias(n) for n, v in ends.items()]).withColumn("gy", F.explode("ys")).drop("ys")
    left = left.withColumn(ring, F.when(~c("_box"), c(ring)))
    right = fires.select("fx", "fy", "fire_us", "source", cell(c("fx")).alias("gx"), cell(c("fy")).alias("gy"))
    # no polygon is nearer than its box, and an upright rectangle is its box
    gap = lambda k: F.greatest(c(f"_{k}0") - c(f"f{k}"), F.lit(0.0), c(f"f{k}") - c(f"_{k}1"))
    box = F.sqrt(F.pow(gap("x"), 2) + F.pow(gap("y"), 2))
    pairs = spread(left, "gx", "gy").join(spread(right, "gx", "gy"), ["gx", "gy"]).where((c("fire_us") <= c("ts_us")) & (box <= widest * (1 + 1e-9)))
    pairs = pairs.withColumn("d", F.when(c("_box"), box).otherwise(G.polygon_distance(c("fx"), c("fy"), c(ring)))).where(c("d") <= widest)
    within = [f"fires_{int(b)}m" for b in buffers_m]
    # by source first: only measures of fixed width, so that pairs are not sorted
    parts = pairs.groupBy(row_id, "source", "ts_us").agg(F.count_if(c("d") == 0).alias("fires_inside"), *[F.count_if(c("d") <= b).alias(n) for b, n in zip(buffers_m, within, strict=True)], F.min("d").alias("_near"), F.max("fire_us").alias("_last"))
    age = c("ts_us") - c("_last")
    counts = parts.groupBy(row_id).agg(
        *[F.sum(n).alias(n) for n in ("fires_inside", *within)], F.min("_near").alias("_near"),
        F.bool_or(age <= 24 * HOUR_US).alias("fire_24h"), F.bool_or(age <= 72 * HOUR_US).alias("fire_72h"), sorted_set("source").alias("fire_sources"),
    )
    out = staged(rows.join(counts, row_id, "left"))
    side = lambda f, k: f(F.transform(ring, lambda p: p[k]))
    box = (side(F.array_min, "x"), side(F.array_min, "y"), side(F.array_max, "x"), side(F.array_max, "y"))
    corner = (F.get(F.col(ring), F.lit(0))["x"], F.get(F.col(ring), F.lit(0))["y"])
    further = nearest_before(out.where("_near is null").select(row_id, ring, "ts_us"), fires, row_id, box, corner, ("fx", "fy"), lambda x, y: G.polygon_distance(x, y, F.col(ring)), (ring,), "ts_us", "fire_us", "_far")
    out = out.join(further.select(row_id, "_far"), row_id, "left").withColumn("nearest_m", F.coalesce("_near", "_far")).drop("_near", "_far")
    zero = F.lit(0).cast("long")
    return out.withColumns({c: F.coalesce(c, zero) for c in ("fires_inside", *[f"fires_{int(b)}m" for b in buffers_m])} | {c: F.coalesce(c, F.lit(False)) for c in ("fire_24h", "fire_72h")})


def fixture_quality(n_valid, fraction, cloud, has_radar, has_vh, has_weather, has_fires):
    """P-07: struct of quality and flags."""
    off = lambda c: ~F.coalesce(c, F.lit(False))
    empty = off(n_valid > 0)
    flags = reasons([
        (empty, "no_valid_optical_pixels"), (~empty & off(fraction >= 0.5), "low_valid_pixel_fraction"), (cloud > 0.5, "high_cloud_fraction"), (off(has_radar), "s1_missing"),
        (has_radar & off(has_vh), "vh_missing"), (off(has_weather), "weather_missing"), (off(has_fires), "firms_unavailable"),
    ])
    quality = F.when(empty, "POOR").when(F.size(flags) == 0, "GOOD").otherwise("LIMITED")
    return F.struct(quality.alias("quality"), F.array_join(flags, "|").alias("flags"))


def feature_rows(bundle: dict[str, DataFrame], to_us, max_age_us: int = 12 * 24 * HOUR_US) -> DataFrame:
    """B-01: one row per field and image: optical statistics, the latest vertical radar pass within the tolerance, weather and fires up to the image, and the quality of all.

    bundle: optical and radar; weather (at_us, rain, measures) and fires with fields (field_id, ring in metres) where
    there are any, what is missing being flagged. to_us: Column -> microseconds. Of images of one field and instant the
    first stays (W-24).
    """
    rows = optical_features(bundle["optical"]).withColumn("ts_us", to_us(F.col("acquisition_datetime")))
    rows, _ = keep_one(rows, ["field_id", "ts_us"], [F.col("source_image_id")])
    radar = bundle["radar"].where((F.col("instrument_mode") == "IW") & F.array_contains("polarizations", "VV")).withColumn("s1_us", to_us(F.col("acquisition_datetime")))
    radar = radar.withColumns(db_array_summary(F.col("VV_dB"), F.col("VH_dB"))).withColumnRenamed("source_image_id", "source_image_id_s1")
    out = asof(rows, radar, ["field_id"], "ts_us", "s1_us", ["source_image_id_s1", "vv_mean_db", "vh_mean_db", "vv_minus_vh_db", "vv_vh_ratio_linear"], max_age_us, tie="source_image_id_s1", prefix="s1_")
    has_weather = has_fires = F.lit(False)
    if (weather := bundle.get("weather")) is not None:
        out = weather_features(out, weather)
        has_weather = F.col("rain_72h").isNotNull()
    if (fires := bundle.get("fires")) is not None:
        out = fire_features(out.join(bundle["fields"].select("field_id", "ring"), "field_id", "left"), fires, "source_image_id", "ring").drop("ring")
        has_fires = F.lit(True)
    q = fixture_quality(F.col("valid_pixel_count"), F.col("valid_pixel_fraction"), F.col("cloud_fraction"), F.col("s1_ts").isNotNull(), F.col("s1_vh_mean_db").isNotNull(), has_weather, has_fires)
    return out.withColumn("_q", q).withColumns({"observation_quality": F.col("_q.quality"), "quality_flags": F.col("_q.flags")}).drop("_q")


def checked_fields(raw: DataFrame, least_ha: float = 0.2, most_ha: float = 15.0) -> tuple[DataFrame, DataFrame]:
    """B-12, P-14, F-25, F-28: fields (field_id, ring of lon/lat) with projected ring, area and centre, and those with issues.

    Issues: missing id, repeated id, repeated shape, too few corners, coordinates out of range, an edge that crosses another, no
    area, area outside the limits.
    """
    from pyspark.sql import Window

    ring = F.col("ring")
    point = lambda p: F.struct(*[v.alias(n) for v, n in zip(G.utm_xy(p["y"], p["x"]), "xy", strict=True)])
    df = raw.withColumn("xy", F.transform(ring, point)).withColumn("area_ha", F.abs(G.ring_area(F.col("xy"))) / 10_000)
    cx, cy = G.ring_centroid(F.col("xy"))
    df = df.withColumns({"cx": cx, "cy": cy, "_shape": F.md5(F.to_json(F.sort_array(F.array_distinct(ring))))})
    outside = F.exists(ring, lambda p: ~p["x"].between(-180, 180) | ~p["y"].between(-90, 90) | p["x"].isNull() | p["y"].isNull())
    df = df.withColumn("issues", reasons([
        (F.col("field_id").isNull() | (F.trim("field_id") == ""), "ID_MISSING"), (F.col("field_id").isNotNull() & (F.count(F.lit(1)).over(Window.partitionBy("field_id")) > 1), "ID_REPEATED"),
        (F.row_number().over(Window.partitionBy("_shape").orderBy("field_id")) > 1, "SHAPE_REPEATED"), (F.size(F.array_distinct(ring)) < 3, "TOO_FEW_CORNERS"),
        (outside, "COORDINATES_OUT_OF_RANGE"), (crosses_itself(F.col("xy")), "CROSSES_ITSELF"), (F.col("area_ha") <= 1e-6, "NO_AREA"), (~F.col("area_ha").between(least_ha, most_ha), "AREA_OUTSIDE_LIMITS"),
    ])).drop("_shape")
    return df.where(F.size("issues") == 0).drop("issues"), df.where(F.size("issues") > 0)


def crosses_itself(ring):
    """F-28: whether two edges that do not share a corner cross properly."""
    edges = G._edges(ring)
    side = lambda a, b, p: (b["x"] - a["x"]) * (p["y"] - a["y"]) - (b["y"] - a["y"]) * (p["x"] - a["x"])
    crossing = lambda e, f: (side(e["a"], e["b"], f["a"]) * side(e["a"], e["b"], f["b"]) < 0) & (side(f["a"], f["b"], e["a"]) * side(f["a"], f["b"], e["b"]) < 0)
    return F.exists(edges, lambda e: F.exists(edges, lambda f: F.coalesce(crossing(e, f), F.lit(False))))


def overlapping(fields: DataFrame, least_m2: float = 1.0, cell_m: float = 500.0) -> DataFrame:
    """J-22: pairs of fields whose polygons overlap by more than least_m2, cut exactly (convex clipping side by side).

    Polygons meet in the grid cells of their boxes; a pair is looked at in the cell where the boxes' intersection
    begins, so once. Two upright rectangles are their boxes, whose intersection needs no clipping.
    """
    from ..functions.clip import overlap_area

    c = F.col
    low = lambda k: F.array_min(F.transform("xy", lambda p: p[k]))
    high = lambda k: F.array_max(F.transform("xy", lambda p: p[k]))
    cell = lambda v: F.floor(v / cell_m).cast("long")
    slim = fields.select("field_id", "xy", low("x").alias("x0"), high("x").alias("x1"), low("y").alias("y0"), high("y").alias("y1"))
    slim = slim.withColumn("_box", G.upright(c("xy")))
    boxes, others, everything = slim.where("_box").drop("_box", "xy"), slim.where("not _box").drop("_box"), slim.drop("_box")

    def met(a: DataFrame, b: DataFrame) -> DataFrame:
        laid = lambda df: spread(df.withColumn("gx", F.explode(F.sequence(cell(c("x0")), cell(c("x1"))))).withColumn("gy", F.explode(F.sequence(cell(c("y0")), cell(c("y1"))))), "gx", "gy")
        a, b = laid(a).alias("a"), laid(b).alias("b")
        begins = (c("a.gx") == cell(F.greatest("a.x0", "b.x0"))) & (c("a.gy") == cell(F.greatest("a.y0", "b.y0")))
        overlap = (c("a.x0") <= c("b.x1")) & (c("b.x0") <= c("a.x1")) & (c("a.y0") <= c("b.y1")) & (c("b.y0") <= c("a.y1"))
        return a.join(b, (c("a.gx") == c("b.gx")) & (c("a.gy") == c("b.gy")) & (c("a.field_id") < c("b.field_id")) & overlap & begins)

    names = c("a.field_id").alias("field_id"), c("b.field_id").alias("other_id")
    side = lambda k: F.least(f"a.{k}1", f"b.{k}1") - F.greatest(f"a.{k}0", f"b.{k}0")
    plain = met(boxes, boxes).select(*names, (side("x") * side("y")).alias("overlap_m2"))
    rings = c("a.xy").alias("xy"), c("b.xy").alias("oxy")
    pairs = met(others, everything).select(*names, *rings).unionByName(met(slim.where("_box").drop("_box"), others).select(*names, *rings))
    cut = pairs.withColumn("overlap_m2", overlap_area("xy", "oxy"))
    return plain.unionByName(cut.select("field_id", "other_id", "overlap_m2")).where(c("overlap_m2") > least_m2)
