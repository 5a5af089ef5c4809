"""Sources (S-01 to S-29) as schema-checked readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import finite
from ..functions.times import at_clock

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])


def geojson(spark: SparkSession, path: str, properties: str) -> DataFrame:
    """S-01: features of a collection: properties (SQL struct fields), kind and rings; a multi-polygon gives its outer rings in turn."""
    polygon = "array<array<array<double>>>"
    schema = f"type string, features array<struct<properties: struct<{properties}>, geometry: struct<type: string, coordinates: string>>>"
    rows = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("features").alias("f"))
    one, many = F.from_json("f.geometry.coordinates", polygon), F.from_json("f.geometry.coordinates", f"array<{polygon}>")
    polygons = F.when(F.col("f.geometry.type") == "Polygon", F.array(one)).when(F.col("f.geometry.type") == "MultiPolygon", many)
    rings = F.transform(polygons, lambda p: F.transform(p[0], lambda c: F.struct(c[0].alias("x"), c[1].alias("y"))))
    return rows.select("f.properties.*", F.col("f.geometry.type").alias("geometry_type"), rings.alias("rings"))


BUNDLE = (
    "fixture_type string, firms_source string, weather_source string, source_availability struct<firms: boolean, weather: boolean>, "
    "s2_observations array<struct<field_id: string, source_image_id: string, collection: string, acquisition_datetime: string, value_scale: double, "
    "pixels: array<struct<B2: double, B3: double, B4: double, B6: double, B7: double, B8: double, B8A: double, B11: double, B12: double, cloudy: boolean, valid: boolean>>>>, "
    "s1_observations array<struct<field_id: string, source_image_id: string, acquisition_datetime: string, instrument_mode: string, orbit_pass: string, relative_orbit_number: int, polarizations: array<string>, VV_dB: array<double>, VH_dB: array<double>>>, "
    "firms_points array<struct<latitude: double, longitude: double, acquisition_datetime: string, source: string>>, "
    "weather_records array<struct<timestamp: string, precipitation_mm: double, humidity_pct: double, temperature_c: double, wind_speed: double, source: string, record_type: string, forecast_issued_at: string>>"
)


def bundle(spark: SparkSession, path: str, kinds: tuple[str, ...] = ("synthetic",)) -> dict[str, DataFrame]:
    """S-02: the four tables of an observation bundle; a bundle of another kind fails when read."""
    raw = spark.read.schema(BUNDLE).json(path, multiLine=True)
    gate = F.assert_true(F.coalesce(F.col("fixture_type").isin(*kinds), F.lit(False)), F.lit("bundle of another kind"))
    raw = raw.where(gate.isNull())
    table = lambda c: raw.select(F.explode(c).alias("r")).select("r.*")
    return {"optical": table("s2_observations"), "radar": table("s1_observations"), "fires": table("firms_points"), "weather": table("weather_records")}


def csv_text(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S-03: all columns as text; a header that differs fails the read."""
    return spark.read.schema(T.StructType([T.StructField(c, T.StringType()) for c in columns])).csv(path, header=True, enforceSchema=False, mode="FAILFAST")


def parquet(spark: SparkSession, path: str, columns: list[str] | None = None, where: Column | None = None) -> DataFrame:
    """S-04 to S-06: columns and filters reach the scan; a folder per season is one table."""
    df = spark.read.parquet(path)
    df = df if where is None else df.where(where)
    return df.select(*columns) if columns else df


def block_average(pixels: DataFrame, keys: list[str], row: str, col: str, k: int, bands: list[str]) -> DataFrame:
    """S-07: k x k pixels to their mean."""
    return pixels.groupBy(*keys, F.floor(F.col(row) / k).alias(row), F.floor(F.col(col) / k).alias(col)).agg(*[F.avg(b).alias(b) for b in bands])


def latest_processing(scenes: DataFrame, sensed: str, item: str, cloud: str, most_cloud: float = 90.0) -> DataFrame:
    """S-09: per sensing time the last item id, cloud cover permitting."""
    from ..operators.windows import top_per_group

    return top_per_group(scenes.where(F.col(cloud) <= most_cloud), [sensed], [F.col(item).desc()], 1)


def clearest(scenes: DataFrame, keys: list[str], cloud: str, item: str) -> DataFrame:
    """W-22: per day and tile (or season bin) the scene with the least cloud, missing cover last."""
    from ..operators.windows import top_per_group

    return top_per_group(scenes, keys, [F.col(cloud).asc_nulls_last(), F.col(item)], 1)


def request_chunks(periods: DataFrame, first: str, last: str, days: int = 5) -> DataFrame:
    """S-10: each row's period in closed spans of at most days days, in columns start and end; periods that end before they begin give none."""
    starts = F.sequence(F.col(first).cast("date"), F.col(last).cast("date"), F.make_interval(days=F.lit(days)))
    rows = periods.where(F.col(first) <= F.col(last)).withColumn("start", F.explode(starts))
    return rows.withColumn("end", F.least(F.date_add("start", days - 1), F.col(last).cast("date")))


def fire_rows(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-11: normalised detections and rejects (with reason) of text rows latitude, longitude, acq_date, acq_time, confidence, source."""
    from ..operators.joins import split_by_reason
    from ..operators.windows import keep_one

    df = raw.toDF(*[c.lower() for c in raw.columns])
    df = df.withColumns({"latitude": finite("latitude"), "longitude": finite("longitude"), "detected_at": at_clock(F.col("acq_date"), F.col("acq_time")), "confidence_pct": finite("confidence")})
    df = df.withColumn("confidence_class", F.when(F.col("confidence_pct").isNull(), F.lower(F.trim("confidence"))))
    good, bad = split_by_reason(df, [(F.col("latitude").isNull() | F.col("longitude").isNull(), "COORDINATES_MISSING"), (~F.col("latitude").between(-90, 90) | ~F.col("longitude").between(-180, 180), "COORDINATES_OUT_OF_RANGE"), (F.col("detected_at").isNull(), "TIME_NOT_VALID")])
    key = ["latitude", "longitude", "detected_at", "source", "confidence"]
    return keep_one(good, key, [F.col("acq_date")])[0], bad


def confidence_class(sensor: Column, raw: Column) -> Column:
    """F-21: letters of one family of sensors, percent bands of the other."""
    pct = finite(raw)
    letters = F.when(F.lower(raw) == "l", "low").when(F.lower(raw) == "n", "nominal").when(F.lower(raw) == "h", "high")
    return F.when(sensor == "MODIS", F.when(pct < 30, "low").when(pct < 80, "nominal").when(pct <= 100, "high")).otherwise(letters)


def parallel_arrays(df: DataFrame, keys: list[str], arrays: list[str]) -> DataFrame:
    """S-12: one row per index of parallel arrays; shorter ones give NULLs."""
    return df.select(*keys, F.explode(F.arrays_zip(*arrays)).alias("r")).select(*keys, "r.*")


def epoch_ms(c: Column) -> Column:
    """S-14."""
    return F.to_utc_timestamp(F.timestamp_millis(c), F.current_timezone()).cast("timestamp_ntz")


def union_archives(tables: list[DataFrame]) -> DataFrame:
    """S-16 to S-18, U-01: tables of differing columns on top of each other."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def whitespace_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """S-16: columns separated by white space; a first row that repeats the names is skipped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.trim("value") != "").select(*[F.get(parts, i).alias(c) for i, c in enumerate(columns)])
    return rows.where(F.coalesce(F.lower(columns[0]) != columns[0].lower(), F.lit(True)))


def sensor_of_file(path: Column) -> Column:
    """S-17."""
    return F.when(path.rlike(r"(?i)modis"), "MODIS").when(path.rlike(r"(?i)j1|noaa-?20"), "NOAA-20").when(path.rlike(r"(?i)suomi|snpp"), "S-NPP")


def burned_pixels(pixels: DataFrame, doy: str, year: str, first: int, last: int) -> DataFrame:
    """S-19: pixels with a burn day inside the product's window, as dates."""
    from ..functions.times import date_of

    return pixels.where(F.col(doy).between(first, last)).withColumn("burn_date", date_of(F.col(year), F.col(doy)))


def facilities(raw: DataFrame) -> DataFrame:
    """S-20: required values present and coordinates in range; anything else fails."""
    bad = raw.where(F.col("facility_id").isNull() | F.col("facility_type").isNull() | ~F.coalesce(finite("latitude").between(-90, 90) & finite("longitude").between(-180, 180), F.lit(False))).limit(1).collect()
    if bad:
        raise ValueError(f"facility {bad[0]['facility_id']} is not complete")
    return raw.withColumns({"latitude": finite("latitude"), "longitude": finite("longitude")})


def large_file_stub(content: Column) -> Column:
    """S-23."""
    return F.substring(content.cast("string"), 1, 24) == "version https://git-lfs."


def pass_metadata(items: DataFrame, item: str) -> DataFrame:
    """S-24, F-33: platform, mode and times from radar item ids; slices of a pass as one row."""
    pattern = r"^(S1[A-D])_([A-Z0-9]{2})_[A-Z0-9]+_[A-Z0-9]+_(\d{8}T\d{6})_(\d{8}T\d{6})"
    part = lambda k: F.regexp_extract(item, pattern, k)
    rows = items.where(F.col(item).rlike(pattern)).select(part(1).alias("platform"), part(2).alias("mode"), F.try_to_timestamp(part(3), F.lit("yyyyMMdd'T'HHmmss")).alias("s"), F.try_to_timestamp(part(4), F.lit("yyyyMMdd'T'HHmmss")).alias("e"))
    return rows.groupBy("platform", "mode", F.to_date("s").alias("day")).agg(F.min("s").alias("start"), F.max("e").alias("end"), F.count(F.lit(1)).alias("slices"))


def grid_nodes(boxes: DataFrame, step: float) -> DataFrame:
    """S-25: nodes (longitude, latitude) of a regular grid whose cells meet each row's box (west, south, east, north)."""
    c, half = F.col, step / 2
    axis = lambda a, b: F.sequence(F.floor(c(a) / step - 0.5).cast("long"), F.ceil(c(b) / step + 0.5).cast("long"))
    nodes = boxes.where("west <= east and south <= north").withColumn("_i", F.explode(axis("west", "east"))).withColumn("_j", F.explode(axis("south", "north")))
    nodes = nodes.withColumns({"longitude": c("_i") * step, "latitude": c("_j") * step}).drop("_i", "_j")
    return nodes.where((c("longitude") + half >= c("west")) & (c("longitude") - half <= c("east")) & (c("latitude") + half >= c("south")) & (c("latitude") - half <= c("north")))


def in_season(scenes: DataFrame, day: str, seasons: dict[int, tuple[str, str]]) -> DataFrame:
    """S-27: scenes within their season's dates, with the season."""
    season = F.lit(None).cast("int")
    for year, (a, b) in seasons.items():
        season = F.when(F.col(day).between(F.lit(a).cast("date"), F.lit(b).cast("date")), year).otherwise(season)
    return scenes.withColumn("season", season).where(F.col("season").isNotNull())


def one_district(areas: DataFrame, name: str, aliases: tuple[str, ...], km2: str, low: float = 1000.0, high: float = 5000.0) -> DataFrame:
    """S-28: the only area of an accepted name, of a plausible size; anything else fails."""
    found = areas.where(F.lower(F.trim(name)).isin(*[a.lower().strip() for a in aliases])).limit(2).collect()
    if len(found) != 1 or not low <= found[0][km2] <= high:
        raise ValueError(f"{len(found)} areas of that name and size")
    return areas.where(F.lower(F.trim(name)).isin(*[a.lower().strip() for a in aliases]))


def demo_sources(spark: SparkSession, paths: dict[str, str], schemas: dict[str, str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """S-29: JSON-lines tables whose dataset_type is DEMO, and the manifest of the run: (source, loaded, rejected, warning).

    Rows of another type, of none, or that are no JSON are rejected and counted; a table that is absent gives a warning
    and an otherwise empty line, and the others are read all the same.
    """
    out, lines = {}, []
    demo = F.coalesce(F.col("dataset_type") == "DEMO", F.lit(False))
    for name, path in paths.items():
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
            table = spark.read.schema(schemas[name]).json(path)
            out[name] = table.where(demo)
            lines.append(table.agg(F.count_if(demo).alias("loaded"), F.count_if(~demo).alias("rejected")).select(F.lit(name).alias("source"), "loaded", "rejected", F.lit(None).cast("string").alias("warning")))
        else:
            lines.append(spark.range(1).select(F.lit(name).alias("source"), F.lit(0).cast("long").alias("loaded"), F.lit(0).cast("long").alias("rejected"), F.lit(f"{name} is unavailable").alias("warning")))
    manifest = lines[0]
    for line in lines[1:]:
        manifest = manifest.unionByName(line)
    return out, manifest


def provider_requests(wanted: DataFrame, first: str, last: str, today: Column, horizon: int = 15) -> DataFrame:
    """S-13: spans of days (both ends inside) split into what the archive holds (before today) and what a forecast can give (to today + horizon).

    Adds provider, from_day, to_day and days_missing, the days beyond the horizon, which nobody fills in; they are told
    on the forecast's row. A span wholly beyond it gives a row of provider none; one that ends before it starts, or lacks an end, gives no row.
    """
    a, b, end = F.col(first), F.col(last), F.date_add(today, horizon)
    missing = F.greatest(F.datediff(b, F.greatest(end, F.date_sub(a, 1))), F.lit(0))
    part = lambda name, low, high, out: F.struct(F.lit(name).alias("provider"), low.alias("from_day"), high.alias("to_day"), out.alias("days_missing"))
    parts = F.array(
        F.when(a < today, part("archive", a, F.least(b, F.date_sub(today, 1)), F.lit(0))),
        F.when((b >= today) & (a <= end), part("forecast", F.greatest(a, today), F.least(b, end), missing)),
        F.when(a > end, part("none", F.lit(None).cast("date"), F.lit(None).cast("date"), missing)),
    )
    return wanted.where(a <= b).withColumn("_p", F.explode(F.array_compact(parts))).select(*wanted.columns, "_p.*")
