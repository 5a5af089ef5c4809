"""Risk, hazard and season panels (B-07, B-08, B-10, B-11) and season summaries (A-13, A-18 to A-23, A-45)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import cell
from ..operators.grid import block_sums, counts_before, neighbour_rate
from ..operators.joins import lookup

CELL_M = 500.0


def with_cells(df: DataFrame, size: float = CELL_M, margin: float = 2000.0) -> DataFrame:
    """F-29: ix, iy on a grid whose origin lies margin below the least coordinates."""
    low = df.agg(F.min("x").alias("x"), F.min("y").alias("y")).first()
    return df.withColumns({"ix": cell(F.col("x"), (low["x"] or 0.0) - margin, size), "iy": cell(F.col("y"), (low["y"] or 0.0) - margin, size)})


def risk_features(now: DataFrame, before: DataFrame) -> DataFrame:
    """B-07: fields of a season (field_id, x, y, ix, iy, harvest_date, burn_date, burned, peak_ndvi, pixel_area_ha) with the season before as context.

    prior_burn looks at all fields of the season before, the neighbourhood rate at its crop fields; the counts before
    see only what lies strictly before the field's own harvest.
    """
    crop = now.where((F.col("peak_ndvi") >= 0.6) & F.col("harvest_date").isNotNull())
    prior = before.select("field_id", F.col("burned").cast("int").alias("prior_burn"))
    df = lookup(crop, prior, ["field_id"], {"prior_burn": 0})
    cells = block_sums(before.where("peak_ndvi >= 0.6"), [], "ix", "iy", {"_b": "cast(burned as int)", "_n": "1"})
    rate = cells.select("ix", "iy", (F.col("_b") / F.greatest("_n", F.lit(1))).alias("nbhd_prior_rate"))
    df = lookup(df, rate, ["ix", "iy"], {"nbhd_prior_rate": 0.0})
    df = counts_before(df, [], "ix", "iy", "burn_date", "harvest_date", name="nbhd_burned_before")
    df = counts_before(df, [], "ix", "iy", "harvest_date", "harvest_date", name="nbhd_harvested_before")
    return df.withColumn("harvest_doy", F.dayofyear("harvest_date"))


def hazard_panel(fields: DataFrame, passes: DataFrame, rain: DataFrame, days: int = 30) -> DataFrame:
    """B-08: a row per field and satellite pass while the field is at risk: recent burns around it, rain before and after, label: burned before the next pass.

    fields: field_id, ix, iy, harvest_date, burned, burn_date, burn_prev_date; passes: t; rain: day, mm. Passes of a
    season and days of rain are few and are broadcast after a count.
    """
    n = passes.count() + rain.count()
    small = F.broadcast if n <= 10_000 else (lambda d: d)
    at_risk = (F.col("harvest_date") <= F.col("t")) & (F.col("t") <= F.date_add("harvest_date", days)) & ~(F.coalesce(F.col("burned"), F.lit(False)) & (F.col("burn_prev_date") < F.col("t")))
    # each field meets the passes of its own span of days: an equi-key instead of all pairs
    spans = fields.where(F.col("harvest_date").isNotNull()).withColumn("t", F.explode(F.sequence(F.col("harvest_date"), F.date_add("harvest_date", days))))
    panel = spans.join(small(passes.select("t").distinct()), "t").where(at_risk)
    burns = fields.where("burned").select("ix", "iy", F.explode(F.sequence(F.col("burn_date"), F.date_add("burn_date", 9))).alias("t"))
    for block in (3, 9):
        half = block // 2
        around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-half, half + 1) for j in range(-half, half + 1)]))
        spread = burns.groupBy("t", "ix", "iy").agg(F.count(F.lit(1)).alias("_n")).withColumn("_o", around)
        recent = spread.groupBy("t", (F.col("ix") + F.col("_o.i")).alias("ix"), (F.col("iy") + F.col("_o.j")).alias("iy")).agg(F.sum("_n").alias(f"recent_burns_{block}"))
        panel = lookup(panel, recent, ["t", "ix", "iy"], {f"recent_burns_{block}": 0})
    daily = rain.groupBy("day").agg(F.avg("mm").alias("mm"))
    for name, a, b in (("rain_before", -3, -1), ("rain_after", 0, 4)):
        shifted = daily.select(F.explode(F.sequence(F.date_sub("day", b), F.date_sub("day", a))).alias("t"), "mm").groupBy("t").agg(F.sum("mm").alias(name))
        panel = lookup(panel, shifted, ["t"], {name: 0.0})
    label = F.coalesce(F.col("burned") & (F.col("burn_prev_date") == F.col("t")), F.lit(False)).cast("int")
    return panel.withColumns({"days_since_harvest": F.datediff("t", "harvest_date"), "label": label})


def season_census(events: DataFrame) -> DataFrame:
    """A-13, A-20: one row per season: fields, crop, harvested, loose and strict counts, shares and areas."""
    crop = F.col("peak_ndvi") >= 0.6
    hit = lambda c: F.count_if(crop & F.col(c))
    area = lambda c: F.sum(F.when(crop & F.col(c), F.col("pixel_area_ha")).otherwise(0.0))
    out = events.groupBy("year").agg(F.count(F.lit(1)).alias("fields"), F.count_if(crop).alias("crop_fields"), hit("harvested").alias("harvested"), hit("burned").alias("loose"), hit("burned_strict").alias("strict"), area("burned").alias("loose_ha"), area("burned_strict").alias("strict_ha"), F.count_if(crop & F.col("strict_blocked_by_haze")).alias("blocked_by_haze"), F.median(F.when(crop, F.col("n_usable"))).alias("median_usable"))
    return out.withColumns({"loose_share": F.try_divide("loose", "crop_fields"), "strict_share": F.try_divide("strict", "crop_fields")})


def tier_rollup(events: DataFrame) -> DataFrame:
    """A-13 by any depth: seasons, tiers within seasons, and all together."""
    return events.rollup("year", "burn_tier").agg(F.count(F.lit(1)).alias("fields"), F.sum("pixel_area_ha").alias("area_ha"))


def latency(events: DataFrame) -> DataFrame:
    """A-19: days from harvest to burn per season."""
    days = F.col("harvest_to_burn_days")
    share = lambda c: F.avg(c.cast("double"))
    return events.where(F.col("burned") & days.isNotNull()).groupBy("year").agg(F.median(days).alias("median"), F.percentile(days, F.lit(0.25)).alias("p25"), F.percentile(days, F.lit(0.75)).alias("p75"), share(days <= 5).alias("within_5"), share(days <= 10).alias("within_10"), share(days > 20).alias("beyond_20"))


def visibility(obs: DataFrame) -> DataFrame:
    """A-18: shares of clear and usable rows and the median of blue by date."""
    return obs.groupBy("date").agg(F.avg(F.col("clear").cast("int")).alias("clear_share"), F.avg(F.col("usable").cast("int")).alias("usable_share"), F.median("B02").alias("median_blue"))


def haze_audit(obs: DataFrame) -> DataFrame:
    """A-12, P-11: per scene the counts by haze class, median and 90 % of blue among valid rows, shares and status."""
    from ..functions.spectral import scene_status

    classes = ("CLEAR", "HAZE_DOWNGRADED", "THICK_SMOKE_EXCLUDED", "CLOUD_EXCLUDED", "NO_DATA_EXCLUDED")
    valid = F.when(F.col("haze_class").isin("CLEAR", "HAZE_DOWNGRADED", "THICK_SMOKE_EXCLUDED"), F.col("B02"))
    out = obs.groupBy("date", "item_id").agg(F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("haze_class") == k).alias(k.lower()) for k in classes], F.median(valid).alias("median_blue"), F.percentile(valid, F.lit(0.9)).alias("p90_blue"))
    excluded = (F.col("n") - F.col("clear") - F.col("haze_downgraded")) / F.col("n")
    return out.withColumns({"excluded_share": excluded, "haze_share": F.col("haze_downgraded") / F.col("n")}).withColumn("scene_status", scene_status(F.col("excluded_share"), F.col("haze_share")))


def season_haze(audit: DataFrame) -> DataFrame:
    """A-45."""
    return audit.groupBy(F.year("date").alias("year")).agg(F.count(F.lit(1)).alias("scenes"), *[F.count_if(F.col("scene_status") == s).alias(s.lower()) for s in ("USABLE", "HAZE_DOWNGRADED", "EXCLUDED")])


def fire_counts(fires: DataFrame) -> DataFrame:
    """A-23: detections per year and date, one column per sensor."""
    return fires.groupBy(F.year("acq_date").alias("year"), "acq_date").pivot("sensor", ["MODIS", "S-NPP", "NOAA-20"]).count()


def harvest_curve(events: DataFrame) -> DataFrame:
    """B-10: share of a season's crop fields harvested by each day of the year, and the weekly step."""
    crop = events.where("peak_ndvi >= 0.6")
    total = crop.groupBy("year").agg(F.count(F.lit(1)).alias("n"))
    daily = crop.where("harvested").groupBy("year", F.dayofyear("harvest_date").alias("doy")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("year").orderBy("doy")
    out = daily.join(F.broadcast(total), "year").withColumn("share", F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.col("n"))
    return out.withColumn("week_share", F.sum("k").over(w.rangeBetween(-6, 0)) / F.col("n")).select("year", "doy", "share", "week_share")


def reviewer_context(samples: DataFrame, fires: DataFrame, burned: DataFrame) -> DataFrame:
    """B-13: sampled fields with the fires within 1 km and the burned pixels within 500 m of the 30 days before."""
    from ..operators.band import band_counts

    day = 1
    out = band_counts(samples, fires, "field_id", 1000.0, ("x", "y"), ("fx", "fy"), "day", "fire_day", 30 * day, {"n_fires": F.lit(True)}).drop("nearest", "latest")
    return band_counts(out, burned, "field_id", 500.0, ("x", "y"), ("bx", "by"), "day", "burn_day", 30 * day, {"n_burned_pixels": F.lit(True)}, closed_start=True, closed_end=False).drop("nearest", "latest")


def rate_around(df: DataFrame, hit: str, block: int = 3) -> DataFrame:
    """A-16 for a season's fields."""
    return neighbour_rate(df, [], "ix", "iy", hit, block)
