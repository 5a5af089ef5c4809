"""Causal feature rows of observation series (B-03): windows W-01 to W-09, W-23 and the compatible radar pass J-12."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.spectral import eligible, gap_category
from ..operators import windows as W
from ..operators.joins import asof_compatible

VERSION = "temporal-1"


def temporal_rows(obs: DataFrame, keys: list[str], metrics: list[str], peak: str, tie: str = "source_image_id_s2", radar: bool = True) -> DataFrame:
    """Every row with its history: obs has ts_us, observation_quality, valid_pixel_count, the metrics, and s1_* columns if radar.

    Rows of one instant do not see each other; POOR rows get features but lend none. One sort by (keys, ts_us) serves
    all frames. Adding later rows changes nothing in earlier ones.
    """
    obs = obs.withColumn("_ok", eligible(F.col("observation_quality"), F.col("valid_pixel_count")))
    ok = F.col("_ok")
    seen = F.when(ok, F.struct("ts_us", F.col(tie).alias("image"), F.col("observation_quality").alias("quality")))
    past = W.before(keys)
    df = obs.withColumns({"_prev": F.max(seen).over(past), "history_count": F.count(F.when(ok, 1)).over(past)})
    df = df.withColumns({"prev_ts_us": F.col("_prev.ts_us"), "prev_image": F.col("_prev.image"), "prev_quality": F.col("_prev.quality"), "has_prev": F.col("_prev").isNotNull()})
    df = df.withColumn("gap_days", (F.col("ts_us") - F.col("prev_ts_us")) / 86_400_000_000).withColumn("gap_category", gap_category(F.col("gap_days")))
    df = W.observation_number(df, keys)
    for m in metrics:
        value = F.col(m)
        df = W.change(W.previous(df, keys, value, ok, m, tie=tie), value, m)
        df = W.valid_window_stats(W.valid_history(df, keys, value, ok, m, tie=tie), value, m).drop(f"{m}_hist", f"{m}_prev_ts")
    df = W.running_peak(df, keys, F.col(peak), ok, peak).withColumn("feature_schema_version", F.lit(VERSION)).drop("_prev", "_ok")
    if radar:
        bands = [c for c in ("VV_mean_db", "VH_mean_db", "VV_minus_VH_db", "VV_VH_ratio_linear") if c in df.columns]
        df = asof_compatible(df, keys, "s1_ts_us", "source_image_id_s1", ["s1_instrument_mode"], ["s1_orbit_pass", "s1_relative_orbit_number"], [*bands, "source_image_id_s1"], prefix="s1_prev_")
        df = df.withColumns({f"{b}_delta": F.col(b) - F.col(f"s1_prev_{b}") for b in bands} | {"s1_prev_available": F.col("s1_prev_ts").isNotNull()})
    return df


def weak_labels(obs: DataFrame, keys: list[str], ts: str = "ts_us", value: str = "value", quality: str = "observation_quality", cropland: str = "cropland_fraction", tie: str | None = None) -> DataFrame:
    """W-30: HARVESTED, SOWN, STANDING or UNKNOWN per row from the usable rows before it, with the evidence window. Proxies, never ground truth.

    Rows of one instant do not see each other; of the latest instant the row with the greatest tie key (or value) counts. A
    harvest is the first low value after the last high one; sowing is green-up from bare ground after an earlier high;
    windows longer than 75 days decide nothing.
    """
    usable = F.coalesce(F.col(quality).isin("GOOD", "LIMITED") & F.col(value).isNotNull(), F.lit(False))
    w = W.before(keys, ts)
    row = F.struct(F.col(ts).alias("t"), F.col(tie or value).alias("k"), F.col(value).alias("v"))
    df = obs.withColumn("_u", usable)
    df = df.withColumns({
        "_prev": F.max(F.when(F.col("_u"), row)).over(w),
        "_high": F.max(F.when(F.col("_u") & (F.col(value) >= 0.55), row)).over(w),
        "_low_t": F.max(F.when(F.col("_u") & (F.col(value) <= 0.35), F.col(ts))).over(w),
        "_first_high_t": F.min(F.when(F.col("_u") & (F.col(value) >= 0.55), F.col(ts))).over(w),
    })
    day = 86_400_000_000
    gap, since_high = (F.col(ts) - F.col("_prev.t")) / day, (F.col(ts) - F.col("_high.t")) / day
    delta = F.col(value) - F.col("_prev.v")
    ok = F.col("_u") & F.coalesce(F.col(cropland) >= 0.5, F.lit(False)) & F.col("_prev").isNotNull()
    first_low = F.col("_high").isNotNull() & (F.col("_low_t").isNull() | (F.col("_low_t") <= F.col("_high.t")))
    harvested = ok & first_low & (F.col(value) <= 0.35) & (since_high > 0) & (since_high <= 75)
    near = ok & (gap > 0) & (gap <= 75)
    earlier_high = F.coalesce(F.col("_first_high_t") < F.col("_prev.t"), F.lit(False))
    sown = near & earlier_high & (F.col("_prev.v") <= 0.30) & (delta >= 0.15)
    standing = near & (F.col(value) >= 0.55) & (F.abs(delta) < 0.15)
    label = F.when(F.coalesce(harvested, F.lit(False)), "HARVESTED").when(F.coalesce(sown, F.lit(False)), "SOWN").when(F.coalesce(standing, F.lit(False)), "STANDING").otherwise("UNKNOWN")
    df = df.withColumn("weak_label", label)
    window = F.when(F.col("weak_label") == "HARVESTED", since_high).otherwise(gap)
    start = F.when(F.col("weak_label") == "HARVESTED", F.col("_high.t")).otherwise(F.col("_prev.t"))
    df = df.withColumns({"evidence_window_start": start, "evidence_window_days": window, "is_ground_truth": F.lit(False)})
    return df.withColumn("temporal_gap_category", gap_category(F.col("evidence_window_days"))).drop("_u", "_prev", "_high", "_low_t", "_first_high_t")
