"""Literal series through the causal windows."""

import math

import pytest
from pyspark.sql import functions as F

from terracadence.plans.temporal import temporal_rows, weak_labels

DAY = 86_400_000_000
SCHEMA = "field_id string, day double, image string, NDVI double, observation_quality string, valid_pixel_count int"


def rows(spark, series, quality=None):
    data = [("f", float(d), f"i{k}", v, (quality or {}).get(k, "GOOD"), 10) for k, (d, v) in enumerate(series)]
    df = spark.createDataFrame(data, SCHEMA).withColumn("ts_us", (F.col("day") * DAY).cast("long"))
    out = temporal_rows(df, ["field_id"], ["NDVI"], "NDVI", tie="image", radar=False)
    return out.orderBy("ts_us", "image").collect()


def test_previous_delta_peak(spark):
    a, b, c = rows(spark, [(0, 0.75), (5, 0.72), (10, 0.30)])
    assert a.NDVI_prev is None and b.NDVI_delta == pytest.approx(-0.03) and c.NDVI_delta == pytest.approx(-0.42)
    assert (c.NDVI_peak, c.NDVI_days_since_peak) == (0.75, 10) and c.NDVI_drop_from_peak == pytest.approx(-0.45)


def test_relative_change_of_zero(spark):
    assert rows(spark, [(0, 0.0), (1, 0.3)])[1].NDVI_pct_change is None


def test_rolling(spark):
    r = rows(spark, [(0, 0.2), (1, 0.4), (2, 0.6)])[2]
    assert r.NDVI_rolling_mean_2 == pytest.approx(0.5) and r.NDVI_rolling_mean_3 == pytest.approx(0.4) and r.NDVI_rolling_std_3 == pytest.approx(math.sqrt(0.08 / 3))


def test_slope_and_two_back(spark):
    r = rows(spark, [(0, 0.2), (4, 0.4), (13, 0.85)])[2]
    assert r.NDVI_slope_last_3 == pytest.approx(0.05) and r.NDVI_delta_2obs == pytest.approx(0.65)


def test_same_instant_is_unseen(spark):
    r = rows(spark, [(0, 0.2), (5, 0.5), (5, 0.7), (9, 0.4)])
    assert (r[1].NDVI_prev, r[2].NDVI_prev) == (0.2, 0.2) and r[1].duplicate_timestamp and r[2].duplicate_timestamp
    assert r[3].NDVI_prev == 0.7 and r[3].observation_number == 3


def test_poor_lends_nothing(spark):
    r = rows(spark, [(0, 0.2), (2, 0.8), (4, 0.5)], {1: "POOR"})[2]
    assert r.NDVI_prev == 0.2 and r.history_count == 1


def test_missing_is_skipped(spark):
    assert [x.NDVI_prev for x in rows(spark, [(0, 0.2), (2, None), (5, 0.5)])] == [None, 0.2, 0.2]


def test_gaps(spark):
    assert [x.gap_category for x in rows(spark, [(0, 0.2), (15, 0.3), (50, 0.4)])] == [None, "MODERATE", "LARGE"]


def test_later_rows_change_nothing(spark):
    short, long_ = rows(spark, [(0, 0.2), (4, 0.4), (9, 0.3)]), rows(spark, [(0, 0.2), (4, 0.4), (9, 0.3), (13, 0.9), (22, 0.1)])
    assert short == long_[:3]


def test_weak_labels(spark):
    data = [("f", k * 5 * DAY, v, "GOOD", 1.0) for k, v in enumerate((0.80, 0.62, 0.45, 0.30, 0.28))]
    df = spark.createDataFrame(data, "field_id string, ts_us long, value double, observation_quality string, cropland_fraction double")
    out = weak_labels(df, ["field_id"]).orderBy("ts_us").collect()
    assert [r.weak_label for r in out] == ["UNKNOWN"] * 3 + ["HARVESTED", "UNKNOWN"] and out[3].evidence_window_days == 10


def test_radar_compatible_pass(spark):
    data = [("f", 0, "a", "IW", "ASC", 1, -10.0), ("f", 3, "b", "IW", "ASC", 1, -12.0), ("f", 7, "c", "IW", "DESC", 2, -9.0)]
    df = spark.createDataFrame(data, "field_id string, day int, image string, s1_instrument_mode string, s1_orbit_pass string, s1_relative_orbit_number int, VV_mean_db double")
    df = df.withColumns({"ts_us": F.col("day") * F.lit(DAY), "s1_ts_us": F.col("day") * F.lit(DAY), "source_image_id_s1": F.col("image"), "NDVI": F.lit(0.5), "observation_quality": F.lit("GOOD"), "valid_pixel_count": F.lit(5)})
    out = temporal_rows(df, ["field_id"], ["NDVI"], "NDVI", tie="image").orderBy("ts_us").collect()
    assert [r.VV_mean_db_delta for r in out] == [None, -2.0, None] and not out[2].s1_prev_available
