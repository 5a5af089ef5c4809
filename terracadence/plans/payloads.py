"""Read-only questions (section 2.16): lists, details, summaries; all filters are pushed to the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import rules as R


def listing(df: DataFrame, order: list[Column], limit: int = 100, where: Column | None = None) -> DataFrame:
    """S-26, T-01, T-08."""
    return (df if where is None else df.where(where)).orderBy(*order).limit(max(1, min(limit, 1000)))


def detail(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.where(F.col(key) == F.lit(value))


def history(df: DataFrame, key: str, value: object, order: str) -> DataFrame:
    return detail(df, key, value).orderBy(order)


def watchlist(scored: DataFrame, score: str, key: str, limit: int = 100) -> DataFrame:
    """T-02, T-03."""
    return listing(scored, [F.col(score).desc_nulls_last(), F.col(key)], limit)


def fires_of_year(fires: DataFrame, year: int, sensors: tuple[str, ...] = ("S-NPP", "NOAA-20")) -> DataFrame:
    """P-06, P-17: vegetation fires of September to December in the district, rounded."""
    own = (F.year("acq_date") == year) & F.month("acq_date").isin(9, 10, 11, 12) & F.col("in_district") & (F.coalesce("type", F.lit(0)) == 0) & F.col("sensor").isin(*sensors)
    return fires.where(own).select("acq_date", F.bround("latitude", 5).alias("latitude"), F.bround("longitude", 5).alias("longitude"), "sensor", "confidence_class", F.bround("frp", 1).alias("frp"))


def visible_to(df: DataFrame, allowed: DataFrame, key: str, real_only: bool = False) -> DataFrame:
    """P-15, P-16: rows that a reader may see."""
    out = df.join(allowed.select(key).distinct(), key, "left_semi")
    return out.where("real_or_synthetic = 'REAL'") if real_only else out


def search(df: DataFrame, text: str | None = None, columns: tuple[str, ...] = (), equal: dict[str, object] | None = None) -> DataFrame:
    """P-18: text in any of the columns, whatever the case, and exact values."""
    if text:
        hit = F.lit(False)
        for c in columns:
            hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
        df = df.where(hit)
    for c, v in (equal or {}).items():
        df = df.where(F.col(c) == F.lit(v))
    return df


def recent_activity(tables: list[tuple[str, DataFrame, str, str]], n: int = 5) -> DataFrame:
    """T-09: the latest rows of several tables; (kind, table, time, title)."""
    out = None
    for kind, df, at, title in tables:
        rows = df.select(F.lit(kind).alias("kind"), F.col(at).alias("at"), F.col(title).cast("string").alias("title")).orderBy(F.col("at").desc(), "title").limit(n)
        out = rows if out is None else out.unionByName(rows)
    return out.orderBy(F.col("at").desc(), "kind", "title").limit(n)


def intelligence(rows: DataFrame, trust: str = "NO_MODEL", predicted: str | None = None) -> DataFrame:
    """G-05: per row the status, then the straw, then the risk, each a struct, and where the status comes from.

    A validated model's own status (column predicted) is taken; any other model is set aside for the rule, and one fitted
    to synthetic rows is refused. Straw is estimated for a harvest only, risk only for a harvest that is well founded (a
    band of MODERATE or HIGH, or a validated model); otherwise risk is NULL and risk_state says so.
    """
    if trust == "SYNTHETIC_TEST_MODEL":
        raise ValueError("a model fitted to synthetic rows cannot serve")
    c, validated = F.col, trust == "VALIDATED_MODEL" and predicted is not None
    status = R.status_candidate(c("NDVI_mean"), c("NDVI_delta"), c("NDVI_drop_from_peak"), c("NBR_delta"), c("BAIS2_delta"), c("recent_fire_24h"))
    if validated:
        status = F.struct(c(predicted).alias("status"), F.lit("HIGH").alias("band"), F.lit("model").alias("evidence"))
    df = rows.withColumn("status", status).withColumns({"status_source": F.lit("trained_model" if validated else "rule"), "model_trust_state": F.lit(trust)})
    df = df.withColumn("straw", R.straw_estimate(c("status.status"), c("status.band"), c("area_ha"), c("peak_NDVI")))
    founded = F.coalesce((c("status.status") == "HARVESTED") & c("status.band").isin("MODERATE", "HIGH"), F.lit(False))
    parts = R.risk_components(c("days_since_harvest"), c("harvest_state"), c("rain_72h"), c("forecast_rain"), R.forecast_admissible(c("forecast_issued"), c("observed")), c("humidity_pct"), c("baler_m"), c("buyer_m"), c("burn_rate"), c("straw.estimate_t"), c("recent_fire_72h"))
    return df.withColumns({"risk": F.when(founded, R.risk_score(parts)), "risk_state": F.when(founded, "SCORED").otherwise("NOT_APPLICABLE_INSUFFICIENT_HARVEST_EVIDENCE")})


def dashboard(df: DataFrame) -> DataFrame:
    """A-37."""
    return df.agg(F.count(F.lit(1)).alias("fields"), F.count_if(F.col("status") == "HARVESTED").alias("harvested"), F.count_if(F.col("level").isin("HIGH", "CRITICAL")).alias("at_risk"), F.sum("straw_t").alias("straw_t"))


def certificates(cases: DataFrame, observations: DataFrame) -> DataFrame:
    """G-15, F-34: certificates of the cases that allow one, with their first and last images and the hash of their content."""
    from ..functions.texts import canonical_hash

    per = observations.groupBy("verification_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("at", "image")).alias("a"), F.max(F.struct("at", "image")).alias("b"))
    rows = cases.join(per, "verification_id").where(R.certifiable(F.col("state"), F.col("n")))
    rows = rows.select("verification_id", "field_id", F.col("n").alias("observations"), F.col("a.image").alias("first_image"), F.col("b.image").alias("last_image"), F.col("b.at").alias("monitoring_end"))
    return rows.withColumn("sha256", canonical_hash({k: F.col(k).cast("string") for k in rows.columns}))
