"""Sinks (K-01 to K-09)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """K-01: fixed columns with a header; the committer makes the folder appear at once."""
    df.select(*columns).write.mode("overwrite").csv(path, header=True)


def by_season(df: DataFrame, path: str, period: str = "year") -> None:
    """K-02: a folder per season; only seasons that occur in df are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(path)


def strict_json(df: DataFrame) -> DataFrame:
    """K-03: one JSON object per row, NaN and infinities as null, nulls written."""
    clean = [F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes]
    return df.select(F.to_json(F.struct(*clean), {"ignoreNullFields": "false"}).alias("json"))


def snapshot(history: DataFrame, key: str, order: str, columns: list[str], latest: list[str]) -> DataFrame:
    """K-04: one nested document per key: its history in order, and the latest row's columns."""
    return history.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct(order, *[c for c in columns if c != order]))).alias("history"),
        F.max(F.struct(order, *[c for c in latest if c != order])).alias("latest"), F.count(F.lit(1)).alias("n_observations"),
    )


def tier_products(events: DataFrame, columns: list[str]) -> DataFrame:
    """K-06, F-45: event rows with the label of their tier."""
    tier = F.when(F.col("burned_strict"), "STRICT").when(F.col("burned"), "LOOSE").otherwise("NONE")
    return events.withColumn("tier", tier).select(*columns, "tier")


def upsert(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """K-08, U-04: rows replace those of the same key."""
    return table.join(rows, key, "left_anti").unionByName(rows, allowMissingColumns=True)


def artifacts(df: DataFrame) -> DataFrame:
    """K-08: path, bytes and SHA-256 of a binaryFile table."""
    return df.select("path", F.length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def training_contract(df: DataFrame, key: list[str], features: list[str], labels: list[str], metadata: list[str], group: str) -> DataFrame:
    """K-09: each column once, in the order of the contract, and the group to split by."""
    columns = list(dict.fromkeys([*key, *features, *labels, *metadata]))
    return df.select(*columns, F.col(group).alias("split_group"))
