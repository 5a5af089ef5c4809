"""Samples that any engine can repeat: rows are ranked by hash, not by a generator (B-11, B-14, W-21)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def hash_key(column: str, seed: int | str):
    return F.md5(F.concat(F.col(column).cast("string"), F.lit(f":{seed}")))


def stratified_sample(df: DataFrame, stratum: str, key: str, n: int, seed: int | str = 0) -> DataFrame:
    """B-14: n rows of each stratum, the smallest by hash."""
    w = Window.partitionBy(stratum).orderBy(hash_key(key, seed), key)
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n).drop("_r")


def hash_share(df: DataFrame, key: str, share: float, seed: int | str = 0) -> DataFrame:
    """B-11: about a share of all rows, decided row by row."""
    place = F.conv(F.substring(hash_key(key, seed), 1, 8), 16, 10).cast("long")
    return df.where(place < int(share * (1 << 32)))


def resampled(df: DataFrame, key: str, columns: list[str], donors: DataFrame, donor_key: str, seed: int | str = 1) -> DataFrame:
    """B-11: rows with the columns of a donor drawn by hash, as a control that keeps the donors' distribution. donors is counted; each has one number."""
    from .windows import numbered_globally

    numbered = numbered_globally(donors.select(donor_key, *columns), [hash_key(donor_key, seed), F.col(donor_key)], "_slot").drop(donor_key)
    n = numbered.count()
    slot = F.pmod(F.conv(F.substring(hash_key(key, seed), 1, 12), 16, 10).cast("long"), F.lit(max(1, n))) + 1
    return df.drop(*columns).withColumn("_slot", slot).join(numbered, "_slot", "left").drop("_slot")


def spread_sample(df: DataFrame, cell: list[str], size: str, key: str, per_cell: int = 4, n: int = 500) -> DataFrame:
    """W-21: the largest per_cell rows of each cell, of which n are taken at even steps in key order."""
    from .windows import numbered_globally, top_per_group

    top = top_per_group(df, cell, [F.col(size).desc(), F.col(key)], per_cell)
    ranked = numbered_globally(top, [F.col(key)], "_r")
    total = ranked.count()
    if total <= n:
        return ranked.drop("_r")
    step = (total - 1) / max(1, n - 1)
    wanted = F.floor((F.col("_r") - 1) / step + 0.999999)  # the first step at or after this row
    return ranked.where(F.floor(wanted * step) == F.col("_r") - 1).drop("_r")
