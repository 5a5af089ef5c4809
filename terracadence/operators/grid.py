"""Neighbourhood sums on a sparse grid (A-16, A-17, J-26)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _offsets(block: int):
    half = block // 2
    return F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-half, half + 1) for j in range(-half, half + 1)]))


def block_sums(df: DataFrame, keys: list[str], ix: str, iy: str, measures: dict[str, str], block: int = 3) -> DataFrame:
    """A-16: per occupied cell the sums over the block around it (zero beyond the data); measures: name -> SQL expression summed per cell first."""
    cells = df.groupBy(*keys, ix, iy).agg(*[F.sum(F.expr(e)).alias(n) for n, e in measures.items()])
    spread = cells.withColumn("_o", _offsets(block)).withColumn("_x", F.col(ix) + F.col("_o.i")).withColumn("_y", F.col(iy) + F.col("_o.j"))
    sums = spread.groupBy(*keys, F.col("_x").alias(ix), F.col("_y").alias(iy)).agg(*[F.sum(n).alias(n) for n in measures])
    return cells.select(*keys, ix, iy).join(sums, [*keys, ix, iy])


def neighbour_rate(df: DataFrame, keys: list[str], ix: str, iy: str, hit: str, block: int = 3, name: str = "nbhd_rate") -> DataFrame:
    """A-16: each row with the share of rows of its block for which the SQL condition holds; the denominator is 1 at least."""
    sums = block_sums(df, keys, ix, iy, {"_h": f"case when {hit} then 1 else 0 end", "_n": "1"}, block)
    sums = sums.select(*keys, ix, iy, (F.col("_h") / F.greatest("_n", F.lit(1))).alias(name))
    return df.join(sums, [*keys, ix, iy], "left")


def counts_before(df: DataFrame, keys: list[str], ix: str, iy: str, event: str, at: str, block: int = 3, name: str = "nbhd_before") -> DataFrame:
    """A-17: each row with the events (by their date) of its block strictly before its own date; rows without a date get NULL.

    Events are counted per cell and date, spread to the block, summed up along the dates and met by the rows in one
    ordered stream per cell.
    """
    daily = df.where(F.col(event).isNotNull()).groupBy(*keys, ix, iy, F.col(event).alias("_at")).agg(F.count(F.lit(1)).alias("_n"))
    spread = daily.withColumn("_o", _offsets(block)).select(*keys, (F.col(ix) + F.col("_o.i")).alias(ix), (F.col(iy) + F.col("_o.j")).alias(iy), "_at", "_n")
    rows = df.select(*keys, ix, iy, F.col(at).alias("_at"), F.struct(*df.columns).alias("_row"))
    both = rows.withColumn("_n", F.lit(0).cast("long")).unionByName(spread, allowMissingColumns=True)
    days = F.datediff(F.col("_at"), F.lit("1970-01-01").cast("date")) if dict(df.dtypes)[at] == "date" else F.col("_at").cast("long")
    w = Window.partitionBy(*keys, ix, iy).orderBy(days).rangeBetween(Window.unboundedPreceding, -1)
    out = both.withColumn(name, F.coalesce(F.sum("_n").over(w), F.lit(0).cast("long"))).where(F.col("_row").isNotNull())
    return out.select("_row.*", F.when(F.col("_at").isNotNull(), F.col(name)).alias(name))
