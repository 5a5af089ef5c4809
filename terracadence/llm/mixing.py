"""Mixing sources to target weights by nested hash-threshold histograms (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.windows import numbered_globally, running_totals
from .common import WORD, small, staged, text_of

#: Hex digits of the md5 that make up the sampling key, and how many each histogram level looks at.
KEY_DIGITS, LEVELS = 9, (3, 3, 3)
BROADCAST_SOURCES = 10_000


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(totals: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Water-filling over one row per source (source, source_size) -> adds target.

    Sources in code-point order (null last) get the weights in turn. A source takes weight * level but at most
    max_repeat times its size; the level that spends all sizes is read off prefix sums in the order of cap / weight,
    which is where handing the excess round again and again ends up. Ranks and prefix sums come from range partitions.
    """
    named = numbered_globally(totals, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = named.withColumn("_w", weight).withColumn("_cap", F.lit(max_repeat) * F.col("source_size")).withColumn("_ratio", F.col("_cap") / F.col("_w"))
    ranked = running_totals(ranked, [F.col("_ratio"), F.col("source").asc_nulls_last()], {"_cap_upto": "_cap", "_w_upto": "_w"})
    whole = ranked.agg(F.sum("source_size").alias("total"), F.sum("_w").alias("w")).first()
    level = (F.lit(whole.total) - (F.col("_cap_upto") - F.col("_cap"))) / (F.lit(whole.w) - (F.col("_w_upto") - F.col("_w")))
    ranked = ranked.withColumn("_level", level).withColumn("_free", F.col("_ratio") > F.col("_level"))
    first = ranked.where("_free").agg(F.min(F.struct("_ratio", F.col("source").isNull().alias("last"), "source", "_level")).alias("f")).first().f
    target = F.when(F.col("_free"), F.col("_w") * F.lit(first._level if first else None).cast("double")).otherwise(F.col("_cap").cast("double"))
    return ranked.select("source", "source_size", target.alias("target"))


def _by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Null-safe join of one row per source."""
    return rows.join(table.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")), "inner").drop("_source")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """Size and sampling key of a document."""
    text = text_of(text_col)
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), text))
    return word_count(text), F.substring(key, 1, KEY_DIGITS)


def mix_plan(slim: DataFrame, weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3) -> tuple[DataFrame, int]:
    """One row per source: whole repeats and the hash threshold of the rest, from (source, size, key) rows; and the number of sources.

    Sizes are summed by source and by the leading digits of the hash, the bucket where the running sum passes the
    budget is refined by the next digits, and so on; the last bucket is in if that ends nearer to the budget.
    """
    totals = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(totals, weights, max_repeat)
    whole = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeat))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("rest", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0)))
    plan = staged(plan.withColumn("below", F.lit("")).withColumn("done", F.lit(0).cast("long")))
    n_sources = plan.count()
    for depth, digits in enumerate(LEVELS):  # below: the digits fixed so far, done: words under them
        at = sum(LEVELS[:depth])
        inside = _by_source(slim, small(plan.select("source", "below", "done", "rest"), n_sources, BROADCAST_SOURCES))
        inside = inside.where(F.substring("key", 1, at) == F.col("below")) if at else inside
        hist = inside.groupBy("source", "below", "done", "rest", F.substring("key", 1, at + digits).alias("bucket")).agg(F.sum("size").alias("n"))
        upto = F.col("done") + F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        edge = hist.withColumn("upto", upto).where(F.col("upto") > F.col("rest"))
        edge = edge.groupBy("source").agg(F.min(F.struct("bucket", "upto", "n")).alias("e"))
        edge = edge.select(F.col("source").alias("_source"), F.col("e.bucket").alias("new_below"), (F.col("e.upto") - F.col("e.n")).alias("new_done"), F.col("e.upto").alias("upto"))
        plan = plan.drop("upto").join(edge, F.col("source").eqNullSafe(F.col("_source")), "left")
        plan = plan.select("source", "source_size", "target", "whole", "rest", F.coalesce("new_below", "below").alias("below"), F.coalesce("new_done", "done").alias("done"), "upto")
        plan = staged(plan)
    # where nothing passes the budget (a source without words) no document is under the threshold
    take_edge = F.coalesce(F.col("upto") - F.col("rest") < F.col("rest") - F.col("done"), F.lit(False))
    return plan.select("source", "source_size", "target", "whole", "below", take_edge.alias("take_edge")), n_sources


def _decided(rows: DataFrame, plan: tuple[DataFrame, int], max_repeat: int) -> DataFrame:
    """Add repeats to rows of (source, size, key, ...)."""
    out = _by_source(rows, small(plan[0], plan[1], BROADCAST_SOURCES))
    extra = (F.col("key") < F.col("below")) | (F.col("take_edge") & (F.col("key") == F.col("below")))
    repeats = F.when(F.col("size") > 0, F.least(F.col("whole") + extra.cast("long"), F.lit(max_repeat))).otherwise(F.lit(0))
    return out.withColumn("repeats", repeats.cast("long"))


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3
) -> DataFrame:
    """Decide how often each document enters the mix.

    Every document of a source is repeated floor(target / source_size) times; the rest of the budget goes to the
    documents whose hash lies under the threshold of mix_plan. No sort of documents takes place.

    Returns id, size, source_size, target, taken (size times repeats), repeats and mix_key, one row for each input
    row. Null text counts no words and is never taken; a null source is a source of its own, last in order; rows
    that repeat both id and text share one fate; empty input gives no rows.
    """
    size, key = _keyed(docs, id_col, text_col)
    slim = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key")))
    out = _decided(slim, mix_plan(slim, weights, max_repeat), max_repeat)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", F.col("key").alias("mix_key"))


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """The mix itself: the input's rows with all their columns, each as often as mix_sources decides (0 to max_repeat times).

    Texts do not move: the decision is taken beside the scan from the per-source table. Odd rows as in mix_sources;
    columns keep their values, whatever their names.
    """
    size, key = _keyed(docs, id_col, text_col)
    slim = staged(docs.select(F.col(source_col).alias("source"), size.alias("size"), key.alias("key")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source_col).alias("source"), size.alias("size"), key.alias("key"))
    out = _decided(rows, mix_plan(slim, weights, max_repeat), max_repeat).where("repeats > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats"))).alias("_copy")).select("row.*")
