"""Grouped measures (A-01 to A-46)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import finite
from ..functions.spectral import to_db, to_linear
from .windows import running_totals


def number_stats(x: Column, name: str) -> list[Column]:
    """A-01: mean, median, population deviation, least and greatest of the finite values."""
    v = finite(x)
    return [F.avg(v).alias(f"{name}_mean"), F.median(v).alias(f"{name}_median"), F.stddev_pop(v).alias(f"{name}_std"), F.min(v).alias(f"{name}_min"), F.max(v).alias(f"{name}_max")]


def zonal_mean(value: Column, ok: Column, least: int = 0) -> Column:
    """A-03, A-05: mean over the pixels that count, NULL below least of them; each measure has its own denominator."""
    v = F.when(ok, finite(value))
    return F.when(F.count(v) >= least, F.avg(v))


def zonal_share(condition: Column, ok: Column | None = None) -> Column:
    """A-04, A-44: share of the pixels (that count) for which the condition holds; NULL without any."""
    hit = F.when(F.coalesce(condition, F.lit(False)), 1.0).otherwise(0.0)
    return F.avg(hit if ok is None else F.when(ok, hit))


def db_mean(db: Column, least: int = 1) -> Column:
    """A-06, A-46: mean in linear power, turned to dB once; NULL below least values."""
    return F.when(F.count(db) >= least, to_db(F.avg(to_linear(db))))


def db_array_summary(vv: Column, vh: Column) -> dict[str, Column]:
    """A-07: per row of two arrays of dB values: mean dB of each, difference of the means, and the ratio of linear means."""
    mean = lambda a: F.try_divide(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), F.size(a))
    linear = lambda a: mean(F.transform(a, to_linear))
    return {"vv_mean_db": mean(vv), "vh_mean_db": mean(vh), "vv_minus_vh_db": mean(vv) - mean(vh), "vv_vh_ratio_linear": F.try_divide(linear(vv), linear(vh))}


def season_low_and_canopy(date: Column, db: Column, low: tuple[str, str], canopy: tuple[str, str]) -> tuple[Column, Column]:
    """A-08: least value in one window of dates, mean in another."""
    return F.min(F.when(date.between(*low), db)), F.avg(F.when(date.between(*canopy), db))


def at_greatest(value: Column, order: Column, *row: Column | str) -> Column:
    """A-10: the row with the greatest value, ties to the smallest order."""
    return F.max(F.when(value.isNotNull(), F.struct(value.alias("_v"), (-order).alias("_o"), *row)))


def at_first(order: Column, *row: Column | str) -> Column:
    """A-11."""
    return F.min(F.struct(order.alias("_o"), *row))


def share(condition: Column) -> Column:
    """A-12, A-13, A-24: share of all rows, missing conditions counting as false."""
    return F.avg(F.coalesce(condition, F.lit(False)).cast("double"))


def null_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """A-24: one row per column: rows, missing ones, rate."""
    n = F.count(F.lit(1))
    wide = df.agg(n.alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("n_rows"), F.col(c).alias("n_missing")) for c in columns])
    return wide.select(F.explode(entries).alias("e")).select("e.*", F.try_divide("e.n_missing", "e.n_rows").alias("rate"))


def complete_day(df: DataFrame, keys: list[str], ts: str, rain: str, means: list[str], hours: int = 24) -> DataFrame:
    """A-14: sums and means of days with all hours present and not missing, else NULL."""
    whole = lambda c, agg: F.when(F.count(c) == hours, agg(c)).alias(c)
    return df.groupBy(*keys, F.to_date(ts).alias("day")).agg(F.count(F.lit(1)).alias("n_hours"), whole(rain, F.sum), *[whole(c, F.avg) for c in means])


def quantiles(x: Column | str, shares: dict[str, float]) -> list[Column]:
    """A-19: exact, linear between ranks."""
    return [F.percentile(x, F.lit(p)).alias(n) for n, p in shares.items()]


def nearest_rank(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A-25: the value at the rank bround((n - 1) * share), without interpolation or lists."""
    w = Window.partitionBy(*keys)
    ranked = df.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count(F.lit(1)).over(w))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("_r") == F.bround((F.col("_n") - 1) * F.lit(p)), F.col(value))).alias(n) for n, p in shares.items()])


def persistence(df: DataFrame, key: str, period: str, hit: str, periods: list) -> DataFrame:
    """A-21: of keys seen in every period, the shares by number of hits, and what independent periods would give for two and three."""
    wide = df.groupBy(key).agg(*[F.max(F.when(F.col(period) == p, F.col(hit).cast("int"))).alias(f"h{i}") for i, p in enumerate(periods)])
    wide = wide.dropna(subset=[f"h{i}" for i in range(len(periods))]).withColumn("_n", sum(F.col(f"h{i}") for i in range(len(periods))))
    rates = [F.avg(f"h{i}") for i in range(len(periods))]
    every, pairs = rates[0], F.lit(0.0)
    for r in rates[1:]:
        every = every * r
    for i in range(len(periods)):
        one = F.lit(1.0) - rates[i]
        for j in range(len(periods)):
            one = one * rates[j] if j != i else one
        pairs = pairs + one
    return wide.agg(
        F.count(F.lit(1)).alias("n_keys"), *[F.avg((F.col("_n") == k).cast("double")).alias(f"share_{k}") for k in range(len(periods) + 1)],
        every.alias("expected_all"), (pairs + every).alias("expected_all_but_one_or_more"),
    )


def change_between(df: DataFrame, key: str, date: str, value: str, before: tuple[str, str], after: tuple[str, str]) -> DataFrame:
    """A-22: per key the greatest value of one window of dates, the median of another, and the drop between them."""
    out = df.groupBy(key).agg(F.max(F.when(F.col(date).between(*before), F.col(value))).alias("pre"), F.median(F.when(F.col(date).between(*after), F.col(value))).alias("post"))
    return out.withColumn("drop", F.col("pre") - F.col("post"))


def usable_matrix(df: DataFrame, keys: DataFrame, periods: DataFrame, key: str, period: str, most_periods: int = 1_000) -> DataFrame:
    """A-38: rows per key and period with zeros where there are none, summed up per period. Periods are a handful of seasons: they are counted, and each key asks for every one of them."""
    known = [r[0] for r in periods.select(period).distinct().limit(most_periods + 1).collect()]
    if len(known) > most_periods:
        raise ValueError(f"more than {most_periods} periods")
    every = F.array(*[F.lit(p) for p in known]).cast(f"array<{periods.schema[period].dataType.simpleString()}>")
    counts = df.groupBy(key, period).agg(F.count(F.lit(1)).alias("n"))
    full = keys.withColumn(period, F.explode(every)).join(counts, [key, period], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    return full.groupBy(period).agg(F.median("n").alias("median"), F.min("n").alias("least"), F.max("n").alias("most"), share(F.col("n") >= 3).alias("share_3"), share(F.col("n") >= 5).alias("share_5"))


def histogram(x: Column, edges: list[float]) -> Column:
    """A-39: bin number by right-closed edges, NULL for NULL."""
    return F.when(x.isNotNull(), sum((x > e).cast("long") for e in edges))


def two_reviewer_agreement(df: DataFrame, item: str, reviewer: str, label: str) -> DataFrame:
    """A-29: agreement and Cohen's kappa of the first two reviewers of each item; kappa is NULL where chance agreement is total."""
    w = Window.partitionBy(item).orderBy(reviewer)
    two = df.withColumn("_n", F.row_number().over(w)).groupBy(item).agg(F.max(F.when(F.col("_n") == 1, F.col(label))).alias("a"), F.max(F.when(F.col("_n") == 2, F.col(label))).alias("b"))
    two = two.where("a is not null and b is not null")
    cells = two.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    total = cells.agg(F.sum("n").alias("t"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same"))
    left, right = cells.groupBy("a").agg(F.sum("n").alias("na")), cells.groupBy(F.col("b").alias("a")).agg(F.sum("n").alias("nb"))
    chance = left.join(right, "a").agg(F.coalesce(F.sum(F.col("na") * F.col("nb")), F.lit(0)).alias("c"))
    out = total.crossJoin(chance).withColumn("agreement", F.try_divide("same", "t")).withColumn("_e", F.try_divide(F.col("c"), F.col("t") * F.col("t")))
    return out.select(F.col("t").alias("n_items"), "agreement", F.when(F.col("_e") < 1, F.try_divide(F.col("agreement") - F.col("_e"), 1 - F.col("_e"))).alias("kappa"))


def consensus(df: DataFrame, item: str, reviewer: str, label: str) -> DataFrame:
    """A-29: the common label of an item's reviewers, or DISAGREE."""
    return df.groupBy(item).agg(F.when(F.countDistinct(label) == 1, F.min(label)).otherwise("DISAGREE").alias("label"), F.countDistinct(reviewer).alias("reviewers"))


def stratified_estimate(labels: DataFrame, population: DataFrame, stratum: str, label: str, yes: str, no: str, mapped: list[str]) -> DataFrame:
    """A-30: share, 95 % interval, total, precision and recall of mapped strata, from labels per stratum and population (stratum, n_population)."""
    per = labels.groupBy(stratum).agg(F.count_if(F.col(label).isin(yes, no)).alias("_n"), F.count_if(F.col(label) == yes).alias("_y"))
    rows = population.join(per, stratum, "left").withColumn("_p", F.try_divide("_y", "_n"))
    size = population.agg(F.sum("n_population").alias("_all"))
    rows = rows.crossJoin(size).withColumn("_w", F.col("n_population") / F.col("_all"))
    in_map = F.col(stratum).isin(*mapped)
    hits = F.col("n_population") * F.col("_p")
    out = rows.agg(
        F.coalesce(F.sum(F.col("_w") * F.col("_p")), F.lit(0.0)).alias("share"),
        F.coalesce(F.sum(F.col("_w") * F.col("_w") * F.col("_p") * (1 - F.col("_p")) / F.greatest(F.col("_n") - 1, F.lit(1))), F.lit(0.0)).alias("variance"),
        F.sum(hits).alias("total"), F.sum(F.when(in_map, hits)).alias("_mh"), F.sum(F.when(in_map, F.col("n_population"))).alias("_mn"),
    )
    half = 1.96 * F.sqrt("variance")
    return out.select("share", (F.col("share") - half).alias("low"), (F.col("share") + half).alias("high"), "total", F.try_divide("_mh", "_mn").alias("precision"), F.try_divide("_mh", "total").alias("recall"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """A-31."""
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def class_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """A-31: precision, recall and F1 of each class and its support; undefined ratios are 0."""
    cells = confusion(df, truth, predicted)
    by = lambda c, n: cells.groupBy(F.col(c).alias("label")).agg(F.sum("n").alias(n))
    hit = cells.where(F.col(truth) == F.col(predicted)).select(F.col(truth).alias("label"), F.col("n").alias("tp"))
    out = by(truth, "support").join(by(predicted, "claimed"), "label", "full").join(hit, "label", "left").na.fill(0)
    p, r = F.coalesce(F.try_divide("tp", "claimed"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "support"), F.lit(0.0))
    return out.select("label", "support", p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def score_metrics(df: DataFrame, label: str, score: str) -> DataFrame:
    """A-32: ROC AUC (ties count half), average precision (steps at distinct scores), Brier score.

    Rows are first summed by score; the running counts over the distinct scores come from range partitions and their offsets.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"), F.sum(F.pow(F.col(score) - F.col(label), 2)).alias("e"))
    run = running_totals(by, [F.col("s").desc()], {"tp": "p", "fp": "n"})
    total = by.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), (F.sum("e") / F.sum(F.col("p") + F.col("n"))).alias("brier"))
    run = run.crossJoin(F.broadcast(total))  # one row
    auc = F.sum(F.col("n") * (F.col("tp") - F.col("p") + F.col("p") / 2))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp")))
    return run.groupBy("all_p", "all_n", "brier").agg(F.try_divide(auc, F.col("all_p") * F.col("all_n")).alias("auc"), F.try_divide(ap, F.col("all_p")).alias("average_precision")).select("auc", "average_precision", "brier")


def precision_at(df: DataFrame, label: str, score: str, fraction: float, tie: str) -> DataFrame:
    """A-33: precision among the top bround(n * fraction) rows (1 at least) and its lift over the base rate."""
    base = df.agg(F.count(F.lit(1)).alias("n"), F.avg(label).alias("base")).first()
    k = max(1, round((base.n or 0) * fraction))
    top = df.orderBy(F.col(score).desc(), tie).limit(k)
    out = top.agg(F.avg(label).alias("precision"))
    return out.withColumn("k", F.lit(k).cast("long")).withColumn("lift", F.try_divide(F.col("precision"), F.lit(base.base)))


def lift_per_group(df: DataFrame, group: str, label: str, score: str, tie: str, fraction: float = 0.1, least: int = 20) -> DataFrame:
    """A-34: lift of each group's top fraction, for groups with least positives; its median is the summary."""
    w = Window.partitionBy(group)
    ranked = df.withColumns({"_r": F.row_number().over(w.orderBy(F.col(score).desc(), tie)), "_n": F.count(F.lit(1)).over(w)})
    top = F.col("_r") <= F.greatest(F.lit(1), F.bround(F.col("_n") * fraction))
    out = ranked.groupBy(group).agg(F.sum(label).alias("positives"), F.avg(label).alias("base"), F.avg(F.when(top, F.col(label))).alias("precision"))
    return out.where(F.col("positives") >= least).withColumn("lift", F.try_divide("precision", "base"))


# Warming potentials over a century.
POTENTIALS = {"CH4": 27.0, "N2O": 273.0}


def hash_uniform(i: Column, stream: int, seed: int = 0) -> Column:
    """A number in (0, 1) that depends on the row number, the stream and the seed only, on any engine: 32 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", i.cast("string"), F.lit(stream), F.lit(seed))), 1, 8), 16, 10).cast("double")
    return (bits + 0.5) / 4294967296.0


def hash_normal(i: Column, stream: int, seed: int = 0) -> Column:
    """A standard normal number out of two uniform ones."""
    return F.sqrt(-2 * F.ln(hash_uniform(i, stream, seed))) * F.cos(2 * math.pi * hash_uniform(i, stream + 1, seed))


def emission_draws(areas: DataFrame, factors: dict[str, tuple[float, float]], draws: int = 20_000, seed: int = 0, potentials: dict[str, float] = POTENTIALS) -> DataFrame:
    """A-36: Monte-Carlo tonnes per species for each row's area_ha: straw 5 to 7.5 t/ha, dry share .8 to .9, burned share .7 to .9, factors normal and at least a tenth of their mean.

    The numbers of a draw depend on its number alone, so areas share their draws. Draws are dealt out in thousands.
    """
    block = 1_000
    dealt = areas.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(-(-draws // block) - 1)))).repartition(*areas.columns, "_block")
    rows = dealt.withColumn("draw", F.explode(F.sequence(F.col("_block") * block, F.least((F.col("_block") + 1) * block, F.lit(draws)) - 1))).drop("_block")
    i = F.col("draw").cast("long")
    uniform = lambda a, b, k: a + (b - a) * hash_uniform(i, k, seed)
    df = rows.withColumn("dry_matter_t", F.col("area_ha") * uniform(5.0, 7.5, 1) * uniform(0.8, 0.9, 2) * uniform(0.7, 0.9, 3))
    for k, (species, (mean, deviation)) in enumerate(factors.items()):
        factor = F.greatest(F.lit(mean) + deviation * hash_normal(i, 10 + 2 * k, seed), F.lit(0.1 * mean))
        df = df.withColumn(f"{species}_t", F.col("dry_matter_t") * factor / 1000)
    known = [F.col(f"{s}_t") * g for s, g in potentials.items() if s in factors]
    return df.withColumn("co2e_t", sum(known[1:], known[0]) if known else F.lit(0.0))


def draw_summary(df: DataFrame, columns: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """A-36: 5 %, 50 % and 95 % of each column, by keys."""
    wide = df.groupBy(*keys).agg(*[F.percentile(c, F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))).alias(c) for c in columns])
    entries = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c)[0].alias("p05"), F.col(c)[1].alias("median"), F.col(c)[2].alias("p95")) for c in columns])
    return wide.select(*keys, F.inline(entries))
