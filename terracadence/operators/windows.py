"""Window operators over one entity's observations (W-01 to W-29).

Frames are ordered by integer microseconds, so rows of the same instant form a block that does not see itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPSILON = 1e-6


def before(keys: list[str], order: str = "ts_us"):
    """Everything strictly earlier than the row's instant."""
    return Window.partitionBy(*keys).orderBy(order).rangeBetween(Window.unboundedPreceding, -1)


def previous(df: DataFrame, keys: list[str], value: Column, ok: Column, name: str, order: str = "ts_us", tie: str = "obs_id") -> DataFrame:
    """W-01, W-02: the latest eligible, non-null value strictly before the row, ties of an instant to the greatest tie key; and its instant."""
    held = F.max(F.when(ok & value.isNotNull(), F.struct(F.col(order), F.col(tie), value.alias("v")))).over(before(keys, order))
    return df.withColumn(f"{name}_prev", held["v"]).withColumn(f"{name}_prev_ts", held[order])


def change(df: DataFrame, value: Column, name: str, epsilon: float = EPSILON) -> DataFrame:
    """W-03: difference to the previous value, and relative to its size where that is not near 0."""
    prev = F.col(f"{name}_prev")
    relative = F.when(F.abs(prev) > epsilon, (value - prev) / F.abs(F.when(F.abs(prev) > epsilon, prev)))
    return df.withColumn(f"{name}_delta", value - prev).withColumn(f"{name}_pct_change", relative)


def valid_history(df: DataFrame, keys: list[str], value: Column, ok: Column, name: str, keep: int = 3, order: str = "ts_us", tie: str = "obs_id") -> DataFrame:
    """W-04 to W-07 build on this: the last keep eligible values strictly before the row, oldest first, as {name}_hist (ts, v)."""
    entry = F.when(ok & value.isNotNull(), F.struct(F.col(order).alias("ts"), F.col(tie).alias("tie"), value.cast("double").alias("v")))
    # each eligible row with the ones before it; the latest such chain of an earlier instant is carried to the row
    own = f"partition by {', '.join(f'`{k}`' for k in keys)} order by `{order}`, `{tie}`"
    df = df.withColumn("_e", entry)
    df = df.withColumn("_c", F.when(F.col("_e").isNotNull(), F.struct("_e", *[F.expr(f"lag(_e, {k}) ignore nulls over ({own})").alias(f"e{k}") for k in range(1, keep)])))
    df = df.withColumn("_h", F.max("_c").over(before(keys, order)))
    chain = F.array(*[F.col(f"_h.e{k}") for k in range(keep - 1, 0, -1)], F.col("_h._e"))
    return df.withColumn(f"{name}_hist", F.transform(F.array_compact(chain), lambda e: F.struct(e["ts"].alias("ts"), e["v"].alias("v")))).drop("_e", "_c", "_h")


def _mean(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x) / F.size(values)


def valid_window_stats(df: DataFrame, value: Column, name: str, order: str = "ts_us") -> DataFrame:
    """W-04 to W-07 from {name}_hist: change over two valid observations, means over the last 2 and 3, population deviation and slope per day over 3.

    The current value counts where it is present; where it is missing the means of the earlier ones still show, the slope does not.
    """
    hist = F.transform(F.col(f"{name}_hist"), lambda e: e["v"])
    present = value.isNotNull()
    seq = F.when(present, F.concat(hist, F.array(value.cast("double")))).otherwise(hist)
    last = lambda n: F.slice(seq, F.greatest(F.lit(1), F.size(seq) - n + 1), F.lit(n))
    out = df.withColumn(f"{name}_delta_2obs", F.when(F.size(hist) >= 2, value - F.get(hist, F.size(hist) - 2)))
    for n in (2, 3):
        out = out.withColumn(f"{name}_rolling_mean_{n}", F.when(F.size(seq) >= n, _mean(last(n))))
    mean = _mean(last(3))
    spread = F.sqrt(_mean(F.transform(last(3), lambda x: (x - mean) * (x - mean))))
    out = out.withColumn(f"{name}_rolling_std_3", F.when(F.size(seq) >= 3, spread))
    days = F.concat(F.transform(F.slice(F.col(f"{name}_hist"), -2, 2), lambda e: e["ts"]), F.array(F.col(order)))
    days = F.transform(days, lambda t: (t - F.element_at(days, 1)) / 86_400_000_000)
    points = F.concat(F.slice(hist, -2, 2), F.array(value.cast("double")))
    md, mp = _mean(days), _mean(points)
    across = F.aggregate(F.arrays_zip(days.alias("d"), points.alias("p")), F.lit(0.0), lambda s, e: s + (e["d"] - md) * (e["p"] - mp))
    along = F.aggregate(days, F.lit(0.0), lambda s, d: s + (d - md) * (d - md))
    return out.withColumn(f"{name}_slope_last_3", F.when(present & (F.size(hist) >= 2), F.try_divide(across, along)))


def running_peak(df: DataFrame, keys: list[str], value: Column, ok: Column, name: str, order: str = "ts_us") -> DataFrame:
    """W-08: greatest eligible value so far (the row's own included), the earliest instant that had it, drop from it, its share, and days since."""
    own = F.when(ok & value.isNotNull(), F.struct(value.cast("double").alias("v"), (-F.col(order)).alias("t")))
    peak = F.greatest(F.max(own).over(before(keys, order)), own)
    v = F.col(f"{name}_peak")
    out = df.withColumn(f"{name}_peak", peak["v"]).withColumn(f"{name}_peak_ts", -peak["t"])
    return out.withColumns({f"{name}_drop_from_peak": value - v, f"{name}_drop_fraction": F.try_divide(value - v, F.when(F.abs(v) > EPSILON, F.abs(v))), f"{name}_days_since_peak": (F.col(order) - F.col(f"{name}_peak_ts")) / 86_400_000_000})


def observation_number(df: DataFrame, keys: list[str], order: str = "ts_us") -> DataFrame:
    """W-09, W-23: dense number of the instant, days since the first, and whether the instant repeats."""
    return df.withColumns({
        "observation_number": F.dense_rank().over(Window.partitionBy(*keys).orderBy(order)).cast("long"),
        "days_since_first": (F.col(order) - F.min(order).over(Window.partitionBy(*keys))) / 86_400_000_000,
        "duplicate_timestamp": F.count(F.lit(1)).over(Window.partitionBy(*keys, order)) > 1,
    })


def neighbours(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """W-10, W-14: prev_* and next_* of the rows beside."""
    w = Window.partitionBy(*keys).orderBy(*order)
    row = F.struct(*columns)
    before_, after = F.lag(row).over(w), F.lead(row).over(w)
    return df.withColumns({f"prev_{c}": before_[c] for c in columns} | {f"next_{c}": after[c] for c in columns})


def first_transition(df: DataFrame, keys: list[str], order: str, value: Column, reached: float, below: float, tie: str | None = None) -> DataFrame:
    """W-11 to W-13: running maximum, the first instant at which it has reached one level and the value lies under another, and whether the row is at or after it."""
    w = Window.partitionBy(*keys).orderBy(*([order, tie] if tie else [order])).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("running_max", F.max(value).over(w))
    hit = F.coalesce((F.col("running_max") >= reached) & (value < below), F.lit(False))
    df = df.withColumn("transition", F.min(F.when(hit, F.col(order))).over(Window.partitionBy(*keys)))
    return df.withColumn("after_transition", F.coalesce(F.col(order) >= F.col("transition"), F.lit(False)))


def merge_intervals(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """W-15, A-27: the union of closed intervals as disjoint ones; touching intervals join."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def collapse_runs(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """W-16: consecutive equal values as one row (first and last order value, rows); NULL values are skipped and break nothing."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.where(F.col(value).isNotNull()).withColumn("_new", F.when(F.lag(value).over(w) == F.col(value), 0).otherwise(1))
    df = df.withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*keys, "_run", value).agg(F.min(order[0]).alias("run_start"), F.max(order[0]).alias("run_end"), F.count(F.lit(1)).alias("n_rows")).drop("_run")


def complete_sum(df: DataFrame, keys: list[str], order: list[str], value: str, n: int, name: str) -> DataFrame:
    """W-17: sum of the last n rows, NULL unless all n are present and not NULL."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == n, F.sum(value).over(w)))


def dry_days(df: DataFrame, keys: list[str], order: str, rain: str, limit: float = 1.0, days: int = 7, name: str = "dry_days") -> DataFrame:
    """W-18, W-19: days with less rain than limit among the last complete ones, NULL with a gap."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(1 - days, 0)
    dry = F.sum(F.when(F.col(rain) < limit, 1).otherwise(0)).over(w)
    return df.withColumn(name, F.when(F.count(rain).over(w) == days, dry))


def fill_capacity(df: DataFrame, keys: list[str], order: list[Column], size: str, capacity: float) -> DataFrame:
    """W-20: rows in order while the running size stays within capacity, the first one always."""
    w = Window.partitionBy(*keys).orderBy(*order)
    df = df.withColumn("running_size", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.row_number().over(w))
    return df.where((F.col("running_size") <= capacity) | (F.col("_n") == 1)).drop("_n")


def top_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """W-21, W-22, T-04, T-05: the first k rows of each group (k may be a column: quotas); order must be total."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def keep_one(df: DataFrame, keys: list[str], order: list[Column]) -> tuple[DataFrame, DataFrame]:
    """W-24, U-02: the first row of each key, and the rows it displaced."""
    numbered = df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return numbered.where("_n = 1").drop("_n"), numbered.where("_n > 1").drop("_n")


def numbered_globally(df: DataFrame, order: list[Column], name: str = "row_rank") -> DataFrame:
    """row_number over the whole table without a single task: range partitions are counted, then numbered with their offsets.

    The partition of each row is written down (checkpointed) first, so both uses see the same.
    """
    from ..sources.staging import staged

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = staged(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    counts = placed.groupBy("_p").agg(F.count(F.lit(1)).alias("_c"))
    offsets = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    out = placed.join(F.broadcast(offsets), "_p")  # one row a partition
    return out.withColumn(name, F.row_number().over(Window.partitionBy("_p").orderBy(*order)) + F.col("_before")).drop("_p", "_before")


def running_totals(df: DataFrame, order: list[Column], sums: dict[str, str]) -> DataFrame:
    """Cumulative sums (name -> column) over the whole table in a total order, without a single task: as numbered_globally, with the sums of the partitions before."""
    from ..sources.staging import staged

    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = staged(df.repartitionByRange(n, *order).withColumn("_p", F.spark_partition_id()))
    parts = placed.groupBy("_p").agg(*[F.sum(c).alias(f"_s_{k}") for k, c in sums.items()])
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_p", *[F.coalesce(F.sum(f"_s_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in sums])
    w = Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = placed.join(F.broadcast(offsets), "_p")  # one row a partition
    return out.withColumns({k: F.sum(c).over(w) + F.col(f"_b_{k}") for k, c in sums.items()}).drop("_p", *[f"_b_{k}" for k in sums])


def deciles(df: DataFrame, order: list[Column], name: str = "decile", groups: int = 10) -> DataFrame:
    """W-25: equal slices of the rank range, the first rank in the first: greatest(1, ceil((rank - 1) * groups / (n - 1)))."""
    ranked = numbered_globally(df, order, "_rank")
    n = ranked.count()
    value = F.greatest(F.lit(1), F.ceil((F.col("_rank") - 1) * groups / F.lit(max(1, n - 1)))).cast("long")
    return ranked.withColumn(name, value).drop("_rank")


def quantile_bins(df: DataFrame, value: str, groups: int = 5, name: str = "bin") -> DataFrame:
    """W-26: right-closed bins between exact linear quantiles, the least value in the first; NULL values get none."""
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("v"))
    n = known.count()
    at = [(n - 1) * i / groups for i in range(1, groups)]
    wanted = sorted({int(p) + d for p in at for d in (1, 2)})
    held = {r.k: r.v for r in numbered_globally(known, [F.col("v")], "k").where(F.col("k").isin(wanted)).collect()} if n else {}  # two values an edge
    edges = [held[int(p) + 1] * (1 - p % 1) + held.get(int(p) + 2, 0.0) * (p % 1) for p in at] if n else None
    if edges is None:
        return df.withColumn(name, F.lit(None).cast("long"))
    number = sum((F.col(value) > e).cast("long") for e in edges) + 1
    return df.withColumn(name, F.when(F.col(value).isNotNull(), number))


def thin_dates(df: DataFrame, keys: list[str], date: str, gap: int = 4) -> DataFrame:
    """W-27: dates kept in turn if they lie gap days or more after the last kept one. The dates of a key are few, and one fold."""
    dates = F.sort_array(F.collect_set(F.datediff(F.col(date), F.lit("1970-01-01").cast("date"))))
    none = F.expr("cast(array() as array<int>)")
    kept = F.aggregate(dates, none, lambda a, d: F.when((F.size(a) == 0) | (F.try_element_at(a, F.lit(-1)) + gap <= d), F.concat(a, F.array(d))).otherwise(a))
    days = df.groupBy(*keys).agg(kept.alias("_k")).select(*keys, F.explode("_k").alias("_d"))
    return days.select(*keys, F.date_add(F.lit("1970-01-01").cast("date"), F.col("_d")).alias(date))


def interpolate(points: DataFrame, grid: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """W-28, F-38: values of curves at the places of grid (keys, at), linear between points and constant beyond them."""
    both = points.select(*keys, at, F.col(value).alias("v"), F.lit(0).alias("asked")).unionByName(grid.select(*keys, at, F.lit(None).cast("double").alias("v"), F.lit(1).alias("asked")))
    point = F.when(F.col("v").isNotNull(), F.struct(F.col(at).alias("x"), F.col("v")))
    w = Window.partitionBy(*keys).orderBy(at, "asked")
    low = F.last(point, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    high = F.first(point, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumn("lo", low).withColumn("hi", high).where("asked = 1")
    inside = F.col("lo.v") + (F.col("hi.v") - F.col("lo.v")) * (F.col(at) - F.col("lo.x")) / F.when(F.col("hi.x") != F.col("lo.x"), F.col("hi.x") - F.col("lo.x"))
    return both.select(*keys, at, F.coalesce(inside, F.col("lo.v"), F.col("hi.v")).alias(value))


def envelope(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """W-29: least, mean and greatest value per key."""
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.avg(value).alias("mean"), F.max(value).alias("high"))


def modal_class(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """W-34: the most frequent label of each key, ties to the first in alphabet."""
    counts = df.where(F.col(label).isNotNull()).groupBy(*keys, label).count()
    return top_per_group(counts, keys, [F.col("count").desc(), F.col(label)], 1).drop("count")
