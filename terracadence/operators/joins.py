"""As-of and lookup joins (J-01 to J-13, J-24 to J-32)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, payload: list[str], tolerance_us: int | None = None, tie: str | None = None, strict: bool = False, prefix: str = "asof_") -> DataFrame:
    """J-09, J-11, J-13: for each left row the latest right row at or before it (strictly before, if strict) within tolerance.

    Both sides are laid into one stream per key and the last right row is carried forward: one shuffle, no growth.
    Ties of an instant go to the greatest tie column. The tolerance is closed. Left rows without a match keep NULLs.
    """
    row = F.struct(F.col(right_ts).alias("_ts"), *([F.col(tie).alias("_tie")] if tie else []), *[F.col(c).alias(c) for c in payload])
    r = right.where(F.col(right_ts).isNotNull()).select(*keys, F.col(right_ts).alias("_at"), F.lit(1 if strict else 0).alias("_side"), *([F.col(tie).alias("_order")] if tie else [F.lit(0).alias("_order")]), row.alias("_r"))
    carried = F.struct(*[F.col(c) for c in left.columns])
    l = left.select(*keys, F.col(left_ts).alias("_at"), F.lit(0 if strict else 1).alias("_side"), F.lit(None).cast(r.schema["_order"].dataType).alias("_order"), carried.alias("_l"))
    both = l.unionByName(r, allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side", F.col("_order").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where(F.col("_l").isNotNull())
    if tolerance_us is not None:
        out = out.withColumn("_m", F.when(F.col("_m._ts") >= F.col("_at") - tolerance_us, F.col("_m")))
    return out.select("_l.*", F.col("_m._ts").alias(f"{prefix}ts"), *[F.col(f"_m.{c}").alias(f"{prefix}{c}") for c in payload])


def asof_with_status(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, payload: list[str], tolerance_us: int, names: tuple[str, str, str] = ("AVAILABLE", "NONE_WITHIN_TOLERANCE", "NOT_ACQUIRED"), **more) -> DataFrame:
    """J-10, G-12: as asof, with a status that tells a missing match from a key that has no right rows at all."""
    prefix = more.get("prefix", "asof_")
    out = asof(left, right, keys, left_ts, right_ts, payload, tolerance_us, **more)
    known = right.select(*keys).distinct().withColumn("_known", F.lit(True))
    out = out.join(known, keys, "left")
    status = F.when(F.col(f"{prefix}ts").isNotNull(), names[0]).when(F.col("_known"), names[1]).otherwise(names[2])
    return out.withColumn(f"{prefix}status", status).drop("_known")


def asof_compatible(df: DataFrame, keys: list[str], ts: str, tie: str, same: list[str], same_if_known: list[str], payload: list[str], prefix: str = "compat_") -> DataFrame:
    """J-12: the latest strictly earlier row of the key that agrees in the mandatory columns, and in the others where both are known.

    No pair of rows is made. Which optional columns a row knows is a pattern; a right row is filed once under each pattern
    with the values of the columns known to both, a left row looks its own pattern up once for each subset of what it
    knows. So n rows with m optional columns become at most 2 * 2 ** m * n (m is one or two), and each lookup is an as-of
    join in one shuffle. Rows with NULL in a key or mandatory column, or without a time, come back without a match; rows
    that repeat come back as often as they are.
    """
    c = F.col
    must = [*keys, *same]
    whole = F.lit(True)
    for k in [*must, ts]:
        whole = whole & c(k).isNotNull()
    optional = range(len(same_if_known))
    value = lambda k: c(same_if_known[k]).cast("string")
    known = sum([F.when(c(o).isNotNull(), 1 << k).otherwise(0) for k, o in enumerate(same_if_known)], F.lit(0))
    subsets = [[k for k in optional if n >> k & 1] for n in range(1 << len(same_if_known))]
    bits = lambda ks: sum(1 << k for k in ks)
    shared = lambda pattern, agreed: F.struct(F.lit(bits(pattern)).alias("pattern"), F.lit(bits(agreed)).alias("agreed"), F.array(*[value(k) for k in agreed]).cast("array<string>").alias("values"))

    def entry(pattern: list[int]) -> Column:
        cases = [(known.bitwiseAND(F.lit(bits(pattern))) == bits(agreed), shared(pattern, agreed)) for agreed in subsets if set(agreed) <= set(pattern)]
        return F.coalesce(*[F.when(fits, key) for fits, key in cases])

    filed = [entry(pattern) for pattern in subsets]
    asked = [F.when(known == bits(pattern), shared(pattern, agreed)) for pattern in subsets for agreed in subsets if set(agreed) <= set(pattern)]

    row = F.struct(c(ts).alias("_ts"), c(tie).alias("_tie"), *[c(p).alias(p) for p in payload])
    right = df.where(whole).select(*must, F.explode(F.array(*filed)).alias("_k"), c(ts).alias("_at"), F.lit(1).alias("_side"), row.alias("_r"))
    numbered = df.withColumn("_row", F.struct(*[c(k) for k in df.columns]))
    left = numbered.where(whole).select(*must, F.explode(F.array_compact(F.array(*asked))).alias("_k"), c(ts).alias("_at"), F.lit(0).alias("_side"), c("_row").alias("_l"))
    w = Window.partitionBy(*must, "_k").orderBy("_at", "_side", c("_r._tie").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    carried = left.unionByName(right, allowMissingColumns=True).withColumn("_m", F.last("_r", ignorenulls=True).over(w)).where(c("_l").isNotNull())
    # each row asked 2 ** (known columns) times, so a row that repeats can be told by its count
    best = carried.groupBy("_l").agg(F.max("_m").alias("_m"), F.count(F.lit(1)).alias("_n"))
    times = F.explode(F.array_repeat(F.lit(0), (c("_n") / F.pow(F.lit(2), sum([F.when(c(f"_l.{o}").isNotNull(), 1).otherwise(0) for o in same_if_known], F.lit(0)))).cast("int")))
    none = numbered.where(~whole).select(c("_row").alias("_l"), F.lit(None).cast(best.schema["_m"].dataType).alias("_m"))
    out = best.withColumn("_i", times).select("_l", "_m").unionByName(none)
    return out.select("_l.*", c("_m._ts").alias(f"{prefix}ts"), *[c(f"_m.{p}").alias(f"{prefix}{p}") for p in payload])


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """J-03: left join that fails if the right side repeats a key."""
    repeated = right.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if repeated:
        raise ValueError(f"right side repeats the key {[repeated[0][k] for k in keys]}")
    return left.join(right, keys, "left")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], fills: dict[str, object]) -> DataFrame:
    """J-04, J-08: left join; the columns in fills get the value given where there is no match."""
    out = left.join(right.select(*keys, *fills), keys, "left")
    return out.withColumns({c: F.col(c) if v is None else F.coalesce(F.col(c), F.lit(v)) for c, v in fills.items()})


def prior_period(df: DataFrame, keys: list[str], period: str, columns: list[str], prefix: str = "prior_") -> DataFrame:
    """J-24, J-31: the same key one period before."""
    back = df.select(*keys, (F.col(period) + 1).alias(period), *[F.col(c).alias(f"{prefix}{c}") for c in columns])
    return df.join(back, [*keys, period], "left")


def in_all_periods(df: DataFrame, keys: list[str], period: str, n: int) -> DataFrame:
    """J-25: keys present in n distinct periods."""
    return df.groupBy(*keys).agg(F.countDistinct(period).alias("_n")).where(F.col("_n") == n).drop("_n")


def with_reverse(matrix: DataFrame, a: str, b: str) -> DataFrame:
    """J-30: a travel matrix completed by its reverse; a pair given both ways keeps its own values."""
    others = [c for c in matrix.columns if c not in (a, b)]
    own = matrix.select(a, b, *others, F.lit(0).alias("_p"))
    back = matrix.select(F.col(b).alias(a), F.col(a).alias(b), *others, F.lit(1).alias("_p"))
    w = Window.partitionBy(a, b).orderBy("_p", *others)
    return own.unionByName(back).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_p")


def first_reason(pairs: list[tuple[Column, str]]) -> Column:
    """J-27: the first reason whose condition holds, NULL if none does."""
    out = F.when(F.coalesce(pairs[0][0], F.lit(False)), pairs[0][1])
    for c, name in pairs[1:]:
        out = out.when(F.coalesce(c, F.lit(False)), name)
    return out


def split_by_reason(df: DataFrame, pairs: list[tuple[Column, str]]) -> tuple[DataFrame, DataFrame]:
    """J-27, J-32: accepted rows, and rejected ones with their reason."""
    marked = df.withColumn("reject_reason", first_reason(pairs))
    return marked.where(F.col("reject_reason").isNull()).drop("reject_reason"), marked.where(F.col("reject_reason").isNotNull())


def without_active(jobs: DataFrame, active: DataFrame, keys: list[str]) -> DataFrame:
    """J-07, J-29: rows whose key has no active assignment."""
    return jobs.join(active.select(*keys).distinct(), keys, "left_anti")
