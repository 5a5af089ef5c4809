"""Validation and audits (V-01 to V-07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.texts import reasons


def schema_problems(df: DataFrame, expected: list[tuple[str, str]]) -> list[str]:
    """V-01: missing, unexpected, retyped and misplaced columns, from the schema alone."""
    have = dict(df.dtypes)
    out = [f"missing {c}" for c, _ in expected if c not in have] + [f"unexpected {c}" for c in df.columns if c not in dict(expected)]
    out += [f"{c} is {have[c]}, not {t}" for c, t in expected if c in have and have[c] != t]
    return out + (["order"] if not out and df.columns != [c for c, _ in expected] else [])


def dataset_audit(df: DataFrame, key: list[str], required: list[str], ranges: dict[str, tuple[float, float]], leaks: list[tuple[str, str]] | None = None) -> DataFrame:
    """V-01: one row of counts: rows, missing required values, values out of range, repeated keys, and pairs (later, not after) out of order."""
    checks = [F.count(F.lit(1)).alias("n_rows")]
    checks += [F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in required]
    checks += [F.count_if(~F.col(c).between(*r)).alias(f"range_{c}") for c, r in ranges.items()]
    checks += [F.count_if(F.col(a) > F.col(b)).alias(f"leak_{a}") for a, b in leaks or []]
    repeated = df.groupBy(*key).count().agg(F.coalesce(F.sum(F.when(F.col("count") > 1, F.col("count"))), F.lit(0)).alias("repeated_keys"))
    return df.agg(*checks).crossJoin(repeated)


def errors(pairs: list[tuple[Column, str | Column]]) -> Column:
    """V-02, V-04: array of the errors of a row."""
    return reasons(pairs)


def label_errors(field: Column, at: Column, label: Column, source: Column, tier: Column, labels: tuple[str, ...], tiers: dict[str, tuple[str, ...]]) -> Column:
    """V-02: missing identity, unknown label, unknown source, and a tier that the source cannot give."""
    fits = F.lit(False)
    for s, allowed in tiers.items():
        fits = fits | ((source == s) & tier.isin(*allowed))
    return errors([(field.isNull() | (field == ""), "FIELD_MISSING"), (at.isNull(), "TIME_MISSING"), (~F.coalesce(label.isin(*labels), F.lit(False)), "LABEL_UNKNOWN"), (~F.coalesce(source.isin(*tiers), F.lit(False)), "SOURCE_UNKNOWN"), (F.coalesce(source.isin(*tiers), F.lit(False)) & ~F.coalesce(fits, F.lit(False)), "TIER_NOT_OF_SOURCE")])


def import_conflicts(new: DataFrame, existing: DataFrame, key: list[str]) -> DataFrame:
    """V-03: keys that repeat within the new rows or are already present, with the kind of conflict."""
    within = new.groupBy(*key).count().where("count > 1").select(*key, F.lit("REPEATED_IN_FILE").alias("conflict"))
    known = new.select(*key).distinct().join(existing.select(*key).distinct(), key, "left_semi").select(*key, F.lit("ALREADY_KNOWN").alias("conflict"))
    return within.unionByName(known)


def gates(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """V-05: per gate the rows that fail it and whether it passes; a missing condition fails."""
    wide = df.agg(*[F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()])
    return wide.select(F.inline(F.array(*[F.struct(F.lit(n).alias("gate"), F.col(n).alias("failures"), (F.col(n) == 0).alias("passed")) for n in checks])))


def grouped_split(df: DataFrame, group: str, label: str, shares: tuple[float, float] = (0.6, 0.2), seed: str = "0") -> DataFrame:
    """V-06: (group, split): groups are stratified by their modal label and dealt in hash order: floor(n * share) to train, then validation, the rest to test."""
    from .windows import modal_class

    modal = modal_class(df, [group], label).withColumnRenamed(label, "stratum")
    w = Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.col(group).cast("string"), F.lit(f":{seed}"))), group)
    n = F.count(F.lit(1)).over(Window.partitionBy("stratum"))
    ranked = modal.withColumn("_r", F.row_number().over(w)).withColumn("_n", n)
    a = F.floor(F.col("_n") * shares[0])
    b = a + F.floor(F.col("_n") * shares[1])
    return ranked.select(group, "stratum", F.when(F.col("_r") <= a, "train").when(F.col("_r") <= b, "validation").otherwise("test").alias("split"))


def disjoint(a: DataFrame, b: DataFrame, key: list[str]) -> bool:
    """U-05."""
    return a.select(*key).intersect(b.select(*key)).isEmpty()


def shared_keys(splits: DataFrame, key: str, split: str) -> DataFrame:
    """U-05 for any number of splits: pairs of splits and how many keys both hold; none where they are disjoint."""
    held = splits.select(key, split).distinct()
    sides = held.groupBy(key).agg(F.sort_array(F.collect_set(split)).alias("s")).where(F.size("s") > 1)  # splits are few
    pairs = F.flatten(F.transform("s", lambda a, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sides.select(F.inline(pairs)).groupBy("a", "b").agg(F.count(F.lit(1)).alias("keys"))


def transition_audit(df: DataFrame, key: str, order: list[str], state: str, allowed: list[tuple[str, str]]) -> DataFrame:
    """X-03 on stored rows: each change of state with whether the table of transitions allows it."""
    w = Window.partitionBy(key).orderBy(*order)
    moves = df.withColumn("from_state", F.lag(state).over(w)).where(F.col("from_state").isNotNull())
    ok = F.lit(False)
    for a, b in allowed:
        ok = ok | ((F.col("from_state") == a) & (F.col(state) == b))
    return moves.withColumn("allowed", ok)


def artifact_status(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """V-07, K-08, F-35: manifest rows (path, sha256) against files (path, content): MATCH, MATCH_AFTER_LINE_ENDINGS, POINTER (a large-file stub), MISMATCH or MISSING."""
    text = F.col("content").cast("string")
    unix = F.sha2(F.replace(text, F.lit("\r\n"), F.lit("\n")).cast("binary"), 256)
    have = files.select("path", F.sha2("content", 256).alias("_raw"), unix.alias("_unix"), text.startswith("version https://git-lfs").alias("_stub"))
    out = manifest.join(have, "path", "left")
    status = F.when(F.col("_raw").isNull(), "MISSING").when(F.col("_raw") == F.col("sha256"), "MATCH").when(F.col("_stub"), "POINTER").when(F.col("_unix") == F.col("sha256"), "MATCH_AFTER_LINE_ENDINGS").otherwise("MISMATCH")
    return out.withColumn("status", status).drop("_raw", "_unix", "_stub")
