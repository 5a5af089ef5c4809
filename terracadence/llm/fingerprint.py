"""Canonical exact digest of documents (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, text_of

#: Cells of the bounded filter that keeps texts without an equal away from the byte comparison.
FILTER_CELLS = 1 << 20
#: Range buckets of document order: rows wanted in each, at most so many, and the step of the coarse index over their bounds.
BUCKET_ROWS, MAX_BUCKETS, COARSE = 4_000, 65_536, 256


def canonical(text: Column) -> Column:
    """Compatibility composition (NFKC), full case folding, NFKC again, then white-space runs to one space and none at the ends.

    The ICU library that Spark ships for its collations does the first three, called by the built-in java_method.
    """
    nfkc = lambda c: F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.call_function("java_method", F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"\p{IsWhite_Space}+", " "))


def wide_hash(text: Column) -> tuple[Column, Column]:
    """Two 64-bit xxhashes, the second under a seed of its own."""
    return F.xxhash64(text), F.xxhash64(F.lit(2), text)


def _shortened(canonical_text: Column, bits: int) -> tuple[Column, Column]:
    """The two hashes; with less than 64 bits (for tests of clashes) the first one cut to them, and 0."""
    h1, h2 = wide_hash(canonical_text)
    return (h1, h2) if bits == 64 else (F.shiftrightunsigned(h1, 64 - bits), F.lit(0).cast("long"))


def _hex(h1: Column, h2: Column) -> Column:
    return F.lower(F.concat(*[F.lpad(F.hex(h), 16, "0") for h in (h1, h2)]))


def digest(text: Column, bits: int = 64) -> Column:
    """128 bits as 32 lower-case hex digits. Texts that agree after canonical() have equal digests; empty and null texts have that of ''."""
    return _hex(*_shortened(canonical(text), bits))


def _classes(docs: DataFrame, id_col: str, text_col: str, bits: int = 64) -> DataFrame:
    """Rows (h1, h2, variant, group_id, group_size, clash) of all groups of two or more equal canonical texts, and one without a group for each hash of different texts.

    Hashes are grouped first. Texts whose hash occurs once leave through a filter of bounded size, the rest are
    compared by bytes: a hash group whose least and greatest text agree is one class (variant is null); one whose
    texts differ is divided by the texts themselves (variant is the text). Both steps combine on the map side, so a
    group of copies that holds a third of all rows moves as one row per task. bits below 64 truncate the hash, for
    tests of the second case. group_id is the smallest id, nulls aside.
    """
    text = canonical(text_of(text_col))
    h1, h2 = _shortened(F.col("c"), bits)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("c")).select("id", "c", h1.alias("h1"), h2.alias("h2"))
    groups = staged(rows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("group_size"), F.min("id").alias("group_id")).where("group_size > 1"))
    cell = F.pmod(F.col("h1"), F.lit(FILTER_CELLS))
    cells = groups.select(cell.alias("cell")).distinct()
    suspects = rows.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi")  # FILTER_CELLS rows at most
    extremes = suspects.groupBy("h1", "h2").agg(F.min("c").alias("least"), F.max("c").alias("most"))
    clashes = staged(extremes.where(F.col("least") != F.col("most")).select("h1", "h2"))
    plain = groups.join(clashes, ["h1", "h2"], "left_anti").select("h1", "h2", F.lit(None).cast("string").alias("variant"), "group_id", "group_size")
    if clashes.isEmpty():
        return plain.withColumn("clash", F.lit(False))
    divided = rows.join(clashes, ["h1", "h2"], "left_semi").groupBy("h1", "h2", F.col("c").alias("variant"))
    divided = divided.agg(F.min("id").alias("group_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1")
    alone = clashes.select("h1", "h2", F.lit(None).cast("string").alias("variant"), F.lit(None).cast(plain.schema["group_id"].dataType).alias("group_id"), F.lit(0).cast("long").alias("group_size"))
    return staged(plain.withColumn("clash", F.lit(False)).unionByName(divided.unionByName(alone).withColumn("clash", F.lit(True))))


def order_bounds(docs: DataFrame, id_col: str, bucket_rows: int = BUCKET_ROWS) -> list[int]:
    """The smallest id of each range bucket, ascending; MAX_BUCKETS at most."""
    ids = docs.select(F.col(id_col).cast("long").alias("id"))
    n = min(MAX_BUCKETS, -(-ids.count() // bucket_rows) or 1)
    firsts = ids.repartitionByRange(n, "id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("id").alias("id"))
    return sorted(r.id for r in firsts.collect() if r.id is not None)[:MAX_BUCKETS]


def next_in_order(docs: DataFrame, id_col: str, payload: list[str], following: list[str], bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Each row with the following columns of the next row by id as next_*; after the last comes the first.

    One exchange: rows are dealt to range buckets, and the first row of each bucket is also sent to the one before.
    Rows of equal id come in the order of their payload, null ids last.
    """
    bounds = order_bounds(docs, id_col, bucket_rows)
    key = F.col("id")
    if bounds:
        coarse, fine = F.array(*[F.lit(b) for b in bounds[::COARSE]]), F.lit(bounds)
        block = F.size(F.filter(coarse, lambda b: b <= key))
        within = F.size(F.filter(F.slice(fine, (block - 1) * COARSE + 1, F.lit(COARSE)), lambda b: b <= key))
        bucket = F.when(key.isNull(), len(bounds) - 1).otherwise((block - 1) * COARSE + within - 1)
        opens = key == F.element_at(fine, F.col("bucket") + 1)
        before = F.pmod(F.col("bucket") - 1, F.lit(len(bounds)))
    else:
        bucket, opens, before = F.lit(0), F.lit(False), F.lit(0)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), *payload).withColumn("bucket", bucket.cast("int"))
    own, lent = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("lent")), F.struct(before.cast("int").alias("b"), F.lit(1).alias("lent"))
    rows = rows.withColumn("to", F.explode(F.when(opens, F.array(own, lent)).otherwise(F.array(own)))).drop("bucket")
    order = Window.partitionBy("to.b").orderBy("to.lent", F.col("id").asc_nulls_last(), *[F.col(c).asc_nulls_first() for c in payload])
    return rows.withColumns({f"next_{c}": F.lead(c).over(order) for c in following}).where("to.lent = 0").drop("to")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Rows (h1, h2, variant, group_id, group_size) of all groups of two or more equal canonical texts, told apart by bytes."""
    return _classes(docs, id_col, text_col, bits).where("group_size > 1").drop("clash")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Per document: id, fingerprint, group_id and group_size (1 if no text is equal). Null text counts as empty."""
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t"), digest(text_of(text_col), bits).alias("fingerprint"))
    return with_groups(rows, _classes(docs, id_col, text_col, bits)).drop("t").withColumnRenamed("id", id_col)


def with_groups(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Join group_id and group_size to rows of id, t and fingerprint. Only where one fingerprint stands for different texts does the text take part in the join."""
    table = classes.withColumn("fingerprint", _hex(F.col("h1"), F.col("h2"))).drop("h1", "h2")
    plain = table.where("not clash").select("fingerprint", "group_id", "group_size")
    out = rows.join(plain, "fingerprint", "left")
    if not (divided := table.where("clash")).isEmpty():
        # null where the fingerprint is no clash: joins nothing, and most texts do not move
        marks = divided.select("fingerprint", F.lit(True).alias("clash")).distinct()
        out = out.join(marks, "fingerprint", "left").withColumn("variant", F.when(F.col("clash"), canonical(F.col("t"))))
        by_text = divided.where("group_size > 1").select("fingerprint", "variant", F.col("group_id").alias("own_id"), F.col("group_size").alias("own_size"))
        out = out.join(by_text, ["fingerprint", "variant"], "left")
        out = out.withColumns({"group_id": F.coalesce("own_id", "group_id"), "group_size": F.coalesce("own_size", "group_size")}).drop("own_id", "own_size", "clash", "variant")
    return out.withColumns({"group_id": F.coalesce("group_id", "id"), "group_size": F.coalesce("group_size", F.lit(1).cast("long"))})


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 64) -> DataFrame:
    """Fingerprint of each text and of its edit, whose second half comes from the start of the next document.

    Likeness of two digests is 1 if they are equal and 0 otherwise. A lone document is its own next; where no id is
    known at all the last row has no next, and takes an empty text. Ids are integers, null ones come last, in the order
    of their digests. Texts are taken whole. group_id is the smallest id of the same canonical text, compared by bytes
    where digests are equal; bits below 64 cut the digest, for tests of that.
    """
    base = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("t")).withColumn("fingerprint", digest(F.col("t"), bits))
    rows = next_in_order(base, "id", ["fingerprint", "t"], ["fingerprint", "t"])
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("t", F.lit(1), n - half), F.substr(F.coalesce("next_t", F.lit("")), F.lit(1), half))
    rows = rows.withColumn("n_chars", n.cast("long")).withColumn("edited", edited)
    rows = rows.select("id", "t", "n_chars", F.sha2(F.col("edited"), 256).alias("edited_sha256"), "fingerprint", digest(F.col("edited"), bits).alias("edited_fingerprint"), "next_fingerprint")
    rows = rows.withColumn("near_edited", (F.col("fingerprint") == F.col("edited_fingerprint")).cast("double"))
    rows = rows.withColumn("near_next", F.coalesce(F.col("fingerprint") == F.col("next_fingerprint"), F.lit(False)).cast("double")).drop("next_fingerprint")
    out = with_groups(rows, _classes(docs, id_col, text_col, bits))
    return out.select(F.col("id").alias(id_col), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "group_id", "group_size")
