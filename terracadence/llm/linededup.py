"""Exact set-similarity join of lines (DataFrame functions only)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, staged, text_of

#: Cells of the word frequency table, and of the filters over keys. Both bound what a task gets, whatever the input.
COUNT_CELLS, FILTER_CELLS = 1 << 18, 1 << 20
#: Postings of one key that a window looks at together, and earlier ones that each looks at.
GROUP_ROWS, LOOK_BACK = 2_048, 3


def _pieces(text: Column) -> Column:
    """The words of a text without line feeds, and empty strings. One without the rarer white space is cut at single spaces, which needs no pattern."""
    odd = F.lit(False)
    for space in "\t\x0b\x0c\r":
        odd = odd | F.contains(text, F.lit(space))
    return F.when(odd, F.split(text, SPACE)).otherwise(F.split(text, " "))


def words(text: Column) -> Column:
    """The words of a line."""
    return F.array_remove(_pieces(text), "")


def _has_word(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\x0c\r\n")) != ""


def _documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc, tag, text): the tag, 31 bits of the text's hash, tells apart rows that repeat an id with another text."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc"), F.hash(text).bitwiseAND(0x7FFFFFFF).cast("long").alias("tag"), text.alias("text"))


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, loc, line) of the lines that hold a word; loc is the tag and, in its lower 32 bits, the number of the line."""
    rows = docs.where("doc is not null").select("doc", "tag", F.posexplode(F.split("text", "\n")).alias("ln", "line"))
    rows = rows.where(_has_word(F.col("line")))
    return rows.select("doc", F.shiftleft("tag", 32).bitwiseOR(F.col("ln").cast("long")).alias("loc"), "line")


def word_counts(docs: DataFrame) -> list[int]:
    """Occurrences of all words by cell of their hash."""
    all_words = docs.select(F.explode(_pieces(F.replace("text", F.lit("\n"), F.lit(" ")))).alias("w")).where("w <> ''")
    # few groups with several sums each are faster than as many groups as cells
    low = COUNT_CELLS >> 3
    cells = all_words.select(F.xxhash64("w").bitwiseAND(COUNT_CELLS - 1).cast("int").alias("c")).select(F.col("c").bitwiseAND(low - 1).alias("c"), F.shiftright("c", low.bit_length() - 1).alias("part"))
    counted = cells.groupBy("c").agg(*[F.count_if(F.col("part") == k).alias(f"n{k}") for k in range(8)]).toArrow()  # COUNT_CELLS / 8 rows
    out = [0] * COUNT_CELLS
    for k in range(8):
        for c, n in zip(counted["c"].to_pylist(), counted[f"n{k}"].to_pylist(), strict=True):
            out[k * low + c] = n
    return out


def _classes(counts: list[int]) -> list[int]:
    """31 classes of rarity, half a power of two each, above half the usual count."""
    usual = max(1, sorted(counts)[len(counts) // 2])
    return [min(30, max(0, int(2 * math.log2(max(1, c) / usual) + 2))) for c in counts]


def token_sets(lines: DataFrame, counts: list[int], percent: int) -> DataFrame:
    """Word sets of lines: doc, loc, n, k1, k2 (128-bit key), parity bitmap (folded, upper) and prefix, the rarest tokens.

    A token is one integer whose order is rarity: class of the word's frequency cell, then hash. The prefix holds 31
    bits of each hash: of two sets that share percent of their union, each has a shared token among its first
    (100 - percent) * n / 100 + 1. Each token flips one of 128 bits, so two bitmaps differ in at most as many bits as the sets
    differ in tokens. Words decide in the end.
    """
    table = F.split(F.lit(",".join(map(str, _classes(counts)))), ",").cast("array<bigint>")
    shift = lambda x, by: F.call_function("shiftleft", x, by)
    none, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    rarity = lambda h: shift(F.coalesce(F.get(table, h.bitwiseAND(COUNT_CELLS - 1).cast("int")), none), F.lit(57))
    hashes = F.array_remove(F.array_distinct(F.transform(_pieces(F.col("line")), lambda w: F.xxhash64(w))), F.xxhash64(F.lit("")))
    rows = lines.select("doc", "loc", hashes.alias("h"))
    tokens = F.sort_array(F.transform("h", lambda h: rarity(h).bitwiseOR(F.shiftrightunsigned(h, 7))))
    rows = rows.select("doc", "loc", tokens.alias("tokens")).withColumn("n", F.size("tokens"))
    prefix = F.slice("tokens", F.lit(1), F.floor((100 - percent) * F.col("n") / 100).cast("int") + 1)
    place = lambda t: t.bitwiseAND(63).cast("int")
    folded = F.aggregate("tokens", none, lambda a, t: a.bitwiseXOR(shift(one, place(t))))
    upper = F.aggregate("tokens", none, lambda a, t: a.bitwiseXOR(shift(F.shiftright(t, 6).bitwiseAND(1), place(t))))
    return rows.select(
        "doc", "loc", "n", F.xxhash64("tokens").alias("k1"), F.xxhash64(F.lit(7), F.col("tokens")).alias("k2"), folded.alias("folded"), upper.alias("upper"),
        F.transform(prefix, lambda t: t.bitwiseAND(0x7FFFFFFF).cast("int")).alias("prefix"),
    )


def _postings(sets: DataFrame) -> DataFrame:
    """A row (token, pos, prev, doc, loc, n, folded, upper) for each token of a prefix; prev: the token before, null for the first."""
    rows = sets.select("doc", "loc", "n", "folded", "upper", "prefix", F.posexplode("prefix").alias("pos", "token"))
    return rows.withColumn("prev", F.get("prefix", F.col("pos") - 1)).drop("prefix")


def _apart(a: str, b: str) -> Column:
    """Bits in which two bitmaps differ: never more than the tokens in which the sets do."""
    folded, upper = (F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}")) for c in ("folded", "upper"))
    return F.bit_count(upper) + F.bit_count(folded.bitwiseXOR(upper))


def _may_match(a: str, b: str, percent: int) -> Column:
    """Length, bitmap and position filters on a pair of postings, the cheaper ones first."""
    n, m, i, j = (F.col(c) for c in (f"{a}.n", f"{b}.n", f"{a}.pos", f"{b}.pos"))
    length = 100 * F.least(n, m) >= percent * F.greatest(n, m)
    fewest = F.bit_count(F.col(f"{a}.folded").bitwiseXOR(F.col(f"{b}.folded")))
    close = lambda apart: (100 + percent) * apart <= (100 - percent) * (n + m)
    # tokens before the shared one are lost to at least one side's rest
    rest = F.least(n - i, m - j) + F.least(i, j)
    position = (100 + percent) * rest >= percent * (n + m)
    return close(fewest) & length & position & close(_apart(a, b))


def _opens(a: str, b: str) -> Column:
    """The token opens a run that both sets have, so a pair meets once a run."""
    return ~F.col(f"{a}.prev").eqNullSafe(F.col(f"{b}.prev")) | F.col(f"{a}.prev").isNull()


def _among(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """A first, bounded look: the rows that share a cell with one of keys."""
    cell = F.pmod(F.xxhash64(*on), F.lit(FILTER_CELLS))
    cells = keys.select(cell.alias("cell")).distinct()  # FILTER_CELLS rows at most
    return rows.withColumn("cell", cell).join(F.broadcast(cells), "cell", "left_semi").drop("cell")


def _earlier(a: str, b: str) -> Column:
    """b stands before a."""
    return (F.col(f"{b}.doc") < F.col(f"{a}.doc")) | ((F.col(f"{b}.doc") == F.col(f"{a}.doc")) & (F.col(f"{b}.loc") < F.col(f"{a}.loc")))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc, loc, line) of the wanted places, read again from the texts."""
    lines = _among(_lines(_among(docs, wanted, "doc")), wanted, "doc", "loc")
    return lines.join(wanted.select("doc", "loc"), ["doc", "loc"], "left_semi")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The line (doc, loc) of each pair (doc, loc, doc2, loc2) whose word sets have Jaccard similarity of percent or more."""
    both = pairs.join(sets, ["doc", "loc"]).join(sets.toDF("doc2", "loc2", "words2"), ["doc2", "loc2"])
    a, b = F.size("words"), F.size("words2")
    meet = F.size(F.array_intersect("words", "words2"))
    return both.where(100 * meet >= percent * (a + b - meet)).select("doc", "loc").distinct()


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(doc, tag, ln) of every line that has an earlier line (smaller id, then hash of the text, then number of the line) of Jaccard similarity percent or more.

    1. Lines become token sets ordered by rarity; of equal sets (128-bit key) the first line stands for all.
    2. Prefixes of distinct sets meet by token under length, position and bitmap filters; a semi-join keeps the sets that
       may have a partner, so no pair leaves it. Their words are read again, once.
    3. Among those, a token's postings stand in reading order and each looks at the first one and at the three before
       it. The partner whose bitmap is nearest is verified on the words themselves, which settles all but a few lines of
       a group of variants. Large groups are cut into parts for this.
    4. Lines still open are verified with the other partners they looked at; what is open then meets all earlier ones
       of its tokens under the same filters and is verified with every partner left.
    5. A line goes if it is not the first of its set, or if its set goes.
    """
    slim = _documents(docs, id_col, text_col)
    line = ["doc", "loc"]
    sets = staged(token_sets(_lines(slim), word_counts(slim), percent))
    first = sets.groupBy("k1", "k2").agg(F.min(F.struct("doc", "loc", "n", "folded", "upper", "prefix")).alias("f"), F.count(F.lit(1)).alias("copies"))
    distinct = staged(first.select("k1", "k2", "copies", "f.*"))
    # smaller sets match equal ones only
    listed = distinct.where(100 * F.col("n") >= percent * (F.col("n") + 1)).select("doc", "loc", "n", "folded", "upper", "prefix")
    # both sides are the same rows under the same names, so they are dealt out once
    a, b = _postings(listed).drop("prev").alias("a"), _postings(listed).drop("prev").alias("b")
    meets = (F.col("a.token") == F.col("b.token")) & _may_match("a", "b", percent)
    other = (F.col("a.loc") != F.col("b.loc")) | (F.col("a.doc") != F.col("b.doc"))
    likely = staged(a.join(b, meets & other, "left_semi").select(*line).distinct())
    near = _postings(_among(listed, likely, *line).join(likely, line, "left_semi"))
    sizes = near.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    near = staged(near.join(sizes, "token"))
    sets_of_words = staged(_texts(slim, likely).select(*line, F.array_distinct(words(F.col("line"))).alias("words")))

    part = F.when(F.col("m") > GROUP_ROWS, F.pmod(F.xxhash64("doc"), F.ceil(F.col("m") / (GROUP_ROWS // 2)))).otherwise(0)
    at = Window.partitionBy("token", "part").orderBy(*line)
    own = F.struct(*line, "n", "pos", "prev", "folded", "upper")
    seen = near.withColumn("part", part).withColumn("seen", F.array(F.first(own).over(at), *[F.lag(own, k).over(at) for k in range(1, LOOK_BACK + 1)]))
    seen = seen.select(own.alias("a"), "seen")
    tried = seen.select("a", F.explode("seen").alias("b")).where(F.col("b").isNotNull()).where(_opens("a", "b") & _earlier("a", "b") & _may_match("a", "b", percent))
    met = staged(tried.select("a.doc", "a.loc", F.col("b.doc").alias("doc2"), F.col("b.loc").alias("loc2"), (-_apart("a", "b")).alias("alike")).distinct())
    best = met.groupBy(*line).agg(F.max(F.struct("alike", "doc2", "loc2")).alias("m")).select(*line, "m.doc2", "m.loc2")
    best = staged(best)
    settled = staged(_verified(best, sets_of_words, percent))

    # the other partners seen, for lines that are still open
    others = staged(met.drop("alike").join(settled, line, "left_anti").join(best, [*line, "doc2", "loc2"], "left_anti"))
    if not others.isEmpty():
        settled = staged(settled.unionByName(_verified(others, sets_of_words, percent)).distinct())
    # groups no larger than what each member looked at have been seen whole
    large = near.where(F.col("m") > LOOK_BACK + 1)
    further = large.join(settled, line, "left_anti").alias("a").join(large.alias("b"), meets & _opens("a", "b") & _earlier("a", "b"))
    pairs = further.select("a.doc", "a.loc", F.col("b.doc").alias("doc2"), F.col("b.loc").alias("loc2")).distinct()
    pairs = staged(pairs.join(met, [*line, "doc2", "loc2"], "left_anti"))
    gone = settled if pairs.isEmpty() else settled.unionByName(_verified(pairs, sets_of_words, percent)).distinct()
    groups = distinct.where("copies > 1").select("k1", "k2", F.col("doc").alias("doc2"), F.col("loc").alias("loc2"))
    again = _among(sets.select(*line, "k1", "k2"), groups, "k1").join(groups, ["k1", "k2"]).where("doc <> doc2 or loc <> loc2").select(*line)
    return gone.unionByName(again).distinct().select("doc", F.shiftright("loc", 32).alias("tag"), F.col("loc").bitwiseAND((1 << 32) - 1).cast("int").alias("ln"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """The input with repeated lines taken out of the texts; all rows and columns stay, n_lines and n_removed follow.

    Lines end at a line feed and are sets of words. Lines without words stay and match nothing; so do null texts.
    Ids are integers. Rows with a null id come through unchanged; rows that repeat an id and a text lose the same
    lines, of rows that repeat an id alone each is a document of its own. A text that loses all its lines is empty; a
    very long one costs time in proportion. An input column named n_lines or n_removed keeps its values, and that
    count is left out. No rows give none.
    """
    gone = repeated_lines(docs, id_col, text_col, percent).groupBy("doc", "tag").agg(F.sort_array(F.collect_list("ln")).alias("gone"))  # bounded by the document's lines
    gone = staged(gone.withColumnRenamed("doc", "gone_doc").withColumnRenamed("tag", "gone_tag"))
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER_CELLS))
    cells = F.broadcast(gone.select(cell("gone_doc").alias("cell")).distinct())  # FILTER_CELLS rows at most
    text = F.col(f"`{text_col}`")
    rest = [c for c in docs.columns if c != text_col]  # the text moves once
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col(id_col).cast("long").alias("doc"), text.alias("text"))
    rows = rows.withColumn("cell", cell("doc"))
    tag = F.hash(F.coalesce("text", F.lit(""))).bitwiseAND(0x7FFFFFFF).cast("long")
    hit = rows.join(cells, "cell", "left_semi").withColumn("tag", tag)
    hit = hit.join(gone, (F.col("doc") == F.col("gone_doc")) & (F.col("tag") == F.col("gone_tag")), "left")
    lines = F.split("text", "\n")
    # the runs of lines between those that go
    ends = F.arrays_zip(F.concat(F.array(F.lit(-1)), "gone").alias("a"), F.concat("gone", F.array(F.size(lines))).alias("b"))
    kept = F.array_join(F.flatten(F.transform(ends, lambda x: F.slice(F.col("lines"), x["a"] + 2, x["b"] - x["a"] - 1))), "\n")
    hit = hit.withColumn("lines", lines).withColumn("kept", F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept))
    removed = F.coalesce(F.size("gone"), F.lit(0)).cast("long")
    hit = hit.select("row", "text", F.col("kept"), removed.alias("removed"))
    others = rows.join(cells, "cell", "left_anti").select("row", "text", F.col("text").alias("kept"), F.lit(0).cast("long").alias("removed"))
    total = (F.octet_length(F.coalesce("text", F.lit(""))) - F.octet_length(F.replace(F.coalesce("text", F.lit("")), F.lit("\n"))) + 1).cast("long")
    counts = {"n_lines": total, "n_removed": F.col("removed")}
    own = [F.col("kept").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return hit.unionByName(others).select(*own, *[v.alias(k) for k, v in counts.items() if k not in docs.columns])
