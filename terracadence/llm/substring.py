"""Removal of repeated word spans by compacting paths of word k-mers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import sliced, staged
from .shingles import forget, mix, windows, word_hashes

#: Bits of the bitmap of repeated anchors that goes to every task (16 MB whatever the input), and words in an anchor.
BITMAP_BITS, ANCHOR = 27, 8
#: Edges that a task combines before it sends them on.
CHUNK = 2_000_000
FILTER_CELLS = 1 << 20
np.seterr(over="ignore")


def _words(text: str | None) -> np.ndarray:
    return word_hashes((text or "").encode().split())


def _anchors(hashes: np.ndarray, width: int) -> np.ndarray:
    """For each window, the start of its anchor: the leftmost smallest hash of ANCHOR words inside it."""
    small = windows(hashes, min(ANCHOR, width))
    inside = np.lib.stride_tricks.sliding_window_view(small, width - min(ANCHOR, width) + 1)
    return inside.argmin(1) + np.arange(len(inside)), small


def repeated_anchors(docs: DataFrame, width: int) -> np.ndarray:
    """Bitmap of the anchors that occur at two places or more. Equal windows choose equal anchors, so a window whose anchor is not marked occurs once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                got = []
                for text in whole.column("text").slice(at, 2000).to_pylist():
                    w = _words(text)
                    if len(w) >= width:
                        place, small = _anchors(w, width)
                        got.append(small[np.unique(place)])
                if got:
                    value, n = np.unique(np.concatenate(got), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(np.minimum(n, 2), pa.int64())], ["a", "n"])
        forget()

    repeated = docs.select("text").mapInArrow(run, "a long, n long").groupBy("a").agg(F.sum("n").alias("n")).where("n > 1")
    cell = F.shiftrightunsigned("a", 64 - BITMAP_BITS)
    marks = repeated.groupBy(F.shiftright(cell, 6).cast("int").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(shiftrightunsigned(a, %d) & 63 as int)))" % (64 - BITMAP_BITS)).alias("bits"))
    bitmap = np.zeros(1 << (BITMAP_BITS - 6), np.int64)
    found = marks.toArrow()  # as many rows as the bitmap has words at most
    bitmap[found["w"].to_numpy()] = found["bits"].to_numpy()
    return bitmap.view(np.uint64)


def _marked(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    cell = values >> np.uint64(64 - BITMAP_BITS)
    return bitmap[(cell >> np.uint64(6)).astype(np.int64)] >> (cell & np.uint64(63)) & np.uint64(1) != 0


#: A row: an edge at its place (length 0), or a path of length edges that also starts at an earlier place (h as dealt).
EDGE = ["h", "doc", "loc", "length", "odoc", "oloc"]
EDGE_SCHEMA = "h long, doc long, loc long, length long, odoc long, oloc long"


def _paths(doc: np.ndarray, loc: np.ndarray, length: np.ndarray, odoc: np.ndarray, oloc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Join edges (or paths) that follow one another in their document and, at the same distance, in the earlier one."""
    if not len(doc):
        return doc, loc, length, odoc, oloc
    order = np.lexsort((loc, doc))
    doc, loc, length, odoc, oloc = (x[order] for x in (doc, loc, length, odoc, oloc))
    follows = (doc[1:] == doc[:-1]) & (odoc[1:] == odoc[:-1]) & (loc[1:] - oloc[1:] == loc[:-1] - oloc[:-1]) & (loc[1:] == loc[:-1] + length[:-1])
    starts = np.flatnonzero(np.concatenate([[True], ~follows]))
    return doc[starts], loc[starts], np.add.reduceat(length, starts), odoc[starts], oloc[starts]


def _later(h: np.ndarray, doc: np.ndarray, loc: np.ndarray) -> tuple[np.ndarray, ...]:
    """Edges by hash and place, each place once (rows that repeat id and text bring it again); which are the first of their hash, and for each the position of that one."""
    order = np.lexsort((loc, doc, h))
    h, doc, loc = h[order], doc[order], loc[order]
    fresh = np.concatenate([[True], h[1:] != h[:-1]])
    once = fresh | np.concatenate([[True], (doc[1:] != doc[:-1]) | (loc[1:] != loc[:-1])])
    h, doc, loc, fresh = h[once], doc[once], loc[once], fresh[once]
    return h, doc, loc, fresh, np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0))


def _batch(cols: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], EDGE)


def edges(docs: DataFrame, width: int, bitmap) -> DataFrame:
    """Windows of width words as edges, those only whose anchor is repeated. Each task sends the earliest place of an edge; its later places in the task are known as such and leave as paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, got, size = bitmap.value, [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            h, doc, loc = (np.concatenate(x) for x in zip(*got, strict=True))
            h, doc, loc, fresh, first = _later(h, doc, loc)
            zero = np.zeros(int(fresh.sum()), np.int64)
            for at in range(0, len(zero), 200_000):
                s = slice(at, at + 200_000)
                yield _batch([h[fresh][s], doc[fresh][s], loc[fresh][s], zero[s], zero[s], zero[s]])
            rest = ~fresh
            paths = _paths(doc[rest], loc[rest], np.ones(int(rest.sum()), np.int64), doc[first][rest], loc[first][rest])
            if len(paths[0]):
                yield _batch([mix((paths[0] ^ paths[1]).view(np.uint64)).view(np.int64), *paths])

        for b in sliced(batches):
            for doc, tag, text in zip(b.column("doc").to_pylist(), b.column("tag").to_pylist(), b.column("text").to_pylist(), strict=True):
                w = _words(text)
                if doc is None or len(w) < width:
                    continue
                place, small = _anchors(w, width)
                at = np.flatnonzero(_marked(marks, small[place]))
                if len(at):
                    got.append((windows(w, width)[at].view(np.int64), np.full(len(at), doc, np.int64), at + (tag << 32)))
                    size += len(at)
                    if size > CHUNK:
                        yield from flush()
                        got, size = [], 0
        if got:
            yield from flush()
        forget()

    return docs.mapInArrow(run, EDGE_SCHEMA)


def later_edges(rows: DataFrame) -> DataFrame:
    """Meet equal edges: the earliest place stays, every other leaves as a path of one edge. An edge has one row for each chunk at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def settle(h: np.ndarray, doc: np.ndarray, loc: np.ndarray) -> Iterator[pa.RecordBatch]:
            if len(h):
                h, doc, loc, fresh, first = _later(h, doc, loc)
                rest = ~fresh
                if rest.any():
                    yield _batch([h[rest], doc[rest], loc[rest], np.ones(int(rest.sum()), np.int64), doc[first][rest], loc[first][rest]])

        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            path = cols[3] > 0
            if path.any():
                yield _batch([c[path] for c in cols])
            h, doc, loc = (np.concatenate([k, c[~path]]) for k, c in zip(kept, cols, strict=False))
            if len(h):
                open_ = h == h[-1]  # the last hash may go on in the next batch
                kept = [h[open_], doc[open_], loc[open_]]
                yield from settle(h[~open_], doc[~open_], loc[~open_])
        yield from settle(*kept)

    return rows.repartition("h").sortWithinPartitions("h").mapInArrow(run, EDGE_SCHEMA)


def compacted(later: DataFrame, width: int) -> DataFrame:
    """Join the consecutive later edges of a document into maximal paths: doc, tag, start, words and the place they repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = [np.zeros(0, np.int64)] * 5

        def settle(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            doc, loc, length, odoc, oloc = _paths(*cols)
            if len(doc):
                low = np.int64((1 << 32) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (doc, loc >> 32, loc & low, length + width - 1, odoc, oloc >> 32, oloc & low)], PATH)

        for b in batches:
            cols = [np.concatenate([k, c.to_numpy()]) for k, c in zip(kept, b.columns[1:], strict=True)]
            open_ = cols[0] == cols[0][-1]
            kept = [c[open_] for c in cols]
            yield from settle([c[~open_] for c in cols])
        yield from settle(kept)

    PATH = ["doc", "tag", "start", "words", "odoc", "otag", "ostart"]
    return later.repartition("doc").sortWithinPartitions("doc").mapInArrow(run, ", ".join(f"{c} long" for c in PATH))


def _cells(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys.select(_cell(F.col("doc")).alias("cell")).distinct())  # FILTER_CELLS rows at most


def _cell(c: Column) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(FILTER_CELLS))


def _digests(places: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc, tag, start, words, digest) of the words at places, read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc", "tag", "start", "words", "digest"]
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, tag, text, spans in zip(*(c.to_pylist() for c in b.columns), strict=True):
                words = (text or "").encode().split()
                for s in spans:
                    for col, x in zip(out, (doc, tag, s["start"], s["words"], hashlib.blake2b(b" ".join(words[s["start"] : s["start"] + s["words"]]), digest_size=16).digest()), strict=True):
                        col.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())], names)

    asked = staged(places.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "words")).alias("spans")))  # bounded by the document's own spans
    near = docs.withColumn("cell", _cell(F.col("doc"))).join(_cells(asked), "cell", "left_semi").drop("cell").dropDuplicates(["doc", "tag"])
    return staged(near.join(asked, ["doc", "tag"]).select("doc", "tag", "text", "spans").mapInArrow(run, "doc long, tag long, start long, words long, digest binary"))


def verified(paths: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The spans (doc, tag, start, words) of the paths whose words, read at both places, have equal digests.

    A path that fails holds an edge whose hash stands for different words. Its edges are looked at one by one: those
    that equal their own origin stay, and of the others the ones that repeat an earlier edge of equal words.
    """
    place, origin = ["doc", "tag", "start", "words"], ["odoc", "otag", "ostart", "words"]

    def compared(rows: DataFrame) -> DataFrame:
        places = rows.select(*place).unionByName(rows.select(*[F.col(o).alias(p) for o, p in zip(origin, place, strict=True)])).distinct()
        digests = _digests(places, docs)
        return staged(rows.join(digests, place).join(digests.toDF(*origin, "odigest"), origin).select(*place, *origin[:3], "digest", "odigest"))

    both = compared(paths)
    good, failed = both.where("digest = odigest").select(*place), both.where("digest <> odigest")
    if failed.isEmpty():
        return good
    steps = failed.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("words") - width)))
    single = compared(steps.select("doc", "tag", (F.col("start") + F.col("k")).alias("start"), F.lit(width).cast("long").alias("words"), "odoc", "otag", (F.col("ostart") + F.col("k")).alias("ostart")))
    apart = single.where("digest <> odigest")
    mine = apart.select("digest", *place).distinct()
    # an earlier edge of equal words can also be the origin of another one that failed
    pool = mine.unionByName(apart.select(F.col("odigest").alias("digest"), *[F.col(o).alias(p) for o, p in zip(origin, place, strict=True)]))
    first = pool.groupBy("digest").agg(F.min(F.struct("doc", "tag", "start")).alias("f")).select("digest", F.col("f.doc").alias("fdoc"), F.col("f.tag").alias("ftag"), F.col("f.start").alias("fstart"))
    later = mine.join(first, "digest").where("doc <> fdoc or tag <> ftag or start <> fstart")
    return good.unionByName(single.where("digest = odigest").select(*place)).unionByName(later.select(*place)).distinct()


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Maximal spans of words that repeat an earlier place: doc, tag, start, words (tag: hash of the text).

    1. Windows of width words are the edges of a De Bruijn graph. Anchors that occur once rule most of them out.
    2. Equal edges meet by hash; all but the earliest place (smaller id, then earlier start) go on.
    3. Consecutive ones compact into paths along the document and along the place they repeat.
    4. The words at both places of each path are read again and compared by digest.
    """
    ship(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 33).alias("tag"), F.col(text_col).alias("text"))
    bitmap = docs.sparkSession.sparkContext.broadcast(repeated_anchors(slim, width))
    paths = staged(compacted(later_edges(edges(slim, width, bitmap)), width))
    return verified(paths, slim, width)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Remove every word that a window of width words covers which also starts earlier in the corpus, judged on the input.

    Returns id, n_words, n_removed, kept (the words left, joined by one space) for each input row. Null and empty
    texts have no words. Rows with a null id come through whole; rows that repeat id and text are one document (both
    keep what one would), and of rows that repeat an id alone each counts as a document of its own, in the order of
    a hash of the text. Ids are integers. Texts are taken whole, however long; other columns are not read. No rows give
    none.
    """
    ship(docs.sparkSession)
    spans = repeated_spans(docs, id_col, text_col, width)
    spans = staged(spans.groupBy("doc", "tag").agg(F.collect_list(F.struct("start", "words")).alias("spans")))
    slim = docs.select(F.col(id_col).cast("long").alias("doc"), F.shiftrightunsigned(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))), 33).alias("tag"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            counts, removed, kept = [], [], []
            for text, found in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = np.zeros(len(words) + 1, np.int64)
                for s in found or ():
                    gone[s["start"]] += 1
                    gone[s["start"] + s["words"]] -= 1
                gone = np.cumsum(gone[:-1]) > 0
                counts.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join(w for w, g in zip(words, gone.tolist(), strict=True) if not g) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc", "n_words", "n_removed", "kept"])

    shape = "doc long, n_words long, n_removed long, kept string"
    marked = slim.withColumn("cell", _cell(F.col("doc")))
    untouched = marked.join(_cells(spans), "cell", "left_anti").select("doc", "text", F.lit(None).cast("array<struct<start:bigint,words:bigint>>").alias("spans"))
    touched = marked.join(_cells(spans), "cell", "left_semi").drop("cell").join(spans, ["doc", "tag"], "left").select("doc", "text", "spans")
    return touched.mapInArrow(run, shape).unionByName(untouched.mapInArrow(run, shape)).withColumnRenamed("doc", id_col)
