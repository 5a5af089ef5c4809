"""MinHash near-duplicates: banded candidates, odd sketches to rank them, full sets to confirm."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import sliced, staged
from .components import components
from .shingles import ODD, forget, mix, shingle_set

#: Bands and samples in each: a pair at 0.85 shares no band once in 4e7.
BANDS, ROWS = 30, 5
#: Bits of an odd sketch, and how far below the threshold its estimate may lie (five standard errors of BANDS * ROWS samples).
SKETCH_BITS, MARGIN = 512, 0.17
#: Members of a bucket that one task compares, and about how many bytes of full sets; larger buckets become pairs of blocks.
BLOCK, BLOCK_BYTES = 512, 64 << 20
#: Members of a large bucket that all its blocks are compared with.
PIVOTS = 4
#: Cells of the bounded filter before texts are fetched again.
FILTER_CELLS = 1 << 20
np.seterr(over="ignore")


@lru_cache(maxsize=4)

def _functions(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    a, b = (r.integers(0, 1 << 64, (k, 1), dtype=np.uint64) for _ in range(2))
    return a | np.uint64(1), b


def minhash(shingles: np.ndarray, k: int) -> np.ndarray:
    a, b = _functions(k)
    out = np.full(k, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        np.minimum(out, (a * shingles[None, at : at + 2048] + b).min(1), out=out)
    return out


def band_keys(samples: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    rows = samples.reshape(bands, -1)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows.shape[1]):
        key = mix(key * ODD + rows[:, r])
    return key


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """Parity bitmap: each sample flips one bit, chosen by its number and value."""
    place = mix(samples + np.arange(1, len(samples) + 1, dtype=np.uint64) * ODD) % np.uint64(bits)
    return np.packbits(np.bincount(place.astype(np.int64), minlength=bits) & 1 != 0).tobytes()


def estimates(left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Similarities of sketches (rows of uint64 words) from the population counts of their XOR, left x right."""
    bits = left.shape[1] * 64
    ones = sum(np.bitwise_count(left[:, None, w] ^ right[None, :, w]).astype(np.int32) for w in range(left.shape[1]))
    apart = -bits / 2 * np.log(np.maximum(1 - 2 * ones / bits, 1e-9))
    return 1 - apart / (2 * k)


def signatures(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """id, tag (hash of the text), n (set size), s1, s2 (128-bit digest of the set), bands and sketch, of every whole text; set sizes of 0 have no bands."""
    import xxhash

    k = bands * rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            n, s, keys, sketches = [], [], [], []
            for text in b.column(1).to_pylist():
                x = shingle_set(text, width)
                n.append(len(x))
                s.append(xxhash.xxh3_128_digest(x.tobytes()))
                samples = minhash(x, k) if len(x) else None
                keys.append(band_keys(samples, bands).view(np.int64) if len(x) else None)
                sketches.append(odd_sketch(samples) if len(x) else None)
            halves = np.frombuffer(b"".join(s), np.int64).reshape(-1, 2)
            cols = [b.column(0), b.column(2), pa.array(n, pa.int64()), pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "tag", "n", "s1", "s2", "bands", "sketch"])
        forget()

    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tag"))
    return slim.mapInArrow(run, "id long, tag long, n long, s1 long, s2 long, bands array<long>, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Rows of sorted batches by their first columns, also across batches."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, group in groupby(rows, key=lambda r: r[:keys]):
        yield key, [r[keys:] for r in group]


def _pairs(rows: list[tuple], diagonal: bool) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs that a task compares: all of one block, or one block against the other."""
    if diagonal:
        return np.triu_indices(len(rows), 1)
    side = np.array([r[0] for r in rows])
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _candidates(rows: list[tuple], diagonal: bool, k: int, share: float, low: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs whose sizes allow the similarity and whose sketches come near it. rows: (side, id, n, sketch, ...)."""
    i, j = _pairs(rows, diagonal)
    n = np.array([r[2] for r in rows])
    sketch = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
    likely = estimates(sketch, sketch, k)[i, j] >= low
    fits = np.minimum(n[i], n[j]) >= share * np.maximum(n[i], n[j])
    return i[likely & fits], j[likely & fits]


def confirm(rows: list[tuple], i: np.ndarray, j: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Components of the pairs whose full sets share enough, as (id, smallest id). rows: (side, id, n, sketch, set)."""
    sets = [np.frombuffer(r[4], np.uint64) for r in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    if len(i) > 512:
        flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        _, column, seen = np.unique(flat, return_inverse=True, return_counts=True)
        shared = seen[column] > 1
        compact = np.cumsum(seen > 1) - 1
        column, owner = compact[column[shared]], owner[shared]
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        both = np.zeros((len(sets), len(sets)), np.float32)
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, 8192):
            a, b = np.searchsorted(column, [low, low + 8192])
            x = np.zeros((len(sets), 8192), np.float32)
            x[owner[a:b], column[a:b] - low] = 1
            both += x @ x.T
        sizes = np.array([len(s) for s in sets])
        meet = both[i, j].astype(np.int64)
        linked = 100 * meet >= percent * (sizes[i] + sizes[j] - meet)
        for x, y in zip(i[linked].tolist(), j[linked].tolist(), strict=True):
            if (x := root(x)) != (y := root(y)):
                parent[x] = y
    else:
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            if root(x) != root(y):
                meet = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
                if 100 * meet >= percent * (len(sets[x]) + len(sets[y]) - meet):
                    parent[root(x)] = root(y)
    members: dict[int, list[int]] = {}
    for x in range(len(rows)):
        members.setdefault(root(x), []).append(rows[x][1])
    return [(v, least) for ids in members.values() for least in [min(ids)] for v in ids if v != least]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """Connected components of texts whose shingle sets share at least percent of their union.

    Returns id, n_shingles, component_id and kept. Texts without words (null, empty) have empty sets and link with
    nothing. Ids are integers. Rows with a null id link with nothing and are kept, with a null component. Rows that
    repeat an id count as one document if their sets are equal; otherwise each set is classed by itself. Texts are
    taken whole; other columns are not read. Empty input gives no rows. Steps: see _classified.
    """
    return _classified(docs, id_col, text_col, width, percent, bands, rows, block).drop("tag")


def _classified(docs: DataFrame, id_col: str, text_col: str, width: int = 5, percent: int = 85, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """near_duplicates with a hash of each text (tag).

    1. Signatures beside the scan. Equal sets become one representative, the smallest id.
    2. Representatives meet in bands; buckets with the same members are compared once.
    3. In a bucket, size and odd sketch choose candidate pairs. A bucket of more than block members, or whose sets hold
       more than BLOCK_BYTES, is dealt to blocks;
       each is compared in itself and with a few pivots of the bucket, so rows move once.
    4. Full sets of what is left, made anew from the texts, confirm the links exactly; a task gives each member's
       smallest linked id, never all pairs. Star contraction joins these into components.
    5. Members of a large bucket outside its largest component then meet all blocks of it, as pairs within one
       component need no further look. If that links more, components are joined again.
    """
    ship(docs.sparkSession)
    k, share = bands * rows, percent / 100
    low = share - MARGIN
    sig = staged(signatures(docs, id_col, text_col, width, bands, rows))
    sets = sig.where("n > 0 and id is not null").groupBy("s1", "s2", "n").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    sets = staged(sets)
    reps = staged(sig.join(sets.select("s1", "s2", "id"), ["s1", "s2", "id"], "left_semi").dropDuplicates(["s1", "s2", "id"]))
    banded = reps.select("id", "n", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("shingles"), F.sum(F.xxhash64("id").cast("decimal(20,0)")).alias("who")).where("m > 1")
    buckets = buckets.groupBy("m", "who").agg(F.min("key").alias("key"), F.max("shingles").alias("shingles"))
    n_blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(8 * F.col("shingles") / BLOCK_BYTES)).cast("int")
    members = staged(banded.drop("n").join(buckets.select("key", "m", n_blocks.alias("parts")), "key"))
    members = members.withColumn("x", F.pmod(F.xxhash64("id", "key"), F.col("parts")).cast("int"))
    inside = members.select("key", "x", F.col("x").alias("y"), F.lit(0).alias("side"), "id")
    large = members.where("parts > 1")
    pivots = large.groupBy("key", "parts").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(p)), "id"))["id"].alias(f"p{p}") for p in range(PIVOTS)])
    pivots = pivots.withColumn("id", F.explode(F.array_distinct(F.array(*[f"p{p}" for p in range(PIVOTS)])))).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    pivots = pivots.select("key", "x", F.col("x").alias("y"), F.lit(0).alias("side"), "id")

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, x, y), group in _groups(batches, 3):
            i, j = _candidates(group, x == y, k, share, low)
            left = np.unique(np.concatenate([i, j])).tolist()
            if left:
                yield pa.RecordBatch.from_pylist([{"key": key, "x": x, "y": y, "side": group[t][0], "id": group[t][1], "n": group[t][2], "sketch": group[t][3]} for t in left], layout)

    layout = pa.schema([("key", pa.int64()), ("x", pa.int32()), ("y", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("sketch", pa.binary())])
    shape = "key long, x int, y int, side int, id long, n long, sketch binary"
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([shingle_set(t, width).tobytes() for t in b.column(1).to_pylist()], pa.binary())], ["id", "full"])
        forget()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), group in _groups(batches, 3):
            i, j = _candidates(group, x == y, k, share, low)
            if links := confirm(group, i, j, percent):
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], ["u", "v"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cell = F.pmod(F.xxhash64("id"), F.lit(FILTER_CELLS))

    def links_of(placed: DataFrame) -> DataFrame:
        sketched = placed.join(reps.select("id", "n", "sketch"), "id").select("key", "x", "y", "side", "id", "n", "sketch")
        sketched = sketched.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y")
        left = staged(sketched.mapInArrow(screen, shape))
        # full sets, of the ids that are left only
        wanted = left.select("id").distinct()
        near = texts.withColumn("cell", cell).join(F.broadcast(wanted.select(cell.alias("cell")).distinct()), "cell", "left_semi").drop("cell")  # FILTER_CELLS rows at most
        full_sets = near.join(wanted, "id", "left_semi").mapInArrow(full, "id long, full binary")
        ready = left.join(full_sets, "id").select("key", "x", "y", "side", "id", "n", "sketch", "full").where(F.length("full") == 8 * F.col("n"))
        return staged(ready.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(check, "u long, v long").distinct())

    links = links_of(inside.unionByName(pivots).distinct())
    found = components(links)
    rest = staged(_rest(large, found, block))
    if not rest.isEmpty():
        found = components(links.unionByName(links_of(rest)))
    shared_ids = sets.select("id", "s1", "s2")
    classes = shared_ids.join(found.withColumnRenamed("node", "id"), "id", "left")
    classes = classes.select("s1", "s2", F.coalesce("component", "id").alias("component"))
    out = sig.select("id", "tag", "n", "s1", "s2").join(classes, ["s1", "s2"], "left")
    component = F.when(F.col("n") > 0, F.coalesce("component", "id")).otherwise(F.col("id"))
    out = out.select(F.col("id").alias(id_col), "tag", F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.lit(True)))


def _rest(large: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """Placings of the members of large buckets outside the bucket's largest component (side 0, dealt to blocks of their own) against all its members (side 1)."""
    labelled = large.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("label", F.coalesce("component", "id"))
    sizes = labelled.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    top = sizes.groupBy("key").agg(F.max(F.struct("size", "label")).alias("top"), F.sum("size").alias("all"))
    open_ = top.where(F.col("all") > F.col("top.size")).select("key", F.col("top.label").alias("top"), (F.col("all") - F.col("top.size")).alias("left"))
    rows = labelled.join(open_, "key").withColumn("blocks", F.greatest(F.ceil(F.col("left") / block), F.ceil(F.col("parts") * F.col("left") / F.col("m"))).cast("int"))
    outside = rows.where(F.col("label") != F.col("top")).withColumn("row", F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int"))
    outside = outside.select("key", F.col("row").alias("x"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("y"), F.lit(0).alias("side"), "id")
    against = rows.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("row"), F.col("x").alias("y"), F.lit(1).alias("side"), "id").withColumnRenamed("row", "x")
    # x and y number different blocks here; x < y keeps them apart from a block that meets itself
    shift = F.lit(1 << 30)
    return outside.unionByName(against.select("key", "x", "y", "side", "id")).withColumn("y", (F.col("y") + shift).cast("int"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows without those that near_duplicates does not keep, all columns as they were, whatever their names.

    A row is known by its id and text, so of rows that repeat an id one can go and another stay; rows that repeat both
    share one fate.
    """
    gone = _classified(docs, id_col, text_col, **options).where("not kept")
    gone = staged(gone.select(F.col(id_col).alias("gone_id"), F.col("tag").alias("gone_tag")).distinct())
    cell = F.pmod(F.xxhash64("gone_id"), F.lit(FILTER_CELLS))
    cells = F.broadcast(gone.select(cell.alias("cell")).distinct())  # FILTER_CELLS rows at most
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tag"))
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(FILTER_CELLS)))
    near = rows.join(cells, "cell", "left_semi").join(gone, (F.col("id") == F.col("gone_id")) & (F.col("tag") == F.col("gone_tag")), "left_anti")
    kept = near.select("row").unionByName(rows.join(cells, "cell", "left_anti").select("row"))
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
