"""Vector codes by Lloyd's rounds that look again only at parts whose bounds the drift of the entries has used up."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..sources.staging import shared_folder
from .common import small, staged
from .vectors import matrix, usable

#: Vectors of a block, whose heaps are kept together; labels that may be broadcast.
BLOCK_ROWS, BROADCAST_LABELS = 4_096, 100_000
#: Slack below which a part is looked at again although its bounds hold, for the rounding of roots.
MARGIN = 1e-3
LARGEST = (1 << 62) - 1


def packed(x: np.ndarray) -> bytes:
    """Whole numbers in two bytes each where they fit, else eight; the first byte says which."""
    kind = "<i2" if not x.size or np.abs(x).max() < 1 << 15 else "<i8"
    return kind[-1].encode() + np.clip(x, -LARGEST, LARGEST).astype(kind).tobytes()


def unpacked(data: bytes, dims: int) -> np.ndarray:
    return np.frombuffer(data, f"<i{data[:1].decode()}", offset=1).astype(np.float64).reshape(-1, dims)


def distances(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of every row to every entry, exact while they stay below 2^53."""
    out = np.zeros((len(x), len(entries)))
    for d in range(x.shape[1]):
        out += (x[:, d, None] - entries[None, :, d]) ** 2
    return out


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each row's nearest entry (ties to the lower index) and its slack: distance to the second nearest less distance to the nearest."""
    d = distances(x, entries)
    code = d.argmin(1)
    own = np.sqrt(d[np.arange(len(x)), code])
    d[np.arange(len(x)), code] = np.inf
    return code, (np.sqrt(d.min(1)) - own if len(entries) > 1 else np.full(len(x), np.inf))


class Heaps:
    """One part of a block: for every entry the parts assigned to it, least key first.

    A key is the slack at the last look plus the drift its entry had used up by then. While the key exceeds the drift
    used up since, no other entry can have come nearer. A run in ascending order is a heap, so popping all that is
    violated takes a prefix of it.
    """

    def __init__(self, code: np.ndarray, key: np.ndarray, k: int):
        self.code, self.key = code, key
        self.order = np.lexsort((key, code))
        self.starts = np.searchsorted(code[self.order], np.arange(k + 1))

    def pop(self, used: np.ndarray) -> np.ndarray:
        """Places whose key no longer exceeds what their entry has used up."""
        out = []
        for e in range(len(used)):
            run = self.order[self.starts[e] : self.starts[e + 1]]
            out.append(run[: np.searchsorted(self.key[run], used[e] + MARGIN, side="right")])
        return np.concatenate(out) if out else np.zeros(0, np.int64)


def look_again(x: np.ndarray, code: np.ndarray, key: np.ndarray, entries: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes and keys of one part after its entries moved, and the places that were popped and compared with every entry."""
    at = Heaps(code, key, len(entries)).pop(used)
    code, key = code.copy(), key.copy()
    code[at], slack = nearest(x[at], entries)
    key[at] = slack + used[code[at]]
    return code, key, at


def float32_below(x: np.ndarray) -> np.ndarray:
    y = x.astype("<f4")
    return np.where(y > x, np.nextafter(y, np.float32(-np.inf)), y).astype("<f4")


def drift(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """What a move takes from the slack of the parts of each entry: its own way and the longest way of another."""
    way = np.sqrt(((new - old) ** 2).sum(-1))
    if way.shape[1] < 2:
        return np.zeros_like(way)
    top = np.sort(way, axis=1)
    others = np.where(way == top[:, -1:], np.where((way == top[:, -1:]).sum(1, keepdims=True) > 1, top[:, -1:], top[:, -2:-1]), top[:, -1:])
    return way + others


def moves(x: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> list[tuple[int, int, list[int]]]:
    """What a block takes from and gives to each entry's count and sums, for the places that changed their entry."""
    count, total = np.zeros(k, np.int64), np.zeros((k, x.shape[1]), np.int64)
    whole = x.astype(np.int64)
    for code, sign in ((before, -1), (after, 1)):
        if code is not None:
            np.add.at(count, code, sign)
            np.add.at(total, code, sign * whole)
    return [(int(e), int(count[e]), total[e].tolist()) for e in np.nonzero(count.astype(bool) | total.any(1))[0]]


def compress(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> DataFrame:
    """A code of `parts` bytes for each vector, by codebooks of at most 256 entries that Lloyd's rounds fit to all vectors.

    Components become floor(scale * x); vectors are cut into equal parts. Codebooks start as the parts of the vectors
    of least id. A round assigns every part to its nearest entry (squared Euclidean distance, ties to the lower index)
    and moves entries to the componentwise floor of their parts' mean; entries without parts stay. Last, parts are
    assigned again.

    Blocks of vectors stay in the partition they are read in; between rounds they lie in the shared folder with the keys
    of their heaps. The first round looks at every part. Later ones pop what cumulative drift may have violated, compare
    it with all entries, and send only the change of sums. The codebooks (parts * entries rows) pass through
    the driver; vectors never do.

    Rows whose vector is null or holds a null or non-finite component go. Shorter vectors end in zeros; all are
    filled up to a multiple of `parts`. Null ids come last when codebooks start and are coded like others; of equal ids
    the lesser vector and label come first, and each row is coded. Fewer vectors than entries give smaller codebooks;
    equal entries stay, and the first of them wins. No rows give no rows. Distances and sums are exact while components
    stay below 2^24. Ids are integers. Other columns are not read.

    Returns the id, code (two hex digits a part), error (squared distances summed over parts), label_error (summed over
    equal labels, nulls together), codebooks_sha256.
    """
    spark = rows.sparkSession
    ship(spark)
    kept = rows.where(usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).alias("label"), F.col(vector_col).alias("v"))
    label_type = kept.schema["label"].dataType
    ordered = [F.col("id").asc_nulls_last(), "v", "label"]
    first, longest = kept.orderBy(*ordered).limit(entries).toArrow(), kept.agg(F.max(F.size("v"))).first()[0] or 0
    out_type = T.StructType([T.StructField("id", T.LongType()), T.StructField("label", label_type), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    if not first.num_rows:
        return spark.createDataFrame([], out_type).select(F.col("id").alias(id_col), "code", "error", F.col("error").alias("label_error"), F.lit("").alias("codebooks_sha256"))
    width = max(1, -(-longest // parts))
    dims, k = width * parts, first.num_rows
    books = matrix(first["v"], dims, scale).reshape(k, parts, width).transpose(1, 0, 2).copy()

    state_type = T.StructType(
        [T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("labels", T.ArrayType(label_type))]
        + [T.StructField(n, T.BinaryType()) for n in ("x", "codes", "keys")] + [T.StructField("moved", T.ArrayType(T.StructType([T.StructField("part", T.IntegerType()), T.StructField("entry", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("total", T.ArrayType(T.LongType()))])))]
    )
    moved_type = pa.list_(pa.struct([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))]))

    def state(ids, labels, x, codes, keys, moved) -> pa.RecordBatch:
        as_list = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
        cells = [as_list(ids), as_list(labels), *[pa.array([b], pa.binary()) for b in (x, codes, keys)], pa.array([moved], moved_type)]
        return pa.RecordBatch.from_arrays(cells, names=["ids", "labels", "x", "codes", "keys", "moved"])

    def whole_look(books: np.ndarray):
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, BLOCK_ROWS):
                    b = batch.slice(at, BLOCK_ROWS)
                    x = matrix(b["v"], dims, scale)
                    codes, keys, moved = np.zeros((parts, b.num_rows), np.uint8), np.zeros((parts, b.num_rows), "<f4"), []
                    for p in range(parts):
                        part = x[:, p * width : (p + 1) * width]
                        codes[p], key = nearest(part, books[p])
                        keys[p] = float32_below(key)
                        moved += [{"part": p, "entry": e, "n": n, "total": t} for e, n, t in moves(part, None, codes[p], k)]
                    yield state(b["id"], b["label"], packed(x), codes.tobytes(), keys.tobytes(), moved)

        return look

    def blocks(batches: Iterator[pa.RecordBatch], books: np.ndarray, used: np.ndarray):
        """Each block with its codes and keys after a look at what was violated."""
        for batch in batches:
            for row in range(batch.num_rows):
                ids, labels = batch["ids"].slice(row, 1).flatten(), batch["labels"].slice(row, 1).flatten()
                data = batch["x"][row].as_py()
                x = unpacked(data, dims)
                before = np.frombuffer(batch["codes"][row].as_py(), np.uint8).reshape(parts, -1)
                keys = np.frombuffer(batch["keys"][row].as_py(), "<f4").reshape(parts, -1).astype(np.float64)
                codes, popped = before.copy(), []
                for p in range(parts):
                    codes[p], keys[p], at = look_again(x[:, p * width : (p + 1) * width], before[p], keys[p], books[p], used[p])
                    popped.append(at)
                yield ids, labels, data, x, before, codes, keys, popped

    def next_look(books: np.ndarray, used: np.ndarray):
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, labels, data, x, before, codes, keys, popped in blocks(batches, books, used):
                moved = []
                for p, at in enumerate(popped):
                    at = at[before[p][at] != codes[p][at]]
                    moved += [{"part": p, "entry": e, "n": n, "total": t} for e, n, t in moves(x[at, p * width : (p + 1) * width], before[p][at], codes[p][at], k)]
                yield state(ids, labels, data, codes.tobytes(), float32_below(keys).tobytes(), moved)

        return look

    def last_look(books: np.ndarray, used: np.ndarray):
        def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, labels, _, x, _, codes, _, _ in blocks(batches, books, used):
                error = np.zeros(len(x))
                for p in range(parts):
                    error += ((x[:, p * width : (p + 1) * width] - books[p][codes[p]]) ** 2).sum(1)
                text = np.ascontiguousarray(codes.T).tobytes().hex()
                code = pa.array([text[i : i + 2 * parts] for i in range(0, len(text), 2 * parts)], pa.string())
                yield pa.RecordBatch.from_arrays([ids, labels, code, pa.array(np.minimum(error, LARGEST).astype(np.int64))], names=["id", "label", "code", "error"])

        return look

    folder = f"{shared_folder(spark.sparkContext)}/{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    count, total, used = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), np.int64), np.zeros((parts, k))
    source, look = kept, whole_look(books)
    for r in range(rounds):
        source.mapInArrow(look, state_type).write.parquet(f"{folder}/{r}")
        if r:
            store.delete(path(f"{folder}/{r - 1}"), True)
        source = spark.read.schema(state_type).parquet(f"{folder}/{r}")
        sums = source.select(F.inline("moved")).groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("total")[d]).alias(f"t{d}") for d in range(width)]).toArrow()
        at = (sums["part"].to_numpy(), sums["entry"].to_numpy())
        count[at] += sums["n"].to_numpy()
        for d in range(width):
            total[(*at, d)] += sums[f"t{d}"].to_numpy()
        moved = np.where(count[..., None] > 0, total // np.maximum(count, 1)[..., None], books).astype(np.float64)
        used, books = used + drift(books, moved), moved
        look = next_look(books, used)
    if not rounds:
        source = kept.mapInArrow(look, state_type)
    final = staged(source.mapInArrow(last_look(books, used), out_type))
    if rounds:
        store.delete(path(folder), True)
    digest = hashlib.sha256(",".join(str(int(x)) for x in books.ravel()).encode()).hexdigest()
    by_label = final.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    by_label = small(by_label, by_label.count(), BROADCAST_LABELS)
    return final.join(by_label, F.col("label").eqNullSafe(F.col("of_label"))).select(F.col("id").alias(id_col), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
