"""Hard negatives by blocked dense products: positives in a first pass, windows under them in a second."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship
from .common import staged
from .vectors import matrix, usable

#: Anchors that are broadcast at once (with 64 components, 8 MB), anchors and candidates of one product.
BLOCK_ANCHORS, TILE_ANCHORS, TILE_ROWS = 16_384, 1_024, 2_048
NONE = -np.inf
#: Scores end here.
LARGEST = (1 << 63) - 1024


class Best:
    """The k best (score, id) of each of n lists, ties to smaller ids; equal pairs count once."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.id = k, np.full((n, k), NONE), np.full((n, k), np.iinfo(np.int64).max)

    def floor(self) -> np.ndarray:
        """What a score must reach to matter, by list."""
        return self.score[:, -1]

    def add(self, at: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Merge pairs into the lists `at`."""
        if not len(at):
            return
        lists = np.unique(at)
        held = self.score[lists] > NONE
        at = np.concatenate([at, np.repeat(lists, held.sum(1))])
        score, ids = np.concatenate([score, self.score[lists][held]]), np.concatenate([ids, self.id[lists][held]])
        order = np.lexsort((ids, -score, at))
        at, score, ids = at[order], score[order], ids[order]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (score[1:] != score[:-1]) | (ids[1:] != ids[:-1])
        at, score, ids = at[new], score[new], ids[new]
        first = np.searchsorted(at, lists)
        rank = np.arange(len(at)) - first[np.searchsorted(lists, at)]
        few = rank < self.k
        self.score[lists], self.id[lists] = NONE, np.iinfo(np.int64).max
        self.score[at[few], rank[few]], self.id[at[few], rank[few]] = score[few], ids[few]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at, rank = np.nonzero(self.score > NONE)
        return at, self.score[at, rank], self.id[at, rank]


def whole(score: np.ndarray) -> np.ndarray:
    return np.clip(score, -LARGEST, LARGEST).astype(np.int64)


def by_label(labels: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each label with the places that hold it."""
    order = np.argsort(labels, kind="stable")
    found, first = np.unique(labels[order], return_index=True)
    yield from zip(found.tolist(), np.split(order, first[1:]), strict=True) if len(order) else ()


def tiles(n: int, size: int) -> Iterator[slice]:
    return (slice(at, min(n, at + size)) for at in range(0, n, size))


class Positives:
    """First pass: the best rows of the anchor's own label."""

    schema = "anchor_id long, id long, score long"

    def __init__(self, block: dict, k: int):
        self.block, self.best = block, Best(len(block["id"]), k)
        self.labels = {label: at for label, at in by_label(block["label"])}

    def meet(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        for label, cand in by_label(labels):
            anchors = self.labels.get(label)
            for a in tiles(len(anchors), TILE_ANCHORS) if anchors is not None else ():
                for c in tiles(len(cand), TILE_ROWS):
                    mine, theirs = anchors[a], cand[c]
                    score = self.block["v"][mine] @ rows[theirs].T
                    i, j = np.nonzero((score >= self.best.floor()[mine][:, None]) & (self.block["id"][mine][:, None] != ids[theirs][None, :]))
                    self.best.add(mine[i], score[i, j], ids[theirs[j]])

    def rows(self) -> pd.DataFrame:
        at, score, ids = self.best.rows()
        return pd.DataFrame({"anchor_id": self.block["id"][at], "id": ids, "score": whole(score)})


class Negatives:
    """Second pass: for each positive the best rows of other labels inside its window of scores."""

    schema = "anchor_id long, positive_id long, positive_score long, id long, score long"

    def __init__(self, block: dict, k: int, low: int, high: int):
        n, m = block["positive"].shape
        self.block, self.low, self.high = block, low, high
        self.best = Best(n * m, k)

    def meet(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> None:
        m = self.block["positive"].shape[1]
        for a in tiles(len(self.block["id"]), TILE_ANCHORS):
            positive = self.block["positive"][a]
            for c in tiles(len(ids), TILE_ROWS):
                score = self.block["v"][a] @ rows[c].T
                floor = self.best.floor().reshape(-1, m)[a]
                least = np.where(positive >= 0, np.maximum(self.low * positive / 100 - 1, floor), np.inf).min(1)
                i, j = np.nonzero((score >= least[:, None]) & (self.block["label"][a][:, None] != labels[c][None, :]))
                s, cand = score[i, j], ids[c][j]
                for k in range(m):
                    p = positive[i, k]
                    inside = (p > NONE) & (100 * s >= self.low * p) & (100 * s <= self.high * p) & (s >= floor[i, k])
                    self.best.add((i[inside] + a.start) * m + k, s[inside], cand[inside])

    def rows(self) -> pd.DataFrame:
        at, score, ids = self.best.rows()
        a, k = np.divmod(at, self.block["positive"].shape[1])
        return pd.DataFrame({"anchor_id": self.block["id"][a], "positive_id": self.block["positive_id"][a, k], "positive_score": whole(self.block["positive"][a, k]), "id": ids, "score": whole(score)})


def mine(rows: DataFrame, anchors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256, block_anchors: int = BLOCK_ANCHORS) -> DataFrame:
    """For each anchor its best rows of the same label, and for each of those the best rows of other labels whose score is low to high percent of the positive's.

    Components become floor(scale * x); the score is the integer inner product. Anchors are broadcast in blocks of at
    most block_anchors rows; candidates stay where they are read, and each task keeps a few best of each list of
    the block, which merge by anchor. Both passes read all candidates once a block.

    Rows with a null id, label or vector, or any null or non-finite component, take no part. An anchor is no candidate
    of its own id; anchors that share an id are one, with the least label and vector. Rows equal in id and score are one
    candidate, so repeated rows count once. Shorter vectors end in zeros. Ties go to smaller ids. Labels and ids are
    integers. Sums stay exact below 2^53; larger ones are rounded as doubles are. Other columns are not read. No anchors
    or no candidates give no rows.

    Returns anchor_id, positive_id, rank (from 1, among those returned), negative_id, positive_score, negative_score.
    """
    spark = rows.sparkSession
    ship(spark)

    def plain(df: DataFrame) -> DataFrame:
        return df.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(vector_col)).select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))

    candidates = plain(rows)
    asked = staged(plain(anchors).groupBy("id").agg(F.min(F.struct("label", "v")).alias("x")).select("id", "x.label", "x.v"))
    parts = max(1, -(-asked.count() // (block_anchors // 2 or 1)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))

    def blocks() -> Iterator[dict]:
        """Anchors by hash, so that no block is large; each is bounded by block_anchors rows, whatever the hashes do."""
        for part in range(parts):
            found = asked.where(F.col("part") == part).toArrow()
            for at in range(0, found.num_rows, block_anchors):
                t = found.slice(at, block_anchors)
                dims = pc.max(pc.list_value_length(t["v"])).as_py() or 0
                yield {"id": t["id"].to_numpy(), "label": t["label"].to_numpy(), "v": matrix(t["v"], dims, scale)}

    def sweep(block: dict, kind: type, *args) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lists = kind(shared.value, *args)
            for batch in batches:
                lists.meet(batch["id"].to_numpy(), batch["label"].to_numpy(), matrix(batch["v"], shared.value["v"].shape[1], scale))
            yield pa.RecordBatch.from_pandas(lists.rows(), preserve_index=False)

        return candidates.mapInArrow(meet, kind.schema)

    def best(found: DataFrame, keys: list[str], k: int) -> DataFrame:
        order = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
        return found.repartition(*keys).distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    out = None
    for block in blocks():
        first = best(sweep(block, Positives, positives), ["anchor_id"], positives).toArrow()
        at = np.argsort(block["id"], kind="stable")
        at = at[np.searchsorted(block["id"][at], first["anchor_id"].to_numpy())]
        rank = first["rank"].to_numpy() - 1
        block["positive"], block["positive_id"] = np.full((len(block["id"]), positives), NONE), np.zeros((len(block["id"]), positives), np.int64)
        block["positive"][at, rank], block["positive_id"][at, rank] = first["score"].to_numpy(), first["id"].to_numpy()
        second = best(sweep(block, Negatives, negatives, low, high), ["anchor_id", "positive_id", "positive_score"], negatives)
        out = second if out is None else out.unionAll(second)
    if out is None:
        out = spark.createDataFrame([], Negatives.schema + ", rank int")
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
