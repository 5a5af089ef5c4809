"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import sliced
from .features import BINS, STATS, quality_features

#: Labelled rows that training looks at, chosen by the hash of their id.
MAX_TRAINING_ROWS = 6_000
WORD_BITS, FACTORS = 14, 8


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that training never sees."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


@dataclass
class FactorisationMachine:
    """y = w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j; the pair sum as half of (sum v x)^2 - sum (v x)^2 per factor."""

    bias: float
    weights: np.ndarray
    factors: np.ndarray

    def raw(self, idx: np.ndarray, val: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Scores of rows laid end to end; starts: where each begins (no row is empty)."""
        vx = self.factors[idx] * val[:, None]
        sums = np.add.reduceat(vx, starts)
        squares = np.add.reduceat(vx * vx, starts)
        return self.bias + np.add.reduceat(self.weights[idx] * val, starts) + 0.5 * (sums * sums - squares).sum(1)

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        starts = np.cumsum([0, *(len(i) for i, _ in rows[:-1])])
        y = self.raw(np.concatenate([i for i, _ in rows]), np.concatenate([v for _, v in rows]), starts)
        return 1 / (1 + np.exp(-np.clip(y.astype(np.float64), -30, 30)))


def train(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, factors: int = FACTORS, epochs: int = 8, rate: float = 0.05, l2: float = 1e-4, batch: int = 64) -> FactorisationMachine:
    """AdaGrad on log loss, in a fixed order. Without rows the model gives 0.5 everywhere."""
    rng = np.random.default_rng(7)
    m = FactorisationMachine(0.0, np.zeros(size, np.float32), rng.normal(0, 0.02, (size, factors)).astype(np.float32))
    if not len(y):
        m.factors[:] = 0
        return m
    share = (y.sum() + 1) / (len(y) + 2)
    m.bias = float(np.log(share / (1 - share)))
    gw, gv = np.full(size, 1e-6, np.float32), np.full((size, factors), 1e-6, np.float32)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), batch):
            take = order[at : at + batch]
            lengths = np.array([len(rows[i][0]) for i in take])
            starts = np.cumsum([0, *lengths[:-1]])
            idx, val = np.concatenate([rows[i][0] for i in take]), np.concatenate([rows[i][1] for i in take])
            vx = m.factors[idx] * val[:, None]
            sums = np.add.reduceat(vx, starts)
            raw = m.bias + np.add.reduceat(m.weights[idx] * val, starts) + 0.5 * (sums * sums - np.add.reduceat(vx * vx, starts)).sum(1)
            err = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[take]) / len(take)
            each = np.repeat(err, lengths).astype(np.float32) * val
            touched, place = np.unique(idx, return_inverse=True)
            dw = np.bincount(place, each, len(touched)).astype(np.float32) + l2 * m.weights[touched]
            pair = each[:, None] * (np.repeat(sums, lengths, 0) - vx)
            dv = np.stack([np.bincount(place, pair[:, f], len(touched)) for f in range(factors)], 1).astype(np.float32) + l2 * m.factors[touched]
            gw[touched] += dw * dw
            gv[touched] += dv * dv
            m.weights[touched] -= rate * dw / np.sqrt(gw[touched])
            m.factors[touched] -= rate * dv / np.sqrt(gv[touched])
            m.bias -= rate * float(err.sum())
    return m


def labelled(labels: DataFrame, id_col: str, label_col: str, max_rows: int) -> DataFrame:
    """(id, y) of at most max_rows documents outside the held-out fold; several labels of one document vote, ties for 1."""
    rows = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("y"))
    rows = rows.groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    return rows.orderBy(F.xxhash64("id"), "id").limit(max_rows)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars", label_col: str = "quality", max_rows: int = MAX_TRAINING_ROWS, word_bits: int = WORD_BITS) -> FactorisationMachine:
    """Learn from at most max_rows labelled documents outside the held-out fold; their features come to the driver."""
    ship(docs.sparkSession)
    chosen = F.broadcast(labelled(labels, id_col, label_col, max_rows))  # max_rows at most
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(meta_col).cast("long").alias("meta")).join(chosen, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            rows = [quality_features(t or "", m, word_bits) for t, m in zip(b.column("text").to_pylist(), b.column("meta").to_pylist(), strict=True)]
            cols = [b.column("id"), b.column("y"), pa.array([i.tobytes() for i, _ in rows], pa.binary()), pa.array([v.tobytes() for _, v in rows], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["id", "y", "idx", "val"])

    types = f"id {slim.schema['id'].dataType.simpleString()}, y int, idx binary, val binary"
    once = slim.mapInArrow(run, types).groupBy("id").agg(F.min(F.struct("idx", "val", "y")).alias("r"))  # an id that repeats counts once
    got = sorted(once.select("id", "r.*").toArrow().to_pylist(), key=lambda r: r["id"])
    rows = [(np.frombuffer(r["idx"], np.int32), np.frombuffer(r["val"], np.float32)) for r in got]
    return train(rows, np.array([r["y"] for r in got], np.float64), (1 << word_bits) + BINS * len(STATS))


def score(docs: DataFrame, model: FactorisationMachine, id_col: str = "doc_id", text_col: str = "text", meta_col: str = "n_chars", word_bits: int = WORD_BITS, keep: tuple[str, ...] = ()) -> DataFrame:
    """Score every whole text in time linear in its words, beside the scan.

    Returns id, score (0 to 1, higher: label 1 likelier), predicted and the columns named in keep. Null texts count
    as empty and get a score too; repeated rows are scored alike; no rows give none.
    """
    ship(docs.sparkSession)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            texts, metas, out = b.column(text_name).to_pylist(), b.column("_meta").to_pylist(), []
            for at in range(0, len(texts), 256):
                out.append(model.score([quality_features(t or "", m, word_bits) for t, m in zip(texts[at : at + 256], metas[at : at + 256], strict=True)]))
            s = np.concatenate(out) if out else np.zeros(0)
            left = [b.column(c) for c in b.schema.names if c not in ("_text", "_meta")]
            yield pa.RecordBatch.from_arrays([*left, pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32), pa.int32())], names)

    slim = docs.select(F.col(id_col), *[F.col(c) for c in keep], *([] if text_col in keep else [F.col(text_col).alias("_text")]), F.col(meta_col).cast("long").alias("_meta"))
    text_name = text_col if text_col in keep else "_text"
    names = [id_col, *keep, "score", "predicted"]
    types = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in (id_col, *keep))
    return slim.mapInArrow(run, f"{types}, score double, predicted int")
