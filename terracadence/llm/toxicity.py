"""Toxicity: a chain of linear classifiers over categories, each fed with the earlier ones' probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship
from .common import sliced
from .features import word_features
from .quality import labelled

#: The chain: categories of toxicity found in the labelled rows, then the label itself.
CATEGORIES = 4
NAMES = tuple(f"category_{k + 1}" for k in range(CATEGORIES))
CHAIN = (*NAMES, "toxic")
MAX_TRAINING_ROWS, WORD_BITS, KEPT_FEATURES, FOLDS, RIDGE = 8_000, 18, 256, 5, 0.1


@dataclass
class Link:
    """One classifier: hashed words (sorted), their weights, a bias and the weights of earlier probabilities."""

    words: np.ndarray
    weights: np.ndarray
    bias: float
    earlier: np.ndarray

    def probability(self, rows: list[np.ndarray], before: np.ndarray) -> np.ndarray:
        z = np.full(len(rows), self.bias) + before @ self.earlier
        if len(self.words):
            lengths = np.array([len(r) for r in rows])
            flat = np.concatenate(rows) if len(rows) else np.zeros(0, np.int32)
            at = np.minimum(np.searchsorted(self.words, flat), len(self.words) - 1)
            hit = self.words[at] == flat
            z += np.bincount(np.repeat(np.arange(len(rows)), lengths)[hit], self.weights[at[hit]], len(rows))
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _telling(rows: list[np.ndarray], y: np.ndarray, size: int, kept: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that tell the classes apart most, by G-test; and all words of all rows with their row."""
    n, pos = len(y), float(y.sum())
    flat, owner = np.concatenate(rows), np.repeat(np.arange(n), [len(r) for r in rows])
    seen, with_pos = np.bincount(flat, minlength=size).astype(float), np.bincount(flat, y[owner], size)
    cells = np.stack([with_pos, seen - with_pos, pos - with_pos, n - pos - seen + with_pos])
    expected = np.stack([seen * pos, seen * (n - pos), (n - seen) * pos, (n - seen) * (n - pos)]) / n
    g = 2 * (cells * np.log(np.maximum(cells, 1e-12) / np.maximum(expected, 1e-12))).sum(0)
    g[seen < 3] = 0
    words = np.sort(np.argsort(-g, kind="stable")[:kept][g[np.argsort(-g, kind="stable")[:kept]] > 10]).astype(np.int32)
    return words, flat, owner


def find_categories(rows: list[np.ndarray], toxic: np.ndarray, size: int, kept: int = KEPT_FEATURES, count: int = CATEGORIES, rounds: int = 15, starts: int = 8) -> np.ndarray:
    """Targets, rows x count: toxic rows that share telling words form a category each.

    Spherical k-means over the telling words of the toxic rows, the best of a few seeded starts, largest category
    first. Toxic rows without a telling word show no category.
    """
    out = np.zeros((len(rows), count))
    if not 0 < toxic.sum() < len(toxic):
        return out
    words, flat, owner = _telling(rows, toxic.astype(float), size, kept)
    at = np.searchsorted(words, flat)
    hit = words[np.minimum(at, max(0, len(words) - 1))] == flat if len(words) else np.zeros(len(flat), bool)
    x = np.zeros((len(rows), len(words)))
    x[owner[hit], at[hit]] = 1
    marked = np.flatnonzero((toxic > 0) & (x.sum(1) > 0))
    if not len(marked):
        return out
    x = x[marked]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rng, best, mine = np.random.default_rng(5), -1.0, None
    for _ in range(starts):
        centres = [x[rng.integers(len(x))]]
        while len(centres) < count:
            apart = 1 - np.max(x @ np.array(centres).T, axis=1).clip(0, 1)
            centres.append(x[rng.choice(len(x), p=apart / apart.sum() if apart.sum() > 1e-9 else None)])
        centres = np.array(centres)
        for _ in range(rounds):
            own = (x @ centres.T).argmax(1)
            sums = np.array([x[own == k].sum(0) for k in range(count)])
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centres = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centres)
        near = x @ centres.T
        if near.max(1).sum() > best:
            best, mine = near.max(1).sum(), near.argmax(1)
    order = np.argsort(-np.bincount(mine, minlength=count), kind="stable")
    out[marked, np.argsort(order)[mine]] = 1
    return out


def _fit_link(rows: list[np.ndarray], y: np.ndarray, before: np.ndarray, size: int, kept: int) -> Link:
    """Logistic regression on the words that tell the classes apart most (by G-test), damped Newton steps with an L2 penalty."""
    n, pos = len(y), float(y.sum())
    none = np.zeros(0, np.int32)
    if not 0 < pos < n:
        share = (pos + 0.5) / (n + 1) if n else 0.0
        return Link(none, np.zeros(0), float(np.log(max(share, 1e-9) / (1 - min(share, 1 - 1e-9)))), np.zeros(before.shape[1]))
    words, flat, owner = _telling(rows, y, size, kept)
    at = np.searchsorted(words, flat)
    x = np.zeros((n, len(words) + before.shape[1] + 1))
    hit = (at < len(words)) & (words[np.minimum(at, max(0, len(words) - 1))] == flat) if len(words) else np.zeros(len(flat), bool)
    x[owner[hit], at[hit]] = 1
    x[:, len(words) : -1], x[:, -1] = before, 1
    w = np.zeros(x.shape[1])
    w[-1] = np.log(pos / (n - pos))
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge + 1e-6), x.T @ (p - y) + ridge * w)
        w -= step * min(1.0, 4 / max(1e-9, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return Link(words, w[: len(words)], float(w[-1]), w[len(words) : -1])


def train_chain(rows: list[np.ndarray], targets: np.ndarray, word_bits: int = WORD_BITS, kept: int = KEPT_FEATURES, folds: int = FOLDS) -> list[Link]:
    """targets: rows x chain. Later links learn from out-of-fold probabilities of the earlier ones, as they will meet them on new texts."""
    n, size = len(rows), 1 << word_bits
    fold = np.arange(n) % folds
    before, chain = np.zeros((n, 0)), []
    for k in range(targets.shape[1]):
        y = targets[:, k].astype(float)
        chain.append(_fit_link(rows, y, before, size, kept))
        out = np.zeros(n)
        for f in range(folds if n >= folds else 0):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            part = _fit_link([rows[i] for i in inside], y[inside], before[inside], size, kept)
            out[outside] = part.probability([rows[i] for i in outside], before[outside])
        before = np.column_stack([before, out])
    return chain


def run_chain(chain: list[Link], rows: list[np.ndarray]) -> np.ndarray:
    """Probabilities, rows x chain."""
    before = np.zeros((len(rows), 0))
    for link in chain:
        before = np.column_stack([before, link.probability(rows, before)])
    return before


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_TRAINING_ROWS, word_bits: int = WORD_BITS) -> list[Link]:
    """Learn the chain from at most max_rows labelled documents outside the held-out fold (crc32 of the id mod 3 is 1); categories come from the same rows."""
    ship(docs.sparkSession)
    chosen = F.broadcast(labelled(labels, id_col, label_col, max_rows))  # max_rows at most
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            features = [word_features(t or "", word_bits).tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(features, pa.binary())], ["id", "y", "idx"])

    types = f"id {slim.schema['id'].dataType.simpleString()}, y int, idx binary"
    once = slim.mapInArrow(run, types).groupBy("id").agg(F.min(F.struct("idx", "y")).alias("r"))
    got = sorted(once.select("id", "r.*").toArrow().to_pylist(), key=lambda r: r["id"])
    rows, toxic = [np.frombuffer(r["idx"], np.int32) for r in got], np.array([r["y"] for r in got])
    return train_chain(rows, np.column_stack([find_categories(rows, toxic, 1 << word_bits), toxic]), word_bits)


def score(docs: DataFrame, chain: list[Link], id_col: str = "doc_id", text_col: str = "text", word_bits: int = WORD_BITS, threshold: float = 0.5) -> DataFrame:
    """Probability of each category (p_category_1, ...), of the whole label (score) and the decision (toxic), for every whole text.

    Null and empty texts count as texts without words; repeated rows are scored alike; no rows give none. A category
    never seen in training keeps a probability near 0. Other columns of docs are not read.
    """
    ship(docs.sparkSession)
    names = [id_col, *(f"p_{c}" for c in NAMES), "score", "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches):
            p = run_chain(chain, [word_features(t or "", word_bits) for t in b.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(p[:, k], pa.float64()) for k in range(len(CHAIN))), pa.array((p[:, -1] >= threshold).astype(np.int32), pa.int32())], names)

    slim = docs.select(F.col(id_col), F.col(text_col).alias("_text"))
    probabilities = ", ".join(f"p_{c} double" for c in NAMES)
    return slim.mapInArrow(run, f"`{id_col}` {slim.schema[id_col].dataType.simpleString()}, {probabilities}, score double, toxic int")
