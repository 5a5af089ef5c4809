"""Exact top-k inner products with block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Candidates and queries that meet in one task, and candidates in a block.
GROUP_ROWS, QUERY_ROWS, BLOCK_ROWS = 16_384, 1_024, 128
#: Scores end here.
LARGEST = (1 << 63) - 1


def search_blocks(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int, block_rows: int = BLOCK_ROWS) -> tuple[list[tuple[int, int, int]], int]:
    """The k best (query id, id, score) of each query, ties to smaller ids, and how many blocks were scored.

    Vectors are put in the order of their strongest term and cut into ranges. A block's bound for a query is the sum
    of its term maxima (minima under negative weights); blocks come by falling bound, are scored through their
    forward index (the rows themselves), and the rest is left once bounds fall below the kth score.
    """
    if not len(ids):
        return [], 0
    strongest = np.abs(vectors).argmax(1)
    order = np.lexsort((ids, np.sign(vectors[np.arange(len(ids)), strongest]), strongest))
    ids, vectors = ids[order], vectors[order]
    cuts = np.arange(0, len(ids), block_rows)
    most, least = np.maximum.reduceat(vectors, cuts), np.minimum.reduceat(vectors, cuts)
    bounds = np.maximum(queries, 0) @ most.T + np.minimum(queries, 0) @ least.T
    out, scored = [], 0
    for qid, q, bound in zip(query_ids, queries, bounds, strict=True):
        best_s, best_i = np.zeros(0), np.zeros(0, np.int64)
        for b in np.argsort(-bound, kind="stable"):
            if len(best_s) >= k and bound[b] < best_s[k - 1]:
                break
            at, scored = cuts[b], scored + 1
            own = ids[at : at + block_rows] != qid
            s, i = np.concatenate([best_s, (vectors[at : at + block_rows] @ q)[own]]), np.concatenate([best_i, ids[at : at + block_rows][own]])
            first = np.lexsort((i, -s))[:k]
            best_s, best_i = s[first], i[first]
        out += [(int(qid), int(i), max(-LARGEST, min(LARGEST, int(s)))) for i, s in zip(best_i, best_s, strict=True)]
    return out, scored


def top_k(rows: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256) -> DataFrame:
    """Exact k best rows by integer inner product for each query row, the query's own id aside.

    Components become floor(scale * x). Vectors that are null or hold a null or non-finite component take no part;
    shorter vectors count as ending in zeros; of rows that share an id the least vector counts; null ids take no part.
    Queries and rows are dealt to groups of bounded size that all meet once, each group gives k rows a query, and
    the best k of those remain. Empty inputs give no rows. Ids are integers. Sums stay exact below 2^53; larger ones
    are rounded as doubles are, components and scores end at the limits of a 64-bit integer. Other columns are not read.

    Returns query_id, rank (from 1), the row's id and score.
    """
    ship(rows.sparkSession)
    def whole(df: DataFrame) -> DataFrame:
        v = F.transform(F.col(vector_col), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("double"))
        fine = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
        df = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).where(fine)
        return df.groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v"))

    rows, asked = whole(rows), whole(queries)
    size, ask = (df.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d")).first() for df in (rows, asked))
    groups, chunks = max(1, -(-size.n // GROUP_ROWS)), max(1, -(-ask.n // QUERY_ROWS))
    dims = max(1, size.d or 1, ask.d or 1)
    dealt = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n)).cast("int")
    left = rows.withColumn("g", dealt(groups, 1)).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumn("c", dealt(chunks, 2)).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def matrix(vs: pd.Series) -> np.ndarray:
        out = np.zeros((len(vs), dims))
        for i, v in enumerate(vs):
            out[i, : len(v)] = v
        return out

    def meet(mine: pd.DataFrame, asking: pd.DataFrame) -> pd.DataFrame:
        found, _ = search_blocks(mine["id"].to_numpy(np.int64), matrix(mine["v"]), asking["id"].to_numpy(np.int64), matrix(asking["v"]), k)
        return pd.DataFrame(found, columns=["query_id", "id", "score"], dtype="int64")

    found = left.groupBy("g", "c").cogroup(right.groupBy("g", "c")).applyInPandas(meet, "query_id long, id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")
