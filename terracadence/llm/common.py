"""What the operators of this package share: word rules, inputs, staging."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship
from ..sources.staging import staged

__all__ = ["SPACE", "WORD", "read", "sliced", "small", "staged", "text_of"]

#: A word is a run of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(text_col: str) -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(text_col), F.lit(""))


def small(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Mark for broadcast only if the counted rows stay within the bound; otherwise leave the join to the planner's shuffle."""
    return F.broadcast(df) if rows <= bound else df


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 1_000, most_bytes: int = 16 << 20) -> Iterator[pa.RecordBatch]:
    """Pieces of at most so many rows and bytes (a row of more bytes alone), so that a worker holds few texts as Python strings at once."""
    for whole in batches:
        todo = [whole.slice(at, rows) for at in range(0, whole.num_rows, rows)][::-1]
        while todo:
            piece = todo.pop()
            if piece.num_rows > 1 and piece.nbytes > most_bytes:
                half = piece.num_rows // 2
                todo += [piece.slice(half), piece.slice(0, half)]
            else:
                yield piece
