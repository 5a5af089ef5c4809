"""Polygons painted on a pixel grid (K-05, F-45): scan lines cut by edges, the greatest class wins a pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import _edges


def scan_lines(shapes: DataFrame, rings: str) -> DataFrame:
    """Spans of pixels (row, first, last) whose middles lie inside a shape by the even-odd rule, a row for each.

    rings: array of rings in pixel units (x to the right, y down), outer ones and holes alike. Edges hold their upper end
    and lack their lower; spans hold their left end and lack their right, so shapes side by side share no pixel.
    """
    edges = F.flatten(F.transform(rings, _edges))
    low = F.array_min(F.transform(edges, lambda e: F.least(e["a"]["y"], e["b"]["y"])))
    high = F.array_max(F.transform(edges, lambda e: F.greatest(e["a"]["y"], e["b"]["y"])))
    rows = shapes.withColumn("_edges", edges).withColumns({"_low": F.ceil(low - 0.5).cast("long"), "_high": F.ceil(high - 0.5).cast("long") - 1})
    rows = rows.where("_low <= _high").withColumn("row", F.explode(F.sequence("_low", "_high")))
    middle = F.col("row") + 0.5
    cuts = F.filter("_edges", lambda e: (e["a"]["y"] <= middle) != (e["b"]["y"] <= middle))
    at = F.array_sort(F.transform(cuts, lambda e: e["a"]["x"] + (middle - e["a"]["y"]) * (e["b"]["x"] - e["a"]["x"]) / (e["b"]["y"] - e["a"]["y"])))
    rows = rows.withColumn("_at", at)
    pairs = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_at") / 2 - 1, F.lit(0)).cast("int")), lambda k: F.struct(F.get(F.col("_at"), 2 * k).alias("a"), F.get(F.col("_at"), 2 * k + 1).alias("b")))
    rows = rows.withColumn("_span", F.explode(pairs))
    spans = rows.withColumns({"first": F.ceil(F.col("_span.a") - 0.5).cast("long"), "last": F.ceil(F.col("_span.b") - 0.5).cast("long") - 1})
    return spans.where("first <= last").drop("_edges", "_low", "_high", "_at", "_span")


def paint(shapes: DataFrame, rings: str, value: Column, height: int, width: int, tile: int = 256) -> DataFrame:
    """The painted pixels of a raster: tile_row, tile_col, row, col, value: the greatest value of the shapes that hold its middle. Pixels outside the raster or in no shape have no row.

    Spans are cut at tile borders before they become pixels, and pixels meet per tile, after each task has taken its own
    greatest; so large shapes and spots that many shapes cover spread over tasks.
    """
    spans = scan_lines(shapes.select(rings, value.alias("value")), rings).where(F.col("row").between(0, height - 1)).where("value is not null")
    spans = spans.withColumns({"first": F.greatest("first", F.lit(0)), "last": F.least("last", F.lit(width - 1))}).where("first <= last")
    spans = spans.withColumn("tile_col", F.explode(F.sequence(F.floor(F.col("first") / tile), F.floor(F.col("last") / tile))))
    spans = spans.withColumn("col", F.explode(F.sequence(F.greatest(F.col("first"), F.col("tile_col") * tile), F.least(F.col("last"), F.col("tile_col") * tile + tile - 1))))
    return spans.groupBy(F.floor(F.col("row") / tile).alias("tile_row"), "tile_col", "row", "col").agg(F.max("value").alias("value"))


#: Classes in the order they are painted: a later one covers an earlier.
CLASSES = ("CROP", "LOOSE", "STRICT")


def paint_order(tier: Column) -> Column:
    """F-45: the place of a tier in that order, from 1; NULL for others."""
    return F.nullif(F.array_position(F.array(*[F.lit(t) for t in CLASSES]), tier).cast("int"), F.lit(0))
