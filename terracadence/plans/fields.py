"""Import of field polygons (B-12): every row keeps its place, its issues and what was repaired."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo as G
from ..functions.repair import repaired
from ..functions.texts import reasons
from ..shipping import ship

SHAPES = "array<array<array<array<double>>>>"
KINDS = ("Point", "MultiPoint", "LineString", "MultiLineString", "GeometryCollection")


def import_fields(raw: DataFrame, order: str = "feature_index", id_col: str = "field_id", geometry_col: str = "geometry", least_ha: float = 0.01) -> DataFrame:
    """raw (an order, an id, a GeoJSON geometry as text) with polygons, area_ha, centre, geometry_repaired and issues; rows without issues are accepted.

    Polygons that cross themselves are cut into those of their even-odd area; what would leave lines is not repaired. Of
    equal ids and equal shapes the first in order is kept. Shapes are equal if their repaired rings are, wherever they
    begin and whichever way they turn. The twelve issues are those of the import's report; area is looked at only where
    nothing else is wrong.
    """
    ship(raw.sparkSession)
    c = F.col
    text = c(geometry_col)
    kind = F.get_json_object(text, "$.type")
    coordinates = F.get_json_object(text, "$.coordinates")
    shapes = F.when(kind == "Polygon", F.from_json(F.concat(F.lit("["), coordinates, F.lit("]")), SHAPES)).when(kind == "MultiPolygon", F.from_json(coordinates, SHAPES))
    shapes = F.filter(shapes, lambda rings: F.size(rings) > 0)
    closed = lambda r: F.when(F.size(r) == 0, F.size(r)).otherwise(F.size(r) + F.when(F.element_at(r, 1) == F.element_at(r, -1), 0).otherwise(1))
    broken = lambda s: F.exists(s, lambda rings: rings.isNull() | F.exists(rings, lambda r: r.isNull() | (closed(r) < 4) | F.exists(r, lambda p: p.isNull() | (F.size(p) < 2) | p[0].isNull() | p[1].isNull())))
    df = raw.withColumn("_shapes", shapes).withColumn("_bad", F.coalesce(broken(c("_shapes")), F.lit(False)))
    given = text.isNotNull() & (F.trim(text) != "null")
    polygonal = kind.isin("Polygon", "MultiPolygon")
    df = df.withColumns({"_given": given, "_unreadable": given & F.coalesce((kind.isNull() | ~(polygonal | kind.isin(*KINDS)) | (polygonal & (c("_shapes").isNull() | c("_bad")))), F.lit(True)), "_polygonal": F.coalesce(polygonal, F.lit(False))})
    sound = c("_given") & ~c("_unreadable") & c("_polygonal") & (F.size("_shapes") > 0)
    open_ring = lambda r: F.when(F.element_at(r, 1) == F.element_at(r, -1), F.slice(r, 1, F.size(r) - 1)).otherwise(r)
    df = df.withColumn("polygons", F.when(sound, F.transform("_shapes", lambda rings: F.transform(rings, open_ring))))
    outside = F.exists("polygons", lambda rings: F.exists(rings, lambda r: F.exists(r, lambda p: ~p[0].between(-180, 180) | ~p[1].between(-90, 90))))
    df = repaired(df.withColumn("_outside", F.coalesce(outside, F.lit(False))), "polygons", "_repair")
    valid = c("_repair").isin("VALID", "REPAIRED")
    df = df.withColumn("_key", F.when(valid, F.md5(c("polygons").cast("string"))))
    first = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(order)) > 1
    has_id = F.coalesce(F.trim(c(id_col).cast("string")) != "", F.lit(False))
    # ids and shapes that are missing are no group: each such row is spread by its order
    df = df.withColumns({"_id": F.when(has_id, F.concat(F.lit("i"), c(id_col).cast("string"))).otherwise(F.concat(F.lit("n"), c(order).cast("string"))), "_shape": F.coalesce("_key", c(order).cast("string"))})
    df = df.withColumns({"_id_again": has_id & first("_id"), "_shape_again": valid & first("_shape")})
    metres = lambda p: F.struct(*[v.alias(n) for v, n in zip(G.utm_xy(p[1], p[0]), "xy", strict=True)])
    ring_m = lambda r: F.transform(r, metres)
    # outer rings turn left and holes right, so the signed areas add up
    moments = F.transform(F.transform(F.flatten("polygons"), ring_m), lambda r: F.struct(G.ring_area(r).alias("a"), *[v.alias(n) for v, n in zip(G.ring_centroid(r), "xy", strict=True)]))
    total = lambda f: F.aggregate("_m", F.lit(0.0), lambda s, m: s + f(m))
    df = df.withColumn("_m", F.when(valid & ~c("_outside"), moments)).withColumn("_area", total(lambda m: m["a"]))
    df = df.withColumns({"area_ha": c("_area") / 10_000, "x": F.try_divide(total(lambda m: m["a"] * m["x"]), c("_area")), "y": F.try_divide(total(lambda m: m["a"] * m["y"]), c("_area"))})
    earlier = reasons([
        (~has_id, "missing_required_attribute:field_id"), (c("_id_again"), "duplicate_field_id"), (~c("_given"), "missing_required_attribute:geometry"), (c("_unreadable"), "unreadable_geometry"),
        (~c("_given") | c("_unreadable") | (c("_polygonal") & (F.size("_shapes") == 0)), "empty_geometry"), (c("_given") & ~c("_unreadable") & ~c("_polygonal"), "geometry_not_polygon"),
        (c("_outside"), "coordinates_outside_valid_wgs84_bounds"), (c("_repair") == "UNSAFE", "invalid_geometry_not_safely_repairable"), (c("_repair") == "FAILED", "invalid_geometry_repair_failed"), (c("_shape_again"), "duplicate_geometry"),
    ])
    df = df.withColumn("_earlier", earlier)
    fine = F.size("_earlier") == 0
    sizes = reasons([(fine & ~F.coalesce(c("_area") > 0, F.lit(False)), "zero_or_invalid_area"), (fine & (c("_area") > 0) & (c("area_ha") < least_ha), "area_below_minimum")])
    out = df.withColumns({"issues": F.concat("_earlier", sizes), "geometry_repaired": F.coalesce(c("_repair") == "REPAIRED", F.lit(False))})
    return out.select(*raw.columns, "polygons", "area_ha", "x", "y", "geometry_repaired", "issues")
