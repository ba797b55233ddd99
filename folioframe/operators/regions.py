"""Marks inside regions of a page: boxes, lassos and eraser spots, many regions against many marks at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.geometry import intersects, point_in_polygon, stroke_within
from folioframe.operators.scale import bands, points_in_boxes

BOX = ["x0", "y0", "x1", "y1"]


def marks_in_boxes(marks: DataFrame, regions: DataFrame, height: float = 50.0) -> DataFrame:
    """(doc_id, page, region, id): marks whose box meets a region. Both carry a box in four columns.

    The two meet in the first band they share, so a pair comes out once and no distinct is needed.
    """
    m = marks.select("doc_id", "page", "id", *BOX, F.floor(F.col("y0") / height).alias("_first")).withColumn(
        "_band", F.explode(bands(F.col("y0"), F.col("y1"), height))).alias("m")
    r = regions.select("doc_id", "page", "region", *BOX, F.floor(F.col("y0") / height).alias("_first")).withColumn(
        "_band", F.explode(bands(F.col("y0"), F.col("y1"), height))).alias("r")
    meet = intersects([F.col(f"m.{c}") for c in BOX], [F.col(f"r.{c}") for c in BOX])
    first = F.col("m._band") == F.greatest(F.col("m._first"), F.col("r._first"))
    return m.join(r, ["doc_id", "page", "_band"]).where(meet & first).select("doc_id", "page", "region", "id")


def marks_in_lassos(marks: DataFrame, lassos: DataFrame) -> DataFrame:
    """Marks whose centre lies inside a polygon (array of points); fewer than three points hold nothing."""
    centred = marks.select("doc_id", "page", "id", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    ys = F.transform("polygon", lambda p: p[1])
    boxes = lassos.where(F.size("polygon") >= 3).select(
        "doc_id", "page", "region", "polygon", F.array_min(ys).alias("by0"), F.array_max(ys).alias("by1"), F.lit(0.0).alias("bx0"), F.lit(0.0).alias("bx1"))
    inside = point_in_polygon(F.col("p.cx"), F.col("p.cy"), F.col("b.polygon"))
    return points_in_boxes(centred, boxes, ["doc_id", "page"], "cx", "cy", inside).select("doc_id", "page", "region", "id")


def erased_strokes(inks: DataFrame, spots: DataFrame) -> DataFrame:
    """Ink marks (doc_id, page, id, width, locked, strokes of points) an eraser spot (region, x, y) touches.

    The reach is 5 pt and half the pen width; each ink is copied to the bands its reach covers.
    """
    reach = F.lit(5.0) + F.col("width") / 2
    flat = F.flatten(F.col("strokes"))
    ys = F.transform(flat, lambda p: p[1])
    free = inks.where(~F.coalesce("locked", F.lit(False))).select(
        "doc_id", "page", "id", flat.alias("pts"), reach.alias("reach"), (F.array_min(ys) - reach).alias("by0"),
        (F.array_max(ys) + reach).alias("by1"), F.lit(0.0).alias("bx0"), F.lit(0.0).alias("bx1"))
    near = stroke_within(F.col("b.pts"), F.col("p.x"), F.col("p.y"), F.col("b.reach"))
    hits = points_in_boxes(spots.select("doc_id", "page", "region", "x", "y"), free, ["doc_id", "page"], "x", "y", near)
    return hits.select("doc_id", "page", "id").distinct()
