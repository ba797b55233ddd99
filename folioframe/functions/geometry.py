"""Boxes and points as column expressions. A box is four columns or array(x0, y0, x1, y1), top-left origin."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def point_to_view(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> Column:
    """Page space to what the reader sees; width and height are those of the unrotated page."""
    r = F.pmod(rotation, F.lit(360))
    return (F.when(r == 90, F.array(height - y, x)).when(r == 180, F.array(width - x, height - y))
            .when(r == 270, F.array(y, width - x)).otherwise(F.array(x, y)))


def point_to_page(x: Column, y: Column, rotation: Column, width: Column, height: Column) -> Column:
    r = F.pmod(rotation, F.lit(360))
    return (F.when(r == 90, F.array(y, height - x)).when(r == 180, F.array(width - x, height - y))
            .when(r == 270, F.array(width - y, x)).otherwise(F.array(x, y)))


def _moved(rect: Column, move) -> Column:
    a, b = move(rect[0], rect[1]), move(rect[2], rect[3])
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[0], b[0]), F.greatest(a[1], b[1]))


def rect_to_view(rect: Column, rotation: Column, width: Column, height: Column) -> Column:
    return _moved(rect, lambda x, y: point_to_view(x, y, rotation, width, height))


def rect_to_page(rect: Column, rotation: Column, width: Column, height: Column) -> Column:
    return _moved(rect, lambda x, y: point_to_page(x, y, rotation, width, height))


def points_to_view(points: Column, rotation: Column, width: Column, height: Column) -> Column:
    return F.transform(points, lambda p: point_to_view(p[0], p[1], rotation, width, height))


def quad_to_view(quad: Column, rotation: Column, width: Column, height: Column) -> Column:
    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: point_to_view(
        F.get(quad, i * 2), F.get(quad, i * 2 + 1), rotation, width, height)))


def flip_rect(rect: Column, height: Column) -> Column:
    """Between top-left and bottom-left origin; the same formula both ways."""
    return F.array(rect[0], height - rect[3], rect[2], height - rect[1])


def turned(rotation: Column) -> Column:
    return F.pmod(rotation, F.lit(180)) == 90


def view_width(width: Column, height: Column, rotation: Column) -> Column:
    return F.when(turned(rotation), height).otherwise(width)


def view_height(width: Column, height: Column, rotation: Column) -> Column:
    return F.when(turned(rotation), width).otherwise(height)


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, x1 - x0) * F.greatest(zero, y1 - y0)


def overlap_fraction(a: list[Column], b: list[Column]) -> Column:
    """Share of box a that box b covers."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    own = area(*a)
    return F.when((w <= 0) | (h <= 0) | (own == 0), 0.0).otherwise(w * h / own)


def intersects(a: list[Column], b: list[Column]) -> Column:
    return (a[0] < b[2]) & (a[2] > b[0]) & (a[1] < b[3]) & (a[3] > b[1])


def union(a: Column, b: Column) -> Column:
    return F.array(F.least(a[0], b[0]), F.least(a[1], b[1]), F.greatest(a[2], b[2]), F.greatest(a[3], b[3]))


def encloses(outer: Column, inner: Column, slack: float = 0.6) -> Column:
    return ((outer[0] <= inner[0] + slack) & (outer[1] <= inner[1] + slack)
            & (outer[2] >= inner[2] - slack) & (outer[3] >= inner[3] - slack))


def bounds(points: Column, pad: float = 0.0) -> Column:
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.array(F.array_min(xs) - pad, F.array_min(ys) - pad, F.array_max(xs) + pad, F.array_max(ys) + pad)


def translated(values: Column, dx: Column, dy: Column) -> Column:
    """Move a flat list of x, y pairs (a rectangle or a quad)."""
    return F.transform(values, lambda v, i: v + F.when(i % 2 == 0, dx).otherwise(dy))


def translated_points(points: Column, dx: Column, dy: Column) -> Column:
    return F.transform(points, lambda p: F.array(p[0] + dx, p[1] + dy))


def scaled_points(points: Column, source: Column, target: Column) -> Column:
    """Points of box ``source`` carried into box ``target``; a flat source scales by its target size."""
    def factor(lo, hi):
        span = source[hi] - source[lo]
        return (target[hi] - target[lo]) / F.when(span == 0, 1.0).otherwise(span)

    sx, sy = factor(0, 2), factor(1, 3)
    return F.transform(points, lambda p: F.array(target[0] + (p[0] - source[0]) * sx, target[1] + (p[1] - source[1]) * sy))


def point_in_polygon(x: Column, y: Column, polygon: Column) -> Column:
    """Ray casting over the edges of an array of points."""
    before = F.concat(F.slice(polygon, -1, 1), F.slice(polygon, F.lit(1), F.size(polygon) - 1))

    def crosses(e):
        xi, yi, xj, yj = e["p"][0], e["p"][1], e["q"][0], e["q"][1]
        return F.when(((yi > y) != (yj > y)) & (x < (xj - xi) * (y - yi) / (yj - yi) + xi), 1).otherwise(0)

    edges = F.arrays_zip(polygon.alias("p"), before.alias("q"))
    return F.aggregate(edges, F.lit(0), lambda n, e: n + crosses(e)) % 2 == 1


def stroke_within(points: Column, x: Column, y: Column, reach: Column) -> Column:
    """Whether any point of a stroke lies closer to a spot than ``reach``."""
    return F.exists(points, lambda p: F.hypot(p[0] - x, p[1] - y) < reach)
