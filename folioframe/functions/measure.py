"""Measures over arrays of points (array<array<double>>), with a scale of page points to real length."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from folioframe.functions.labels import AREA_UNITS, lookup

# One unit in millimetres.
UNITS = {"pt": 25.4 / 72, "mm": 1.0, "cm": 10.0, "m": 1000.0, "in": 25.4, "ft": 304.8}


def scale_factor(page_points: Column, real_length: Column) -> Column:
    points = F.when(F.coalesce(page_points, F.lit(0.0)) == 0, 1.0).otherwise(page_points)
    real = F.when(F.coalesce(real_length, F.lit(0.0)) == 0, 1.0).otherwise(real_length)
    return F.when(points <= 0, 1.0).otherwise(real / points)


def _pairs(points: Column) -> Column:
    """Each point with the one after it."""
    head = F.slice(points, F.lit(1), F.greatest(F.size(points) - 1, F.lit(0)))
    tail = F.slice(points, F.lit(2), F.greatest(F.size(points) - 1, F.lit(0)))
    return F.arrays_zip(head.alias("a"), tail.alias("b"))


def _sum(items: Column, value) -> Column:
    return F.aggregate(items, F.lit(0.0), lambda acc, p: acc + value(p))


def distance(points: Column, factor: Column) -> Column:
    return _sum(_pairs(points), lambda p: F.hypot(p["b"][0] - p["a"][0], p["b"][1] - p["a"][1])) * factor


def closed_loop(points: Column) -> Column:
    return F.concat(points, F.slice(points, 1, 1))


def perimeter(points: Column, factor: Column, always_close: bool = False) -> Column:
    """Closed from three points on; ``always_close`` follows the live panel, which closes two points as well."""
    if always_close:
        return distance(closed_loop(points), factor)
    return F.when(F.size(points) > 2, distance(closed_loop(points), factor)).otherwise(distance(points, factor))


def area(points: Column, factor: Column) -> Column:
    twice = _sum(_pairs(closed_loop(points)), lambda p: p["a"][0] * p["b"][1] - p["b"][0] * p["a"][1])
    return F.when(F.size(points) < 3, 0.0).otherwise(F.abs(twice) / 2 * factor * factor)


def volume(points: Column, factor: Column, depth: Column) -> Column:
    return area(points, factor) * depth


def angle(points: Column) -> Column:
    """Degrees at the middle one of three points."""
    def heading(i):
        return F.atan2(F.try_element_at(points, F.lit(i))[1] - F.try_element_at(points, F.lit(2))[1],
                       F.try_element_at(points, F.lit(i))[0] - F.try_element_at(points, F.lit(2))[0])

    turn = F.degrees(F.abs(heading(1) - heading(3)))
    return F.when(F.size(points) < 3, 0.0).otherwise(F.when(turn > 180, 360 - turn).otherwise(turn))


def radius(points: Column, factor: Column) -> Column:
    return distance(F.slice(points, 1, 2), factor)


def value_of(kind: Column, points: Column, factor: Column, depth: Column, always_close: bool = False) -> Column:
    """One measurement, rounded to six places; an unknown kind gives null."""
    raw = (F.when(kind == "distance", distance(points, factor))
           .when(kind == "perimeter", perimeter(points, factor, always_close))
           .when(kind == "area", area(points, factor)).when(kind == "angle", angle(points))
           .when(kind == "radius", radius(points, factor)).when(kind == "volume", volume(points, factor, depth)))
    return F.round(raw, 6)


def label_of(value: Column, kind: Column, unit: Column, precision: int = 2) -> Column:
    number = F.format_string(f"%.{precision}f", value)
    square = F.coalesce(lookup(AREA_UNITS, unit), F.concat(unit, F.lit("²")))
    return (F.when(kind == "angle", F.concat(number, F.lit("°")))
            .when(kind == "area", F.concat_ws(" ", number, square))
            .when(kind == "volume", F.concat(number, F.lit(" "), unit, F.lit("³")))
            .otherwise(F.concat_ws(" ", number, unit)))


def calibrate(first: Column, second: Column, real_length: Column, unit: Column) -> Column:
    """A scale from a line drawn over a known dimension."""
    return F.struct(F.hypot(second[0] - first[0], second[1] - first[1]).alias("pagePoints"),
                    real_length.alias("realLength"),
                    F.when(unit.isin(list(UNITS)), unit).otherwise("mm").alias("unit"))


def convert(value: Column, source: Column, target: Column) -> Column:
    one = F.lit(1.0)
    return value * F.coalesce(lookup(UNITS, source), one) / F.coalesce(lookup(UNITS, target), one)


def size_text(size: Column) -> Column:
    """Bytes as KB or MB for people."""
    mb = size / F.lit(1024.0 * 1024.0)
    return (F.when(mb >= 10, F.concat(F.format_string("%.0f", mb), F.lit(" MB")))
            .when(mb >= 1, F.concat(F.format_string("%.1f", mb), F.lit(" MB")))
            .otherwise(F.concat(F.greatest(F.lit(1), F.floor(size / 1024.0 + 0.5)).cast("string"), F.lit(" KB"))))
