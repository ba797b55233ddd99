"""Global order without one task: a key is cut into ranges of about equal row counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def range_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values of ``key`` that cut its rows into ranges; the driver gets no more than these."""
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(key, at, 10_000).alias("b")).first()["b"] if at else None
    return sorted({b for b in found or [] if b is not None})


def range_part(key: Column, bounds: list[int]) -> Column:
    """Number of the range that holds a value, by halving; a null stands before all values."""
    def halves(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(key < bounds[mid], halves(low, mid)).otherwise(halves(mid + 1, high))

    return F.when(key.isNull(), 0).otherwise(halves(0, len(bounds)))


def part_count(df: DataFrame, least: int = 8) -> int:
    """Ranges to cut into: as many as a shuffle has partitions."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
