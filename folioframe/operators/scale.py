"""Helpers that keep ordered and spatial work distributed, whatever the size of one key.

A plain window over ``doc_id`` puts a whole document into one task. The helpers here cut the order
column into chunks, work inside the chunks, and carry only one summary row per chunk to the next level.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.session import cut_lineage

CHUNK = 65536
_COMBINE = {"sum": F.sum, "min": F.min, "max": F.max}
_MERGE = {"sum": lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)), "min": F.least, "max": F.greatest}


def running(df: DataFrame, keys: list[str], pos: str, values: dict[str, tuple[str, Column]],
            width: int = CHUNK, levels: int = 1, own: bool = True) -> DataFrame:
    """Running sum / min / max per key in the order of the whole number ``pos``; up to the row before with ``own`` false.

    ``values`` maps an output name to (sum | min | max, input column). Rows that share a position come in
    any order, so positions should be unique within a key. One task sees at most ``width`` neighbouring
    positions, or one summary row per chunk of them; ``levels`` adds chunks of chunks. The input is read once: what a
    chunk knows by itself is written to the checkpoint folder, and only its totals meet those of other chunks.
    """
    upto = (Window.unboundedPreceding, Window.currentRow if own else -1)
    if levels == 0:
        frame = Window.partitionBy(*keys).orderBy(pos).rowsBetween(*upto)
        return df.withColumns({out: _COMBINE[how](value).over(frame) for out, (how, value) in values.items()})
    chunk, first = f"_chunk{levels}", f"_first{levels}"
    inside = Window.partitionBy(*keys, chunk)
    sums = {out: _COMBINE[how](value).over(inside.orderBy(pos).rowsBetween(*upto)) for out, (how, value) in values.items()}
    totals = {f"_t_{out}": _COMBINE[how](value).over(inside) for out, (how, value) in values.items()}
    chunked = df.withColumn(chunk, F.floor(F.col(pos) / width))
    held = cut_lineage(chunked.withColumns({**sums, **totals, first: F.row_number().over(inside.orderBy(pos)) == 1}))
    heads = held.where(first).select(*keys, chunk, *totals)
    before = running(heads, keys, chunk, {f"_b_{out}": (how, F.col(f"_t_{out}")) for out, (how, _) in values.items()},
                     width, levels - 1, False).select(*keys, chunk, *[f"_b_{out}" for out in values])
    merged = {out: _MERGE[how](F.col(out), F.col(f"_b_{out}")) for out, (how, _) in values.items()}
    return (held.drop(first, *totals).join(before, [*keys, chunk], "left").withColumns(merged)
            .drop(chunk, *[f"_b_{out}" for out in values]))


def running_through(df: DataFrame, order: str, value: Column, out: str) -> DataFrame:
    """Running sum through the whole table in the order of ``order``, whatever its values: no key, no gaps to mind.

    The table is cut into ranges of about equal row counts, one a shuffle partition. A range sums up by itself; the driver gets
    one sum a range and gives back one offset a range.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    held = cut_lineage(df.repartitionByRange(parts, order).withColumn("_range", F.spark_partition_id()).withColumn(out, F.sum(value).over(inside)))
    sums = sorted((r["_range"], r["n"] or 0) for r in held.groupBy("_range").agg(F.max_by(out, order).alias("n")).collect())
    offsets = [(k, sum(n for _, n in sums[:i])) for i, (k, _) in enumerate(sums)]
    before = spark.createDataFrame(offsets, "_range int, _before bigint")
    return held.join(F.broadcast(before), "_range").withColumn(out, F.col(out) + F.col("_before")).drop("_range", "_before")


def previous(df: DataFrame, keys: list[str], pos: str, columns: list[str], prefix: str = "prev_",
             width: int = CHUNK, levels: int = 1) -> DataFrame:
    """The values of the row before, per key in the order of ``pos``, without one task per key; the input is read once."""
    packed = F.struct(*[F.col(c) for c in columns])
    if levels == 0:
        out = df.withColumn("_prev", F.lag(packed).over(Window.partitionBy(*keys).orderBy(pos)))
    else:
        chunk = f"_chunk{levels}"
        inside = Window.partitionBy(*keys, chunk)
        held = cut_lineage(df.withColumn(chunk, F.floor(F.col(pos) / width)).withColumns({
            "_in": F.lag(packed).over(inside.orderBy(pos)), "_head": F.row_number().over(inside.orderBy(pos)) == 1,
            "_last": F.max_by(packed, F.col(pos)).over(inside)}))
        carried = previous(held.where("_head").select(*keys, chunk, "_last"), keys, chunk, ["_last"], "_c_", width, levels - 1).select(
            *keys, chunk, "_c__last")
        out = (held.drop("_last").join(carried, [*keys, chunk], "left")
               .withColumn("_prev", F.when(F.col("_head"), F.col("_c__last")).otherwise(F.col("_in")))
               .drop(chunk, "_in", "_head", "_c__last"))
    return out.withColumns({f"{prefix}{c}": F.col("_prev")[c] for c in columns}).drop("_prev")


def first_per_key(df: DataFrame, keys: list[str], order: list[Column], n: int = 1, rank: str = "_rank") -> DataFrame:
    """Top n rows of every key; Spark cuts each task to n rows before the shuffle."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= n)


def bands(low: Column, high: Column, height: float) -> Column:
    """The numbers of the horizontal bands a box touches."""
    return F.sequence(F.floor(low / height).cast("int"), F.floor(high / height).cast("int"))


def points_in_boxes(points: DataFrame, boxes: DataFrame, keys: list[str], px: str, py: str,
                    condition: Column, how: str = "inner", height: float = 50.0) -> DataFrame:
    """Join points to the boxes they fall in: equal keys and band first, exact test second.

    Boxes carry bx0, by0, bx1, by1 and are copied to each band they touch; a point lies in one band, so no
    pair can come out twice.
    """
    banded = boxes.withColumn("_band", F.explode(bands(F.col("by0"), F.col("by1"), height)))
    located = points.withColumn("_band", F.floor(F.col(py) / height).cast("int"))
    p, b = located.alias("p"), banded.alias("b")
    equal = reduce(lambda x, y: x & y, [F.col(f"p.{k}") == F.col(f"b.{k}") for k in [*keys, "_band"]])
    joined = p.join(b, equal & condition, how)
    if how in ("left_semi", "left_anti"):
        return joined.drop("_band")
    keep = [F.col(f"p.{c}") for c in points.columns] + [F.col(f"b.{c}") for c in boxes.columns if c not in keys]
    return joined.select(*keep)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give a table of only a few files to all cores. Many files, as on a cluster, are left alone: no shuffle.

    There are as many parts as in any other shuffle and several a core, so that one part of a large table stays small.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if len(df.inputFiles()) >= cores:
        return df
    parts = max(4 * cores, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(parts, *[F.col(k) for k in keys]) if keys else df.repartition(parts)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of a key in one task, in many more tasks than cores: for narrow rows from which much is made in place.

    The number of tasks is fixed, since adaptive execution sizes tasks by the narrow rows and not by what becomes of them.
    """
    spark = df.sparkSession
    parts = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), 32 * spark.sparkContext.defaultParallelism)
    return df.repartition(parts, *keys)
