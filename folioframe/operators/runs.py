"""Runs of characters under boxes: boxes meet whole runs by page, and the edges of a run are found by halving.

A run is a stretch of one line at one height: (doc_id, page, block, line, seq, text, cy, ...), ``seq`` the place of its first
character in the line, ``cy`` the middle of its height, and the centres of its characters, ascending. These are a column or an
expression over the run's columns that is worked out after the join, so that a run stays as short as its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.functions.text import let


def runs_of(chars: DataFrame) -> DataFrame:
    """Runs from characters, with their centres ``cxs``: a run ends where the height changes or the next centre lies before."""
    line = ["doc_id", "page", "block", "line"]
    order = Window.partitionBy(*line).orderBy("seq")
    centred = chars.select(*line, "seq", "c", ((F.col("x0") + F.col("x1")) / 2).alias("cx"), ((F.col("y0") + F.col("y1")) / 2).alias("cy"))
    fresh = (F.col("cy") != F.lag("cy").over(order)) | (F.col("cx") < F.lag("cx").over(order))
    numbered = centred.withColumn("_new", F.coalesce(fresh, F.lit(False)).cast("int")).withColumn(
        "_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = numbered.groupBy(*line, "_run").agg(F.array_sort(F.collect_list(F.struct("seq", "c", "cx"))).alias("cs"), F.first("cy").alias("cy"))
    return runs.select(*line, F.get("cs", 0)["seq"].alias("seq"), F.array_join(F.transform("cs", lambda r: r["c"]), "").alias("text"), "cy",
                       F.transform("cs", lambda r: r["cx"]).alias("cxs"))


def lower_bound(values: Column, x: Column) -> Column:
    """How many of the ascending values lie below x."""
    def halve(at, _):
        middle = F.floor((at["low"] + at["high"]) / 2).cast("int")
        return F.when(at["low"] >= at["high"], at).when(
            F.get(values, middle) < x, F.struct((middle + 1).alias("low"), at["high"].alias("high"))).otherwise(
            F.struct(at["low"].alias("low"), middle.alias("high")))

    size = F.size(values)
    steps = F.sequence(F.lit(1), F.greatest(F.ceil(F.log2(size + 1)).cast("int"), F.lit(1)))
    return F.aggregate(steps, F.struct(F.lit(0).alias("low"), size.alias("high")), halve)["low"]


def runs_in_boxes(runs: DataFrame, boxes: DataFrame, centres: Column | None = None) -> DataFrame:
    """Pairs of a run and a box (doc_id, page, bx0, by0, bx1, by1, more) whose heights meet, both half open: the columns of
    both, and ``a`` and ``b``, the places in the run where the box begins and ends. They meet page by page."""
    level = (F.col("p.cy") >= F.col("b.by0")) & (F.col("p.cy") < F.col("b.by1"))
    keys = ["doc_id", "page"]
    met = runs.alias("p").join(boxes.alias("b"), keys).where(level).select(
        *[F.col(f"p.{c}") for c in runs.columns], *[F.col(f"b.{c}") for c in boxes.columns if c not in keys])
    edges = let(F.col("cxs") if centres is None else centres, lambda values: F.struct(
        lower_bound(values, F.col("bx0")).alias("a"), lower_bound(values, F.col("bx1")).alias("b")))
    return met.withColumn("_edges", edges).withColumns({"a": F.col("_edges.a"), "b": F.col("_edges.b")}).drop("_edges")


def text_under(runs: DataFrame, boxes: DataFrame, centres: Column | None = None) -> DataFrame:
    """The pieces of text whose centres lie in a box, with the columns of the box and block, line and seq."""
    met = runs_in_boxes(runs, boxes, centres).where(F.col("b") > F.col("a"))
    piece = F.substring("text", F.col("a") + 1, F.col("b") - F.col("a")).alias("t")
    return met.select(*boxes.columns, "block", "line", (F.col("seq") + F.col("a")).alias("seq"), piece)
