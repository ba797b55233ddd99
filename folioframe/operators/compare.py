"""Version comparison: page pairing, raster differences, touching cells joined, review marks; blank pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.functions.text import strip
from folioframe.session import cut_lineage

CELL = 12
TOLERANCE = 40
POINTS_PER_PIXEL = 72 / 110


def pair_pages(base: DataFrame, revised: DataFrame, report_removed: bool = False) -> DataFrame:
    """Pages of two versions by index: common or added; pages only in the base are reported on request."""
    b = base.select("doc_id", "page").withColumn("_b", F.lit(True))
    r = revised.select("doc_id", "page").withColumn("_r", F.lit(True))
    status = F.when(F.col("_b").isNull(), "added").when(F.col("_r").isNull(), "removed").otherwise("common")
    paired = b.join(r, ["doc_id", "page"], "full").select("doc_id", "page", status.alias("status"))
    return paired if report_removed else paired.where(F.col("status") != "removed")


def changed_cells(base: DataFrame, revised: DataFrame, tolerance: int = TOLERANCE) -> DataFrame:
    """Cells (doc_id, page, x0, y0, x1, y1 in pixels) in which any tone differs by more than the tolerance."""
    b = base.select("doc_id", "page", "cx", "cy", F.col("tones").alias("_b"))
    differs = F.exists(F.zip_with("_b", "tones", lambda x, y: F.coalesce(F.abs(x - y) > tolerance, F.lit(False))), lambda d: d)
    return revised.join(b, ["doc_id", "page", "cx", "cy"]).where(differs).select(
        "doc_id", "page", (F.col("cx") * CELL).alias("x0"), (F.col("cy") * CELL).alias("y0"),
        ((F.col("cx") + 1) * CELL).alias("x1"), ((F.col("cy") + 1) * CELL).alias("y1"))


def outgrown_strips(sizes: DataFrame) -> DataFrame:
    """What a larger revised page has beyond the shared area; ``sizes`` is (doc_id, page, ow, oh, nw, nh)."""
    w, h = F.least("ow", "nw"), F.least("oh", "nh")
    right = F.when(F.col("nw") > w, F.struct(w.alias("x0"), F.lit(0).alias("y0"), F.col("nw").alias("x1"), F.col("nh").alias("y1")))
    below = F.when(F.col("nh") > h, F.struct(F.lit(0).alias("x0"), h.alias("y0"), F.col("nw").alias("x1"), F.col("nh").alias("y1")))
    return sizes.select("doc_id", "page", F.explode(F.array_compact(F.array(right, below))).alias("s")).select("doc_id", "page", "s.*")


def merge_touching(cells: DataFrame, size: int = CELL) -> DataFrame:
    """One rectangle for each set of cells that touch at a side: (doc_id, page, x0, y0, x1, y1).

    Smallest label of the neighbours, then the label of the label, until nothing changes: the number of
    rounds grows with the logarithm of the extent. Every join is on single cells, so a full page is no hot spot,
    and each round is written to the checkpoint folder.
    """
    keys = ["doc_id", "page"]
    node = F.col("y0").cast("bigint") * (1 << 24) + F.col("x0")
    nodes = cut_lineage(cells.withColumn("node", node).dropDuplicates([*keys, "node"]))
    step = F.array(F.lit(size), F.lit(-size), F.lit(size * (1 << 24)), F.lit(-size * (1 << 24)))
    ends = nodes.select(*keys, "node", F.explode(F.transform(step, lambda s: s + F.col("node"))).alias("other"))
    edges = cut_lineage(ends.join(nodes.select(*keys, F.col("node").alias("other")), [*keys, "other"]).select(*keys, "node", "other"))
    labels = nodes.select(*keys, "node", F.col("node").alias("label"))
    while True:
        near = edges.join(labels.select(*keys, F.col("node").alias("other"), F.col("label").alias("l")), [*keys, "other"]).groupBy(
            *keys, "node").agg(F.min("l").alias("l"))
        lower = labels.join(near, [*keys, "node"], "left").select(*keys, "node", F.col("label").alias("old"),
                                                                  F.least("label", "l").alias("label"))
        far = lower.select(*keys, F.col("node").alias("label"), F.col("label").alias("far"))
        fresh = cut_lineage(lower.join(far, [*keys, "label"]).select(*keys, "node", "old", F.col("far").alias("label")))
        labels = fresh.drop("old")
        if fresh.where(F.col("old") != F.col("label")).isEmpty():
            break
    return nodes.join(labels, [*keys, "node"]).groupBy(*keys, "label").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")).drop("label")


def difference_marks(rects: DataFrame, added: DataFrame, pages: DataFrame, author: str = "", pad: float = 3.0,
                     colour: str = "#e0403a") -> DataFrame:
    """Differences as review marks: padded clouds, and the whole page where a page was added."""
    s = POINTS_PER_PIXEL
    changed = rects.select("doc_id", "page", F.array(
        F.col("x0") * s - pad, F.col("y0") * s - pad, F.col("x1") * s + pad, F.col("y1") * s + pad).alias("rect"), F.lit("変更あり").alias("contents"))
    whole = added.join(pages, ["doc_id", "page"]).select("doc_id", "page", F.array(
        F.lit(0.0), F.lit(0.0), F.col("width"), F.col("height")).alias("rect"), F.lit("追加されたページ").alias("contents"))
    return changed.unionByName(whole).withColumns({"type": F.lit("square"), "subject": F.lit("文書比較"), "author": F.lit(author),
                                                   "stroke": F.lit(colour)})


# Share of dark tones a blank page may have.
BLANK_LIMITS = {"strict": 0.0004, "normal": 0.0015, "loose": 0.004}


def blank_pages(tiles: DataFrame, texts: DataFrame, sensitivity: str = "normal") -> DataFrame:
    """(doc_id, page) with no text and almost nothing darker than the paper.

    ``tiles`` holds the tones of the inner page, ``texts`` (doc_id, page, text). Tones become counts inside
    each task before anything is shuffled: a page is never more than 256 rows.
    """
    limit = BLANK_LIMITS.get(sensitivity, BLANK_LIMITS["normal"])
    worded = texts.where(strip(F.col("text")) != "").select("doc_id", "page").distinct()
    counts = (tiles.select("doc_id", "page", F.explode("tones").alias("tone")).groupBy("doc_id", "page", "tone").agg(F.count("*").alias("n"))
              .join(worded, ["doc_id", "page"], "left_anti"))
    paper = counts.groupBy("doc_id", "page").agg(F.max_by("tone", F.struct(F.col("n"), -F.col("tone"))).alias("paper"), F.sum("n").alias("total"))
    dark = counts.join(paper, ["doc_id", "page"]).groupBy("doc_id", "page", "total").agg(
        F.sum(F.when(F.col("tone") < F.col("paper") - 60, F.col("n")).otherwise(0)).alias("dark"))
    return dark.where(F.col("dark") / F.col("total") <= limit).select("doc_id", "page")
