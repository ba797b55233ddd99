"""Connected components of a table of edges, by stars that grow and shrink; edges stay in tables from step to step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioframe.session import cut_lineage


def _star(edges: DataFrame, large: bool, parts: int | None = None) -> DataFrame:
    """Join the neighbours of each node to its least neighbour: the greater ones (``large``), or the lesser ones and itself."""
    if large:
        near = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        moved = near.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = edges.groupBy("u").agg(F.min("v").alias("m"))  # edges lead from the greater node to the lesser
        joined = edges.join(least, "u")
        moved = (joined.select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(least.select("u", F.col("m").alias("v"))))
    moved = moved.where(F.col("u") > F.col("v"))
    return (moved.coalesce(parts).distinct().coalesce(parts) if parts else moved.distinct())


def components(edges: DataFrame, per_task: int | None = None) -> DataFrame:
    """(node, root) for every node of ``edges`` (u, v): ``root`` is the least node that it is connected with.

    Null ends and loops are left out; edges may repeat and point either way. Each step is a few joins and sums, whatever the
    shape of a component, and is written to the shared folder. The driver sees a count and a checksum. With ``per_task``
    the steps run in as many tasks as that many edges a task need, 8 at least, instead of one a shuffle partition.
    """
    now = cut_lineage(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where(F.col("u") > F.col("v")).distinct())
    parts = max(8, -(-now.count() // per_task)) if per_task else None
    seen = None
    while True:
        now = cut_lineage(_star(_star(now, True, parts), False, parts))
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
