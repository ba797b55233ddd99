"""Nearest neighbours by cosine with a permutation index.

Pivots are a bounded, seeded sample of the vectors (``PIVOTS`` of each length). A vector is represented by the order of its
nearest pivots, cut to the nearest half, and posted with its rank in the inverted file of each of them. Vectors are dealt to
blocks of about ``ROWS`` by a hash, queries to blocks of ``QUERIES``; each pair of blocks is a task. It walks the inverted
files of a query's pivots and adds up, for every vector posted there, what the footrule distance of the two orders falls
short of its largest value; the nearest ``SHARE`` of the block by footrule (``LEAST`` at least) are ranked again by the exact
cosine of the original vectors, in double precision, and the best go on.

Equal vectors are one entry with its ``top + 1`` smallest ids, which is all that a result can show, so a vector that a third
of the rows hold is one entry. Vectors that are null, empty, zero, or hold null or non-finite components take no part, nor
do rows without an id; only vectors of one length are compared. Ties of cosine go to the smaller id. Repeated rows count
once. A table with one vector, or none, gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.session import cut_lineage

PIVOTS, ROWS, QUERIES, SHARE, LEAST = 512, 2048, 4096, 0.4, 128


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def orders(x: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first; ties to the lower pivot."""
    near = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ (pivots / np.linalg.norm(pivots, axis=1, keepdims=True)).T
    return np.argsort(-near, axis=1, kind="stable")[:, :prefix]


def _sums(rows: np.ndarray) -> np.ndarray:
    """Sum of each column of bytes, eight columns to a number; up to 256 rows at a time fit in the 16 bits that each gets."""
    even, out = np.uint64(0x00FF00FF00FF00FF), np.zeros(rows.shape[1], dtype=np.uint32)
    for a in range(0, len(rows), 256):
        eight = rows[a: a + 256].view("<u8")
        out[0::2] += (eight & even).sum(axis=0).view("<u2")
        out[1::2] += ((eight >> np.uint64(8)) & even).sum(axis=0).view("<u2")
    return out


def candidates(data: np.ndarray, queries: np.ndarray, pivots: np.ndarray, share: float = SHARE, least: int = LEAST) -> list[np.ndarray]:
    """Rows of ``data`` that are nearest to each query by the footrule distance of pivot orders."""
    prefix = max(1, -(-len(pivots) // 2))
    of_data, of_queries = orders(data, pivots, prefix), orders(queries, pivots, prefix)
    # |r - s| = 2 max(r, s) - r - s, and a pivot outside an order has the rank ``prefix``: so the distance falls short of its
    # largest value by twice the sum of min(prefix - r, prefix - s) over the pivots of both orders. The inverted file of a
    # pivot holds prefix - r for every row posted in it, in a byte (the two nearest places of 256 share one), else 0.
    weight = np.minimum(prefix - np.arange(prefix), 255).astype(np.uint8)
    files = np.zeros((len(pivots), -(-len(data) // 8) * 8), dtype=np.uint8)
    files[of_data, np.arange(len(data))[:, None]] = weight
    n = min(len(data), max(least, math.ceil(share * len(data))))
    found = []
    for own in of_queries:
        near = _sums(np.minimum(files[own], weight[:, None]))[: len(data)]
        found.append(np.argpartition(near, len(data) - n)[len(data) - n:])
    return found


def search(df: DataFrame, is_query: Column, top: int = 5, key: str = "vec_id", vector: str = "embedding", pivots: int = PIVOTS,
           share: float = SHARE) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest other rows found for each query row, nearest first."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q"))
    rows = rows.where(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v")).distinct()
    rank = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    entries = cut_lineage(rows.withColumn("_r", rank).where(F.col("_r") <= top + 1).groupBy("dim", "v")
                          .agg(F.sort_array(F.collect_list("id")).alias("ids")))
    asked = cut_lineage(rows.where("q").select("dim", "v").distinct())
    seeded = F.row_number().over(Window.partitionBy("dim").orderBy(F.xxhash64(F.lit("pivot"), "v"), "v"))
    chosen: dict[int, list] = {}
    for r in entries.withColumn("_r", seeded).where(F.col("_r") <= pivots).select("dim", "v").collect():
        chosen.setdefault(r["dim"], []).append(r["v"])
    sent = df.sparkSession.sparkContext.broadcast({d: np.array(sorted(v), dtype=np.float64) for d, v in chosen.items()})
    row_parts = max(1, -(-entries.count() // ROWS))
    query_parts = max(1, -(-asked.count() // QUERIES))

    def deal(table: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        return (table.withColumn(own, F.pmod(F.xxhash64(F.lit(own), "v"), F.lit(parts)).cast("int"))
                .withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(others - 1)))).repartition("dim", "r", "c"))

    def rank_block(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: dict[str, list] = {"v": [], "id": [], "score": []}
        if data.num_rows and queries.num_rows:
            dim = data.column("dim")[0].as_py()
            ids = data.column("ids").to_pylist()
            raw = queries.column("v").to_pylist()
            x = np.array(data.column("v").to_pylist(), dtype=np.float64)
            q = np.array(raw, dtype=np.float64)
            norms = np.sqrt((x * x).sum(axis=1))
            smallest = np.array([i[0] for i in ids])
            for k, near in enumerate(candidates(x, q, sent.value[dim], share)):
                near = near[np.argpartition(-(x[near] @ q[k]) / norms[near], min(32 * top, len(near) - 1))[: 32 * top + 1]]
                cosine = (x[near] * q[k]).sum(axis=1) / (norms[near] * np.sqrt((q[k] * q[k]).sum()))
                best = np.lexsort((smallest[near], -cosine))[: top + 1]
                hits = sorted((-float(cosine[b]), i) for b in best for i in ids[near[b]])[: top + 1]
                out["v"] += [raw[k]] * len(hits)
                out["id"] += [i for _, i in hits]
                out["score"] += [-s for s, _ in hits]
        kind = {"v": queries.schema.field("v").type, "id": pa.int64(), "score": pa.float64()}
        return pa.table({n: pa.array(out[n], t) for n, t in kind.items()})

    element = df.schema[vector].dataType.simpleString()
    found = (deal(entries, "r", row_parts, "c", query_parts).groupBy("dim", "r", "c")
             .cogroup(deal(asked, "c", query_parts, "r", row_parts).groupBy("dim", "r", "c"))
             .applyInArrow(rank_block, f"v {element}, id bigint, score double"))
    order = F.row_number().over(Window.partitionBy("v").orderBy(F.col("score").desc(), "id"))
    best = (found.withColumn("_r", order).where(F.col("_r") <= top + 1).groupBy("v")
            .agg(F.sort_array(F.collect_list(F.struct("_r", "id", "score"))).alias("near")))
    others = F.slice(F.filter("near", lambda n: n["id"] != F.col("query_id")), 1, top)
    return (rows.where("q").select(F.col("id").alias("query_id"), "v").join(best, "v")
            .select("query_id", F.posexplode(others).alias("_p", "_n"))
            .select("query_id", (F.col("_p") + 1).cast("int").alias("rank"), F.col("_n.id").alias("vec_id"), F.col("_n.score").alias("score")))
