"""How filters interact: for each order in which they can be applied, what each step removes, and what was gone already.

A document's failures are the bits of a mask, so a part of the documents is known by the counts of its masks: 32 cells for
five filters, summed before and after one shuffle. Subsets of filters are walked in Gray code, one filter on or off at a
time: each cell keeps the number of active filters that it fails, and enters or leaves the running survivors when that
number leaves or reaches zero. The survivors of all subsets are stored; any step of any order is a difference of two.

Copies are found over the whole table by a digest of the text: rows are counted by digest before digests meet, so that a text
of many copies is a few rows. Null texts are empty ones. A row without a key is no copy of another and others are no copies
of it; equal keys are no copies of each other. Repeated rows count each. Labels that repeat a key count once, 1 if any is
1. An empty table has no parts. Other columns do not matter, whatever their names; very long texts are read where they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

FILTERS = "ABCDE"
WORDS, DISTINCT, CAPITALS = 100, 80, 10
COUNTS = ["n", "good", "toxic"]
REPORT = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def text_mask(rows: DataFrame, text: str, mask: str = "mask") -> DataFrame:
    """Add the failures that a text shows by itself: few words (bit 0), few distinct words (1), many capitals (2), signs (3)."""
    words = F.filter(F.split(F.translate(text, "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != "")
    size, distinct = F.col("_sizes.all"), F.col("_sizes.distinct")
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]", ""))
    failing = [size < WORDS, 100 * distinct < DISTINCT * size, 100 * capitals > CAPITALS * F.length(text), F.col(text).rlike(r"[#$%&*|]")]
    both = F.transform(F.array(words), lambda w: F.struct(F.size(w).alias("all"), F.size(F.array_distinct(w)).alias("distinct")))
    bits = sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failing)), F.lit(0))
    return rows.withColumn("_sizes", both[0]).withColumn(mask, bits).drop("_sizes")


def cells(docs: DataFrame, labels: DataFrame, part: Column, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of a part by the filters that they fail, among them those with a label of 1."""
    plain = docs.select(F.col(key).alias("key"), F.coalesce(part, F.lit("")).alias("part"), F.coalesce(text, F.lit("")).alias("text"))
    masked = text_mask(plain, "text").select("key", "part", "mask", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"))
    rows = masked.groupBy("key", "digest", "part", "mask").agg(F.count("*").alias("n"))
    marks = labels.groupBy(F.col(key).alias("key")).agg(*[
        F.max(F.when(F.col(c) == 1, 1).otherwise(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    counted = rows.join(marks, "key", "left").withColumns({c: F.col("n") * F.coalesce(c, F.lit(0)) for c in COUNTS[1:]})
    # All rows of a digest, its rows of the least key, and those without a key, which are no copies.
    now = F.struct(*COUNTS)
    without = [F.sum(F.when(F.col("key").isNull(), F.col(c)).otherwise(0)).alias(f"_w_{c}") for c in COUNTS]
    texts = counted.groupBy("digest", "part", "mask").agg(
        *[F.sum(c).alias(c) for c in COUNTS], *without, F.min("key").alias("_key"), F.min_by(now, "key").alias("_least"))
    texts = texts.withColumn("_is_least", F.col("_key") == F.min("_key").over(Window.partitionBy("digest")))  # a row a part
    firsts = {c: F.when(F.col("_is_least"), F.col(f"_least.{c}")).otherwise(0) + F.col(f"_w_{c}") for c in COUNTS}
    copy = 1 << FILTERS.index("E")
    both = texts.select("part", F.explode(F.array(
        F.struct("mask", *[firsts[c].alias(c) for c in COUNTS]),
        F.struct((F.col("mask") + copy).alias("mask"), *[(F.col(c) - firsts[c]).alias(c) for c in COUNTS]))).alias("cell"))
    return (both.where(F.col("cell.n") > 0).groupBy("part", "cell.mask")
            .agg(*[F.sum(f"cell.{c}").alias(c) for c in COUNTS]))


def survivors(counts: np.ndarray) -> np.ndarray:
    """For every subset of filters, as bits, the sum of the rows of ``counts`` (one for each mask) that fail none of it."""
    masks = np.arange(len(counts))
    failing = np.zeros(len(counts), dtype=np.int64)
    states = np.empty_like(counts)
    running = counts.sum(axis=0)
    states[0] = running
    subset = 0
    for step in range(1, len(counts)):
        bit = step & -step  # Gray code: the lowest set bit of the step's number is toggled
        subset ^= bit
        hit = masks & bit != 0
        if subset & bit:
            running = running - counts[hit & (failing == 0)].sum(axis=0)
            failing[hit] += 1
        else:
            failing[hit] -= 1
            running = running + counts[hit & (failing == 0)].sum(axis=0)
        states[subset] = running
    return states


def steps(filters: str = FILTERS) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """For each step of each order: the order, the step's number, its filter's number, and the filters before it as bits."""
    orders = ["".join(o) for o in permutations(filters)]
    which = np.array([[filters.index(c) for c in o] for o in orders])
    bits = 1 << which
    return orders, np.tile(np.arange(1, len(filters) + 1), len(orders)), which.ravel(), (np.cumsum(bits, axis=1) - bits).ravel()


def walk(found: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Rows a part, order and step, from the cells of a part."""
    orders, number, which, before = steps(filters)
    names = pa.array(np.repeat(orders, len(filters)).tolist(), pa.string())
    bit, every = 1 << which, (1 << len(filters)) - 1

    def one(part: str, held: list[dict]) -> pa.RecordBatch:
        counts = np.zeros((every + 1, len(COUNTS)), dtype=np.int64)
        for cell in held:
            counts[cell["mask"]] += [cell[c] for c in COUNTS]
        states = survivors(counts)
        lost = states[before] - states[before | bit]
        failing = states[0, 0] - states[bit, 0]
        shares = np.bincount(which, weights=lost[:, 0], minlength=len(filters)).astype(np.int64)
        columns = [states[before | bit, 0], lost[:, 0], failing - lost[:, 0], states[every ^ bit, 0] - states[every, 0],
                   lost[:, 1], lost[:, 2], shares[which]]
        return pa.RecordBatch.from_arrays(
            [pa.array([part] * len(which), pa.string()), names, pa.array(number, pa.int32()), *[pa.array(c, pa.int64()) for c in columns]],
            names=["part", "filter_order", "step", *REPORT])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist()):
                yield one(part, held)

    gathered = found.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))  # at most one a mask
    return gathered.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in REPORT))


def audit(docs: DataFrame, labels: DataFrame, part: str = "lang", key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each part, order of the filters and step; ``shapley`` is what a filter removes, summed over all orders."""
    return walk(cells(docs, labels, F.col(part), key, text))
