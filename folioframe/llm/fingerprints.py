"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, in DataFrame operations only.

A paragraph is a line; a long line counts as several, each at least 100 characters and up to the end of a sentence. What is
still longer than ``LONG`` characters is cut by its content: before each word whose hash meets a mask, in words longer than
``WORD`` before each run of that many characters and one whose hash does, and after ``LONG`` characters without such a place.
The digest of a paragraph is a 64-bit hash, and a text is the
set of its digests. A sketch has three subtables of cells; a digest falls into one cell of each, by its own bits, and a cell keeps the count, the xor of
its digests and the xor of their check hashes. The fingerprint is the sketch of ``BASE`` cells a subtable, as text.

Two versions are compared by subtracting cell from cell and peeling: a cell that holds one digest gives it away, the digest
is taken out of its other cells, and so on for ``ROUNDS`` rounds. What is recovered is the set of differing digests. If cells
stay filled the sketch was too small and a larger one is tried: the digests are dealt to buckets of about ``LOAD``, as many
as the two counts ask for, each with a sketch of ``CELLS`` a subtable; a bucket that fails once more gets ``MORE`` cells; what
even these cannot peel is compared digest by digest. Likeness is the share of common digests among all (1 for two empty
texts).

A null text counts as empty. Neighbours are taken in descending order of the key, nulls last, equal keys by descending
text; after the last document comes the first. Keys are cut into ranges, so that no task sorts all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.llm.order import part_count, range_bounds, range_part

PARAGRAPH = r"[^\n]{100,}?(?:[.!?](?=[ \t\n]|$)|[。！？｡।॥؟۔])|[^\n]+"
LONG, WORD, WORD_MASK, RUN_MASK = 200, 24, 15, 63
BASE, CELLS, MORE, LOAD, ROUNDS = 4, 8, 32, 6, 5


def digests(text: Column, paragraph: str = PARAGRAPH) -> Column:
    """Distinct digests of the paragraphs that are not blank."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(paragraph), F.lit(0))
    parts = F.transform(F.flatten(F.transform(found, chunks)), lambda p: F.trim(p))
    return F.array_distinct(F.transform(F.filter(parts, lambda p: p != ""), lambda p: F.xxhash64(p)))


def chunks(line: Column) -> Column:
    """The line itself, or the pieces of a long one: the hash of the characters ahead sets the cuts, wherever they stand."""
    unit = rf"[^ \t]{{1,{WORD}}}+(?![^ \t])[ \t]*+|[ \t]++"

    def marked(block: Column) -> Column:
        ahead = F.regexp_extract_all(block, F.lit(rf"(?s)(?=({unit}|.{{{WORD + 1}}}))(?:{unit}|.)"), F.lit(1))

        def mark(w: Column) -> Column:
            run = (F.length(w) > WORD) & ~F.substring(w, -1, 1).isin(" ", "\t")  # only its first character is passed
            hit = F.xxhash64(w).bitwiseAND(F.when(run, F.lit(RUN_MASK)).otherwise(F.lit(WORD_MASK))) == 0
            return F.concat(F.when(hit, F.lit("\n")).otherwise(F.lit("")), F.when(run, F.substring(w, 1, 1)).otherwise(w))

        return F.array_join(F.transform(ahead, mark), "")

    # A task holds the runs of one block at a time, however long the line.
    blocks = F.transform(F.regexp_extract_all(line, F.lit(r"[^\n]{1,65536}"), F.lit(0)), marked)
    cut = F.regexp_extract_all(F.array_join(blocks, ""), F.lit(rf"[^\n]{{1,{LONG}}}"), F.lit(0))
    return F.when(F.length(line) > LONG, cut).otherwise(F.array(line))


def _hits(h: Column, cell: Column) -> Column:
    return h.bitwiseAND(cell["mask"]) == cell["of"]


def _layout(per: int) -> Column:
    """The cells of a sketch: the bits of a digest that choose it, and their value there."""
    return F.array(*[F.struct(F.lit((per - 1) << (8 * t)).cast("long").alias("mask"), F.lit(i << (8 * t)).cast("long").alias("of"))
                     for t in range(3) for i in range(per)])


def _empty() -> Column:
    return F.struct(F.lit(0).alias("c"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("g"))


def sketch(found: Column, per: int) -> Column:
    """Cells of a set of digests: count, xor of digests, xor of checks."""
    return F.transform(_layout(per), lambda cell: F.aggregate(
        F.filter(found, lambda h: _hits(h, cell)), _empty(),
        lambda a, h: F.struct((a["c"] + 1).alias("c"), a["k"].bitwiseXOR(h).alias("k"), a["g"].bitwiseXOR(F.xxhash64(h)).alias("g"))))


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.struct((x["c"] - y["c"]).alias("c"), x["k"].bitwiseXOR(y["k"]).alias("k"),
                                                  x["g"].bitwiseXOR(y["g"]).alias("g")))


def _left(cells: Column) -> Column:
    return F.exists(cells, lambda x: (x["c"] != 0) | (x["k"] != 0))


def peel(cells: Column, per: int) -> Column:
    """Number of digests that peeling recovers, or null if cells stay filled."""
    def clean(x: Column, cell: Column, pure: Column) -> Column:
        return F.aggregate(F.filter(pure, lambda p: _hits(p["k"], cell)), x, lambda a, p: F.struct(
            (a["c"] - p["s"]).alias("c"), a["k"].bitwiseXOR(p["k"]).alias("k"), a["g"].bitwiseXOR(p["g"]).alias("g")))

    def round_(state: Column) -> Column:
        pure = F.array_distinct(F.transform(
            F.filter(state["x"], lambda x: (F.abs(x["c"]) == 1) & (F.xxhash64(x["k"]) == x["g"])),
            lambda x: F.struct(x["c"].alias("s"), x["k"].alias("k"), x["g"].alias("g"))))
        return F.transform(F.array(pure), lambda found: F.when(F.size(found) == 0, state).otherwise(F.struct(
            F.zip_with(state["x"], _layout(per), lambda x, cell: clean(x, cell, found)).alias("x"),
            (state["n"] + F.size(found)).alias("n"))))[0]

    start = F.struct(cells.alias("x"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, lambda state, _: round_(state),
                       lambda state: F.when(~_left(state["x"]), state["n"]))


def as_text(cells: Column) -> Column:
    """A sketch as text: the counts and digests of its cells in hexadecimal."""
    return F.array_join(F.transform(cells, lambda x: F.concat(F.lower(F.hex(x["c"])), F.lit("."), F.lower(F.hex(x["k"])))), "-")


def compare(df: DataFrame, keys: list[str], first: str, others: list[str], paragraph: str = PARAGRAPH) -> DataFrame:
    """Compare the text in ``first`` with those in ``others``. ``keys`` tell rows apart; where rows of equal keys lie in one
    task already, nothing is shuffled. Adds ``print_<text>`` for every text and ``near_<text>`` for the others; drops the
    texts."""
    names = [first, *others]
    df = df.withColumns({f"_d_{t}": digests(F.col(t), paragraph) for t in names}).drop(*names)
    df = df.withColumns({f"_s_{t}": sketch(F.col(f"_d_{t}"), BASE) for t in names})
    df = df.withColumns({f"print_{t}": as_text(F.col(f"_s_{t}")) for t in names})
    df = df.withColumns({f"_f_{t}": peel(subtract(F.col(f"_s_{first}"), F.col(f"_s_{t}")), BASE) for t in others})
    df = df.drop(*[f"_s_{t}" for t in names])
    sums = {t: F.size(f"_d_{first}") + F.size(f"_d_{t}") for t in others}
    df = df.withColumns({f"_n_{t}": n for t, n in sums.items()})
    again = [F.col(f"_f_{t}").isNull() for t in others]
    most = F.greatest(*[F.when(a, F.col(f"_n_{t}")).otherwise(0) for a, t in zip(again, others)], F.lit(0))
    df = df.withColumn("_buckets", F.ceil(most / LOAD))
    kept = [c for c in df.columns if not c.startswith("_d_") and c not in keys]

    # One row carries the columns, the others a digest each; a text that no retry needs sends none.
    def sent(number: int, t: str, needed: Column) -> Column:
        return F.when(needed, F.transform(f"_d_{t}", lambda h: F.struct(F.lit(number).alias("v"), h.alias("h")))).otherwise(
            F.array().cast("array<struct<v:int,h:bigint>>"))

    head = F.array(F.struct(F.lit(-1).alias("v"), F.lit(None).cast("long").alias("h")))
    some = F.col("_buckets") > 0
    items = F.concat(head, sent(0, first, some), *[sent(i + 1, t, a) for i, (t, a) in enumerate(zip(others, again))])
    rows = df.select(*keys, "_buckets", F.struct(*kept).alias("_row"), F.posexplode(items).alias("_i", "_x"))
    bucket = F.when(F.col("_i") > 0, F.pmod(F.shiftright(F.col("_x.h"), 24), F.col("_buckets"))).otherwise(-1)
    lists = (rows.select(*keys, bucket.alias("_bucket"), F.when(F.col("_i") == 0, F.col("_row")).alias("_row"), "_x")
             .groupBy(*keys, "_bucket").agg(
                 F.first("_row", ignorenulls=True).alias("_row"),
                 *[F.collect_list(F.when(F.col("_x.v") == i, F.col("_x.h"))).alias(f"_d_{t}") for i, t in enumerate(names)]))
    for per in (CELLS, MORE):
        old = {t: F.col(f"_g_{t}") for t in others} if per == MORE else {}
        failed = {t: old[t].isNull() if old else F.lit(True) for t in others}
        any_failed = F.greatest(*[f.cast("int") for f in failed.values()], F.lit(0)) > 0
        lists = lists.withColumns({f"_s_{t}": F.when(any_failed, sketch(F.col(f"_d_{t}"), per)) for t in names})
        tried = {t: peel(F.when(failed[t], subtract(F.col(f"_s_{first}"), F.col(f"_s_{t}"))), per) for t in others}
        lists = (lists.withColumns({f"_g_{t}": F.coalesce(*([old[t]] if old else []), tried[t]) for t in others})
                 .drop(*[f"_s_{t}" for t in names]))
    exact = {t: F.size(F.array_except(f"_d_{first}", f"_d_{t}")) + F.size(F.array_except(f"_d_{t}", f"_d_{first}")) for t in others}
    lists = lists.withColumns({f"_g_{t}": F.coalesce(f"_g_{t}", exact[t]) for t in others})
    whole = lists.groupBy(*keys).agg(F.first("_row", ignorenulls=True).alias("_row"), *[F.sum(f"_g_{t}").alias(f"_g_{t}") for t in others])

    def near(t: str) -> Column:
        n = F.col(f"_row._n_{t}")
        differing = F.coalesce(F.col(f"_row._f_{t}").cast("long"), F.col(f"_g_{t}"))
        return F.when(n == 0, F.lit(1.0)).otherwise((n - differing) / (n + differing)).alias(f"near_{t}")

    plain = [c for c in kept if not c.startswith("_")]
    return whole.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in plain], *[near(t) for t in others])


def with_next(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(part, row, key, text, next): every document with the text of the one after it in descending order of ``key``.

    The rows of a range are sorted in one task. The first document of each range is sent to the range before it as well:
    one row a range, found by its key.
    """
    docs = df.select(F.col(key).alias("key"), F.coalesce(text, F.lit("")).alias("text"))
    bounds = range_bounds(docs, "key", part_count(docs))
    docs = docs.withColumn("part", range_part(F.col("key"), bounds))
    tops = sorted(((r["part"], r["top"]) for r in docs.groupBy("part").agg(F.max("key").alias("top")).collect()), reverse=True)
    spark = df.sparkSession
    # The range before, in descending order, is the next higher one; before the highest comes the lowest.
    before = [(top, tops[i - 1][0]) for i, (_, top) in enumerate(tops)]
    firsts = spark.createDataFrame(before, f"_top {docs.schema['key'].dataType.simpleString()}, _to int")
    copies = (docs.join(F.broadcast(firsts), F.col("key").eqNullSafe(F.col("_top"))).groupBy("_to", "_top")
              .agg(F.max("text").alias("text")).select(F.col("_top").alias("key"), "text", F.col("_to").alias("part"), F.lit(1).alias("copy")))
    order = Window.partitionBy("part").orderBy("copy", F.col("key").desc_nulls_last(), F.col("text").desc())
    rows = docs.withColumn("copy", F.lit(0)).unionByName(copies)
    return (rows.withColumns({"row": F.row_number().over(order), "next": F.lead("text").over(order)})
            .where(F.col("copy") == 0).select("part", "row", F.col("key").alias(key), "text", "next"))
