"""Mixing sources to target weights by Sainte-Laguë apportionment of equal blocks of words.

The words of a source lie in shards (documents by a seeded hash, ``SHARD_DOCS`` a shard on average), and within a shard in
a seeded order of documents, cut into blocks of ``BLOCK`` words. Highest quotients give each source a whole number of
blocks by its target, then each shard of the source a whole quota by its size. A shard takes all blocks as often as its
quota allows and picks the rest of the quota by a seeded permutation of its blocks. All of it is DataFrame work; what is
sorted in one task is a shard, or the table of sources or of the shards of a source.

A null text holds no words. A null source is a source of its own and comes last. Documents of one key are told apart by
their size only, so repeated rows are interchangeable. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from folioframe.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
#: A word with the blanks after it, to the last line feed among them if there is one; indents go with the word that they
#: precede, as do the blanks at the start of a text. The pieces of a text, one a word, make up the whole text.
PIECE = rf"(?:\A[\x20\x09-\x0D]+|(?<=\n)[\x20\x09\x0B-\x0D]+)?{WORD}(?:[\x20\x09-\x0D]*+\z|[\x20\x09-\x0D]*\n|[\x20\x09-\x0D]*)"
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
BLOCK, SHARD_DOCS, SEED, BROADCAST_ROWS = 8, 4096, "mix", 50_000
#: A prime above the number of blocks of any shard: times it, modulo their number, permutes the blocks.
_PRIME = 2147483647


def number(*parts) -> Column:
    """A seeded whole number below 2 ** 32 made of the parts; a null counts as empty."""
    text = F.concat_ws("/", F.lit(SEED), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def small(df: DataFrame) -> DataFrame:
    """The table to be sent to all tasks, if counting shows that it has ``BROADCAST_ROWS`` rows at most; else to be shuffled."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def apportion(df: DataFrame, group: list[str], weight: str, seats: str, order: str, out: str) -> DataFrame:
    """Add ``out``: seats of each row by highest quotients w / (2 j + 1), ``seats`` in all for a group; ties to lower ``order``.

    Seats that no order of quotients can change are given by arithmetic; as few quotients as three a row are compared.
    """
    whole = Window.partitionBy(*group)
    total, rows = F.sum(weight).over(whole), F.sum((F.col(weight) > 0).cast("long")).over(whole)
    sure = df.withColumns({"_w": total, "_k": rows}).withColumn(
        "_sure", F.when((F.col("_w") > 0) & (F.col(seats) > F.col("_k") / 2),
                        F.floor(F.col(weight) * (F.col(seats) - F.col("_k") / 2) / F.col("_w") + 0.5)).otherwise(F.lit(0)).cast("long"))
    left = sure.withColumn("_left", F.when(F.col("_w") > 0, F.col(seats)).otherwise(F.lit(0)) - F.sum("_sure").over(whole))
    more = F.when(F.col(weight) > 0, F.floor(F.col(weight) * F.col("_k") / F.col("_w")).cast("long") + 2).otherwise(F.lit(0))
    tried = left.withColumn("_j", F.explode_outer(F.when(more > 0, F.sequence(F.lit(0).cast("long"), more - 1))))
    quotient = F.col(weight) / (2 * (F.col("_sure") + F.col("_j")) + 1)
    ranked = tried.withColumn("_rank", F.row_number().over(
        Window.partitionBy(*group).orderBy(quotient.desc_nulls_last(), F.col(order), F.col("_j"))))
    won = F.sum((F.col("_j").isNotNull() & (F.col("_rank") <= F.col("_left"))).cast("long"))
    return (ranked.groupBy(*df.columns, "_sure").agg(won.alias("_won"))
            .select(*df.columns, (F.col("_sure") + F.col("_won")).alias(out)))


def targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to (source, source_size): by weight, none above ``most`` times its size, the excess reshared by weight.

    Taken in ascending order of cap by weight, a source is capped as long as the share that is then left for it is above its
    cap. One task sorts the sources, a row each.
    """
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    everything = Window.partitionBy(F.lit(0))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    rows = sources.withColumns({"rank": F.row_number().over(by_name), "weight": weight, "cap": (most * F.col("source_size")).cast("double"),
                                "_all": share * F.sum("source_size").over(everything)})
    by_cap = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_all") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    rows = rows.withColumn("_level", level).withColumn("_capped", F.col("weight") * F.col("_level") >= F.col("cap"))
    final = F.min(F.when(~F.col("_capped"), F.struct(F.col("cap") / F.col("weight"), "rank", "_level"))).over(everything)["_level"]
    return (rows.withColumn("target", F.when(F.col("_capped"), F.col("cap")).otherwise(F.col("weight") * final))
            .drop("weight", "cap", "_all", "_level", "_capped"))


def sized(df: DataFrame, text: str = "text") -> DataFrame:
    """Add ``size``, the number of words."""
    return df.withColumn("size", F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"))


def quotas(sizes: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """(source, shard, source_size, target, shards, n_blocks, quota) from the sizes of documents: a row for every shard."""
    found = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_docs"))
    aimed = targets(found).withColumn("shards", F.ceil(F.col("_docs") / SHARD_DOCS)).drop("_docs")
    seats = aimed.withColumn("_seats", F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block).cast("long"))
    sources = cut_lineage(apportion(seats, ["_seats"], "target", "_seats", "rank", "blocks").drop("_seats"))
    in_shards = with_shard(sizes, sources, key).groupBy("source", "shard").agg(F.sum("size").alias("_size"))
    shards = in_shards.join(small(sources.withColumnRenamed("source", "_s")), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    given = apportion(shards.withColumn("_group", F.col("rank")), ["_group"], "_size", "blocks", "shard", "quota")
    n_blocks = F.ceil(F.col("_size") / block)
    return given.select("source", "shard", "rank", "source_size", "target", "shards", n_blocks.alias("n_blocks"),
                        F.least("quota", MOST * n_blocks).alias("quota"))


def with_shard(df: DataFrame, sources: DataFrame, key: str) -> DataFrame:
    named = small(sources.select(F.col("source").alias("_s"), "shards"))
    return (df.join(named, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
            .withColumn("shard", number(F.col(key)) % F.col("shards")).drop("shards"))


def mix(df: DataFrame, plan: DataFrame, key: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """Add to rows with ``source`` and ``size`` what the mix takes: ``source_size``, ``target``, ``taken`` (words, repeats
    counted), ``passes`` (whole takes) and ``picked`` (numbers of the document's blocks that are taken once more, with
    ``first_block`` and ``offset``, the words of its first block that belong to documents before)."""
    sources = plan.select("source", "shards").distinct()
    order = Window.partitionBy("_source", "shard").orderBy(F.md5(F.concat_ws("/", F.lit(SEED), F.col(key).cast("string"))),
                                                           F.col(key), "size")
    placed = (with_shard(df, sources, key).withColumn("_source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
              .withColumn("_start", F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    shards = plan.select(F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_source"), "shard", "source_size", "target",
                         "n_blocks", "quota", "rank")
    n = F.greatest("n_blocks", F.lit(1))
    turn = number(F.col("rank"), F.col("shard"))
    rows = placed.join(shards, ["_source", "shard"]).withColumns({
        "passes": F.floor(F.col("quota") / n), "_rest": F.col("quota") % n, "_n": n, "_turn": turn,
        "first_block": F.floor(F.col("_start") / block), "offset": F.col("_start") % block})
    blocks = F.when(F.col("size") > 0, F.sequence("first_block", F.floor((F.col("_start") + F.col("size") - 1) / block)))
    rows = rows.withColumn("picked", F.coalesce(
        F.filter(blocks, lambda b: (b * _PRIME + F.col("_turn")) % F.col("_n") < F.col("_rest")), F.array().cast("array<bigint>")))
    words = F.aggregate("picked", F.lit(0).cast("long"), lambda total, b: total + F.least(
        (b + 1) * block, F.col("_start") + F.col("size")) - F.greatest(b * block, F.col("_start")))
    return (rows.withColumn("taken", F.col("passes") * F.col("size") + words)
            .drop("_source", "shard", "_start", "n_blocks", "quota", "rank", "_rest", "_n", "_turn"))


def taken_rows(mixed: DataFrame, columns: list[str], text: str = "text", block: int = BLOCK) -> DataFrame:
    """The documents that the mix holds: one row for each whole take, and one with the picked blocks, in order. Adjacent
    blocks make a passage, cut from the text with its own white space; a line feed is put between passages. It is the
    text itself where all blocks are picked. Documents without words are taken by no block and stay out."""
    place = lambda i: F.col("first_block") + F.floor((F.col("offset") + i) / block)

    def piece(w: Column, i: Column) -> Column:
        b = place(i)
        new = ((F.col("offset") + i) % block == 0) & (b > F.get("picked", F.lit(0))) & ~F.array_contains("picked", b - 1)
        return F.when(F.array_contains("picked", b), F.when(new, F.concat(F.lit("\n"), w)).otherwise(w))

    chosen = F.array_join(F.transform(F.regexp_extract_all(F.col(text), F.lit(PIECE), F.lit(0)), piece), "")
    n_blocks = F.floor((F.col("offset") + F.col("size") - 1) / block) + 1
    part = F.when(F.size("picked") == 0, F.lit(None)).when(F.size("picked") == n_blocks, F.col(text)).otherwise(chosen)
    whole = F.array_repeat(F.col(text), F.when(F.col("size") > 0, F.col("passes")).otherwise(0).cast("int"))
    texts = F.concat(whole, F.when(part.isNull(), F.array().cast("array<string>")).otherwise(F.array(part)))
    rows = mixed.withColumn("_text", F.explode(texts))
    exact = {text: F.col("_text")} | ({"n_chars": F.length("_text").cast("long")} if "n_chars" in columns else {})
    return rows.withColumns(exact).select(*columns)
