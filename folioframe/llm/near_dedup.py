"""Near-duplicate groups by MinHash with tensored banding: table keys are pairs of keys from two small collections.

A word is a run of characters that are not white space of ASCII, A-Z lower-cased; a text's set holds the hashes of its runs
of ``words`` words, or of all its words if they are fewer. Two collections of ``m`` keys are computed, each key from ``ROWS``
minhashes; table (i, j) has the key made of the i-th of one and the j-th of the other. So m * m tables need 2 * m keys, and a pair
is found unless it differs in all keys of one collection: ``keys_for`` gives the m for the wanted recall at the threshold.

Texts of the same set are one node. Candidates are verified on whole sets, in three steps that each leave out what is
connected already: every node with the least of the nodes that are least in one of its tables; then with all of those; and
in tables that still hold several components, the nodes outside the largest one with all others (``rest_links``), in tasks of
about ``BLOCK`` and ``GROUP`` nodes that give back a row a node. No pair of a table stays unchecked unless both are connected.
A node that many others are compared with is copied to as many tasks as it has multiples of ``GROUP``.

Null texts and texts without words have an empty set and are alone. Null keys join the group of their text and do not count for the
least; a group without keys has none. A repeated key stands for each of its texts; repeated rows are each other's copies and
all rows of the least key are kept. Very long texts are slices of their own. Extra columns do not matter. An empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioframe.llm.batches import binary, from_binary, give_back, gram_hashes, mapped, mixed, sliced, texts_of, without_empty
from folioframe.llm.components import components
from folioframe.session import cut_lineage

WORDS, PERCENT, RECALL, ROWS = 4, 80, 0.9999, 2
BLOCK, GROUP, COLUMNS, HOT, EDGES = 128, 512, 1 << 12, 1000, 100_000


def keys_for(percent: int, recall: float, rows: int = ROWS) -> int:
    """Keys of a collection with which both collections agree somewhere, with this probability, for a pair at the threshold."""
    return math.ceil(math.log(1 - math.sqrt(recall)) / math.log(1 - (percent / 100) ** rows))


def gram_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of n words of each text, ascending, and where those of each text begin and the last end."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values, codes, starts = without_empty(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0])
    names = np.array([xxhash.xxh64_intdigest(w) for w in values.to_pylist()], dtype=np.uint64)
    symbols = names[codes] if len(codes) else np.zeros(0, np.uint64)
    hashes, ends = gram_hashes(symbols, starts, n)
    out = [np.zeros(0, np.uint64)]
    for i, size in enumerate(np.diff(starts)):
        if size >= n:
            out.append(np.unique(hashes[ends[i]: ends[i + 1]]))
        elif size:
            out.append(gram_hashes(symbols[starts[i]: starts[i + 1]], np.array([0, size]), int(size))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate(out), np.cumsum([0] + [len(x) for x in out[1:]]).astype(np.int64)


def collections(hashes: np.ndarray, ends: np.ndarray, m: int, rows: int = ROWS) -> np.ndarray:
    """The keys of both collections, 2 * m for each text that has a set."""
    factors = mixed(np.arange(1, 2 * m * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    full = np.flatnonzero(np.diff(ends) > 0)
    out = np.zeros((len(full), 2 * m), dtype=np.uint64)
    for k in range(2 * m):
        key = np.full(len(full), k + 1, dtype=np.uint64)
        for r in range(rows):
            if len(full):
                key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + np.minimum.reduceat(hashes * factors[k * rows + r], ends[full]))
        out[:, k] = key
    return out


def signed(df: DataFrame, key: str, text: str, words: int, m: int) -> DataFrame:
    """(key, text_key, n_shingles, set_key, keys) for every row; the last two are null for an empty set."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        hashes, ends = gram_sets(texts_of(part, text), words)
        full = np.diff(ends) > 0
        names = [xxhash.xxh3_128_digest(hashes[a:b].tobytes()) if b > a else None for a, b in zip(ends, ends[1:])]
        keys = collections(hashes, ends, m)
        at = np.concatenate([[0], np.cumsum(full * (2 * m))]).astype(np.int32)
        offsets = pa.array(at, pa.int32(), mask=np.concatenate([~full, [False]]))
        return pa.RecordBatch.from_arrays(
            [part.column(key), part.column("text_key"), pa.array(np.diff(ends), pa.int64()), pa.array(names, pa.binary()),
             pa.ListArray.from_arrays(offsets, pa.array(keys.view(np.int64).ravel()))],
            names=[key, "text_key", "n_shingles", "set_key", "keys"])

    schema = T.StructType([T.StructField(key, df.schema[key].dataType), T.StructField("text_key", T.BinaryType()),
                           T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
                           T.StructField("keys", T.ArrayType(T.LongType()))])
    return mapped(df.select(key, text).withColumn("text_key", _digest(text)), sliced(text, work), schema)


def _digest(text: str) -> Column:
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def _named(key: str) -> Column:
    """A key as a text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def tables(nodes: DataFrame, m: int) -> DataFrame:
    """(bucket, node, center): the nodes that share a table's key with others, and the least of these."""
    pairs = F.flatten(F.transform(F.slice("keys", 1, m), lambda a: F.transform(F.slice("keys", m + 1, m), lambda b: F.xxhash64(a, b))))
    same = Window.partitionBy("bucket")
    return (nodes.select("node", F.explode(pairs).alias("bucket"))
            .select("bucket", "node", F.min("node").over(same).alias("center"), F.count("*").over(same).alias("_n"))
            .where(F.col("_n") > 1).drop("_n"))


def node_sets(df: DataFrame, wanted: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """(node, grams): the set of each wanted node, from one of the rows that have it."""
    rows = df.select(_named(key).alias("_id"), F.col(text).alias("text")).withColumn("text_key", _digest("text"))
    found = wanted.join(rows, ["_id", "text_key"]).dropDuplicates(["_id", "text_key"]).select("node", "text")

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("node"), binary(*gram_sets(texts_of(part, "text"), words))], names=["node", "grams"])

    return mapped(found, sliced("text", work), "node bigint, grams binary")


def _similar(common, a, b, percent: int):
    return 100 * common >= percent * (a + b - common)


def star_links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (node, center) whose sets are similar. The nodes of a center follow it, in sorted partitions."""
    parts = pairs.groupBy("center").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("_parts"))
    follow = (pairs.join(parts, "center").withColumn("part", F.pmod(F.xxhash64("node"), "_parts").cast("int")).join(sets, "node")
              .select("center", "part", "node", "grams"))
    lead = (parts.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
            .join(sets.withColumnRenamed("node", "center"), "center").select("center", "part", F.lit(None).cast("long").alias("node"), "grams"))
    rows = lead.unionByName(follow).repartition("center", "part").sortWithinPartitions("center", "part", F.col("node").asc_nulls_first())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = None
        for batch in batches:
            grams, ends = from_binary(batch.column("grams"), np.uint64)
            centers, nodes = batch.column("center").to_pylist(), batch.column("node").to_pylist()
            hits = []
            for i, (center, node) in enumerate(zip(centers, nodes)):
                here = grams[ends[i]: ends[i + 1]]
                if node is None:
                    of = here
                else:
                    small, large = (here, of) if len(here) < len(of) else (of, here)
                    if 100 * len(small) >= percent * len(large):
                        at = np.searchsorted(large, small)
                        common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                        if _similar(common, len(small), len(large), percent):
                            hits.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([nodes[i] for i in hits], pa.int64()), pa.array([centers[i] for i in hits], pa.int64())],
                                             names=["node", "center"])
        give_back()

    return mapped(rows, run, "node bigint, center bigint")


def rest_links(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, center): links between the components of buckets that hold several. ``rest`` is (bucket, node, root).

    All buckets with the same largest component are one group, in which a node is sent once, however many buckets it is in:
    the nodes outside that component are compared with all others of another component.
    """
    mains = (rest.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket")
             .agg(F.sum("n").alias("n"), F.max("n").alias("most"), F.max_by("root", F.struct("n", "root")).alias("main"))
             .where(F.col("n") > F.col("most")).select("bucket", "main"))
    posts = cut_lineage(rest.join(mains, "bucket").select("main", "node", "root").distinct())
    sums = posts.groupBy("main").agg(F.count("*").alias("n"), F.count_if(F.col("root") != F.col("main")).alias("k"))
    cells = posts.join(sums, "main").withColumns({"blocks": F.ceil(F.col("k") / BLOCK).cast("int"),
                                                  "slices": F.ceil(F.col("n") / GROUP).cast("int"), "h": F.xxhash64("node")})
    block, slice_ = F.pmod("h", "blocks").cast("int"), F.pmod(F.shiftright("h", 20), "slices").cast("int")
    own = cells.where(F.col("root") != F.col("main")).select("main", block.alias("block"), F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"),
                                                             "node", "root", F.lit(True).alias("own"))
    other = cells.select("main", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), slice_.alias("slice"), "node", "root",
                         F.lit(False).alias("own"))

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        nodes, roots = group.column("node").to_numpy(), group.column("root").to_numpy()
        held = [np.frombuffer(x.as_py(), np.uint64) for x in group.column("grams")]
        mine = group.column("own").to_numpy(zero_copy_only=False)
        a, b = np.flatnonzero(mine), np.flatnonzero(~mine)
        sizes = np.array([len(x) for x in held])
        similar = _similar(_overlaps([held[i] for i in a], [held[i] for i in b]), sizes[a, None], sizes[None, b], percent)
        similar &= roots[a, None] != roots[None, b]
        near, far = nodes[a], nodes[b]
        while similar.any():  # the least node in reach, on both sides
            far_now = np.minimum(far, np.where(similar, near[:, None], far[None, :]).min(axis=0))
            near_now = np.minimum(near, np.where(similar, far_now[None, :], near[:, None]).min(axis=1))
            if (far_now == far).all() and (near_now == near).all():
                break
            near, far = near_now, far_now
        x, y = similar.any(axis=1), similar.any(axis=0)
        return pa.table({"node": pa.array(np.concatenate([nodes[a][x], nodes[b][y]])), "center": pa.array(np.concatenate([near[x], far[y]]))})

    spread = own.unionByName(other).join(sets, "node").select("main", "block", "slice", "node", "root", "own", "grams")
    return spread.groupBy("main", "block", "slice").applyInArrow(verify, "node bigint, center bigint")


def _overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Number of common items of each set of one list and each of the other, by blocks of columns of the items both hold."""
    out = np.zeros((len(left), len(right)), dtype=np.int64)
    if not left or not right:
        return out
    a, b = np.concatenate(left), np.concatenate(right)
    items = np.intersect1d(a, b)

    def places(flat, sets):
        at = np.minimum(np.searchsorted(items, flat), max(len(items) - 1, 0))
        hit = items[at] == flat if len(items) else np.zeros(len(flat), dtype=bool)
        return np.repeat(np.arange(len(sets)), [len(s) for s in sets])[hit], at[hit]

    (row_a, at_a), (row_b, at_b) = places(a, left), places(b, right)
    for start in range(0, len(items), COLUMNS):
        width = min(COLUMNS, len(items) - start)
        grids = []
        for rows, at, n in ((row_a, at_a, len(left)), (row_b, at_b, len(right))):
            grid = np.zeros((n, width), dtype=np.float32)
            here = (at >= start) & (at < start + width)
            grid[rows[here], at[here] - start] = 1
            grids.append(grid)
        out += np.rint(grids[0] @ grids[1].T).astype(np.int64)
    return out


def _merged(known: DataFrame | None, links: DataFrame) -> DataFrame:
    """(node, root) after more links (node, center): these join the roots known so far."""
    if known is None:
        return cut_lineage(components(links.select(F.col("node").alias("u"), F.col("center").alias("v")), EDGES))
    found = components(_rooted(_rooted(links, known, "node", "u"), known, "center", "v").select("u", "v"), EDGES)
    moved = found.select(F.col("node").alias("_old"), F.col("root").alias("_new"))
    old = known.join(moved, known["root"] == moved["_old"], "left").select("node", F.coalesce("_new", "root").alias("root"))
    return cut_lineage(old.unionByName(found.join(known.select("node"), "node", "left_anti")))


def _rooted(rows: DataFrame, known: DataFrame, node: str, name: str) -> DataFrame:
    """Add the component of a node; a node that has none yet is its own."""
    held = known.select(F.col("node").alias("_node"), F.col("root").alias("_root"))
    return rows.join(held, F.col(node) == F.col("_node"), "left").withColumn(name, F.coalesce("_root", node)).drop("_node", "_root")


def links_of(df: DataFrame, nodes: DataFrame, key: str, text: str, words: int, percent: int, m: int) -> DataFrame:
    """(node, root): the component of every node that is similar to another."""
    held = cut_lineage(tables(nodes, m))
    wanted = held.select("node").distinct().join(nodes.select("node", "at.*"), "node")
    sets = cut_lineage(node_sets(df, wanted, key, text, words))
    stars = held.where(F.col("node") != F.col("center"))
    least = cut_lineage(stars.groupBy("node").agg(F.min("center").alias("center")))
    links = cut_lineage(star_links(least, sets, percent))
    # Who is linked to whom so far, two steps up: enough to leave out most pairs that are connected already.
    up = links.select(F.col("node").alias("center"), F.col("center").alias("_up"))
    near = links.join(up, "center", "left").select("node", F.coalesce("_up", "center").alias("root"))
    others = stars.select("node", "center").distinct().join(least, ["node", "center"], "left_anti")
    apart = _rooted(_rooted(others, near, "node", "_a"), near, "center", "_b").where(F.col("_a") != F.col("_b")).select("node", "center")
    more = cut_lineage(star_links(cut_lineage(apart), sets, percent))
    known = _merged(None, links.unionByName(more))
    # The rest of a bucket without its center, which all of them were compared with.
    rest = _rooted(stars.select("bucket", "node"), known, "node", "root")
    links = cut_lineage(rest_links(rest, sets, percent))
    return known if links.isEmpty() else _merged(known, links)


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
           recall: float = RECALL) -> DataFrame:
    """(key, n_shingles, component_id, kept) for every row: ``component_id`` is the least key among the rows that it is linked
    with, over any number of links, and ``kept`` says whether that is its own."""
    m = keys_for(percent, recall)
    rows = cut_lineage(signed(df, key, text, words, m))
    nodes = cut_lineage(rows.where(F.col("set_key").isNotNull()).groupBy("set_key").agg(
        F.min(key).alias("least"), F.count("*").alias("copies"), F.min(F.struct(_named(key).alias("_id"), "text_key")).alias("at"),
        F.first("keys").alias("keys")).withColumn("node", F.monotonically_increasing_id()))
    found = links_of(df, nodes, key, text, words, percent, m)
    rooted = _rooted(nodes.select("node", "set_key", "least", "copies"), found, "node", "root")
    firsts = rooted.groupBy("root").agg(F.min("least").alias("first"))
    classes = cut_lineage(rooted.join(firsts, "root").select("set_key", "copies", "first"))
    # Fewer than HOT sets can have more than 1 / HOT of all rows: these are sent to every task, the others shuffled.
    share = rows.count() / HOT
    hot = classes.where(F.col("copies") > share).select(F.col("set_key").alias("_hot"), F.col("first").alias("_hot_first"))
    cold = classes.where(F.col("copies") <= share).select("set_key", "first")
    plain = rows.select(key, "text_key", "n_shingles", "set_key").join(F.broadcast(hot), F.col("set_key") == F.col("_hot"), "left")
    plain = plain.withColumn("set_key", F.when(F.col("_hot").isNull() & F.col("set_key").isNotNull(), F.col("set_key")).otherwise(
        F.concat(F.lit("-").cast("binary"), F.unhex(F.md5(_named(key))))))
    component = F.when(F.col("n_shingles") == 0, F.col(key)).when(F.col("_hot").isNotNull(), F.col("_hot_first")).otherwise(F.col("first"))
    return (plain.join(cold, "set_key", "left").withColumn("component_id", component)
            .select(key, "n_shingles", "component_id", F.col(key).eqNullSafe(F.col("component_id")).alias("kept")))
