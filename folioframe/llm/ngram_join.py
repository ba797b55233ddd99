"""Similarity join on word n-grams: MinHash bands find candidates, whole n-gram sets decide.

Words are split at white space and lower-cased; a text of fewer than n words is one n-gram. Texts that are equal are one
class and take part once. ``bands_for`` gives the number of bands for the wanted recall of a pair at the threshold.
Buckets of one band hash with the same members are kept once. A bucket is cut into blocks of about ``BLOCK`` members by a
hash, and every pair of blocks is a task: it counts the pairs whose sets are similar, each pair only in the first kept
bucket that holds both, and gives back one row a member (its links, and the least member that it is connected with), never
a row a pair. So a hot bucket is spread over many tasks and no link is lost.

Null and blank texts take part in no pair: they are alone in their class, with no link. Documents that repeat a key and a
text are copies of each other. An empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.batches import binary, gram_hashes, mixed, mapped, sliced, texts_of, without_empty
from folioframe.llm.components import components
from folioframe.session import cut_lineage

WORDS, THRESHOLD, RECALL, ROWS = 5, 0.8, 0.99999, 5
BLOCK, COLUMNS = 128, 1 << 14


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Bands of ``rows`` rows that find a pair of this similarity with this probability at least."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold ** rows))


def shingles(texts: pa.Array, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct n-grams of each text in ascending order, and where those of each text begin and the last end."""
    lists = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    values, codes, starts = without_empty(coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0])
    names = np.array([xxhash.xxh64_intdigest(w) for w in values.to_pylist()], dtype=np.uint64)
    symbols = names[codes] if len(codes) else np.zeros(0, np.uint64)
    hashes, ends = gram_hashes(symbols, starts, n)
    out = []
    for i in range(len(starts) - 1):
        if ends[i + 1] > ends[i]:
            out.append(np.unique(hashes[ends[i]: ends[i + 1]]))
        elif starts[i + 1] > starts[i]:
            out.append(gram_hashes(symbols[starts[i]: starts[i + 1]], np.array([0, starts[i + 1] - starts[i]]), int(starts[i + 1] - starts[i]))[0])
        else:
            out.append(np.zeros(0, np.uint64))
    return np.concatenate([np.zeros(0, np.uint64), *out]), np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int64)


def band_hashes(hashes: np.ndarray, ends: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A hash of each band of each text: of the least values of ``rows`` permutations of its n-grams. No text may be empty."""
    factors = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    out = np.empty((len(ends) - 1, bands), dtype=np.uint64)
    for b in range(bands):
        band = np.full(len(ends) - 1, b + 1, dtype=np.uint64)
        for k in range(rows):
            least = np.minimum.reduceat(hashes * factors[b * rows + k], ends[:-1])
            band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + least)
        out[:, b] = band
    return out


def classes(df: DataFrame, key: str, text: str, words: int, bands: int, rows: int) -> DataFrame:
    """(text_key, rep, copies, bands): a row for each distinct text that is not blank; ``rep`` is its least ``key``."""
    def sign(part):
        hashes, ends = shingles(texts_of(part, text), words)
        full = np.flatnonzero(np.diff(ends) > 0)
        kept = part.take(pa.array(full))
        found = band_hashes(hashes, np.concatenate([ends[:-1][full], ends[-1:]]), bands, rows) if len(full) else np.zeros((0, bands), np.uint64)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(full) + 1, dtype=np.int32) * bands), pa.array(found.view(np.int64).ravel()))
        return pa.RecordBatch.from_arrays([kept.column("text_key"), kept.column(key), lists], names=["text_key", key, "bands"])

    schema = T.StructType([T.StructField("text_key", T.BinaryType()), T.StructField(key, df.schema[key].dataType),
                           T.StructField("bands", T.ArrayType(T.LongType()))])
    signed = mapped(keyed(df.select(key, text), text), sliced(text, sign), schema)
    return signed.groupBy("text_key").agg(F.min(key).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"))


def keyed(df: DataFrame, text: str) -> DataFrame:
    """Add ``text_key``, a digest of the text."""
    return df.withColumn("text_key", F.unhex(F.md5(F.col(text))))


def named(key: str) -> Column:
    """A key as a text that is never null, to join on."""
    return F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit(""))


def kept_buckets(signed: DataFrame) -> DataFrame:
    """(text_key, buckets): for each class the buckets that hold others too, as (bucket, members), least bucket first."""
    members = signed.select(F.explode("bands").alias("bucket"), "text_key")
    h = F.xxhash64("text_key")
    several = (members.groupBy("bucket").agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"), F.sum(h % 1_000_003).alias("s"),
                                             F.min("text_key").alias("m")).where(F.col("n") > 1)
               .groupBy("n", "x", "s", "m").agg(F.min("bucket").alias("bucket")).select("bucket", "n"))
    return members.join(several, "bucket").groupBy("text_key").agg(F.sort_array(F.collect_set(F.struct("bucket", "n"))).alias("buckets"))


def _links(sets: list[np.ndarray], side: np.ndarray, earlier: list[np.ndarray], threshold: float):
    """Which members of a task are similar and counted here, as a matrix. ``side`` is the block of each member: unless all
    are of one block, only pairs of different blocks count."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    common = _overlaps(sets)
    similar = common / np.maximum(sizes[:, None] + sizes[None, :] - common, 1) >= threshold
    similar &= ~np.eye(n, dtype=bool)
    if len(np.unique(side)) > 1:
        similar &= side[:, None] != side[None, :]
    if similar.any():
        similar &= _overlaps(earlier) == 0
    return similar


def _overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Number of common items of all pairs of sets: items of one set alone are left out, the others counted by blocks of columns."""
    n = len(sets)
    out = np.zeros((n, n), dtype=np.int64)
    flat = np.concatenate(sets)
    if not len(flat):
        return out
    _, inverse, counts = np.unique(flat, return_inverse=True, return_counts=True)
    column = np.cumsum(counts > 1) - 1
    shared = counts[inverse] > 1
    owner, item = np.repeat(np.arange(n), [len(s) for s in sets])[shared], column[inverse[shared]]
    for a in range(0, int((counts > 1).sum()), COLUMNS):
        here = (item >= a) & (item < a + COLUMNS)
        grid = np.zeros((n, COLUMNS), dtype=np.float32)
        grid[owner[here], item[here] - a] = 1
        out += (grid @ grid.T).round().astype(np.int64)
    return out


def linked(df: DataFrame, signed: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
           threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """(text_key, root, links): for classes with similar others, some least class that each is connected with and the number
    of documents of other classes that it is similar to; several rows a class."""
    wanted = kept_buckets(signed).join(signed.select("text_key", "rep", "copies"), "text_key")
    texts = keyed(df.select(named(key).alias("_id"), F.col(text).alias("text")), "text")
    # The rows of a key and text lie together after the join, so that leaving out repeated ones needs no other shuffle.
    rows = (wanted.withColumn("_id", named("rep")).drop("rep").join(texts, ["text_key", "_id"])
            .dropDuplicates(["text_key", "_id"]).select("text_key", "copies", "buckets", "text"))

    def gram_sets(part):
        hashes, ends = shingles(texts_of(part, "text"), words)
        return pa.RecordBatch.from_arrays([part.column("text_key"), part.column("copies"), part.column("buckets"), binary(hashes, ends)],
                                          names=["text_key", "copies", "buckets", "grams"])

    schema = T.StructType([f for f in rows.schema if f.name != "text"] + [T.StructField("grams", T.BinaryType())])
    blocks = F.ceil(F.col("b.n") / block).cast("int")
    spread = (mapped(rows, sliced("text", gram_sets), schema)
              .select("text_key", "copies", "grams", F.transform("buckets", lambda b: b["bucket"]).alias("all"), F.explode("buckets").alias("b"))
              .withColumn("own", F.pmod(F.xxhash64("text_key"), blocks).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
              .select("text_key", "copies", "grams", F.filter("all", lambda x: x < F.col("b.bucket")).alias("earlier"), "own",
                      F.col("b.bucket").alias("bucket"), F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")))

    def verify(group: pa.Table) -> pa.Table:
        group = group.combine_chunks()
        names = group.column("text_key").to_pylist()
        order = np.array(sorted(range(len(names)), key=names.__getitem__))
        sets = [np.frombuffer(group.column("grams")[int(i)].as_py(), dtype=np.uint64) for i in order]
        earlier = [np.array(group.column("earlier")[int(i)].as_py(), dtype=np.int64) for i in order]
        weight = group.column("copies").to_numpy()[order]
        similar = _links(sets, group.column("own").to_numpy()[order], earlier, threshold)
        root = np.arange(len(order))
        while True:  # the least member in reach
            least = np.minimum(root, np.where(similar, root[None, :], len(order)).min(axis=1))
            if (least == root).all():
                break
            root = least
        hit = np.flatnonzero(similar.any(axis=1))
        return pa.table({"text_key": pa.array([names[order[i]] for i in hit], pa.binary()),
                         "root": pa.array([names[order[root[i]]] for i in hit], pa.binary()),
                         "links": pa.array((similar @ weight)[hit], pa.int64())})

    return spread.groupBy("bucket", "low", "high").applyInArrow(verify, "text_key binary, root binary, links bigint")


def groups(df: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, threshold: float = THRESHOLD,
           recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """(text_key, rep, copies, first_key, class_id, links): every class of equal texts, the group it is in, and its links.

    ``class_id`` is the least key in the group, ``first_key`` the class of the group that holds it, and ``links`` the number
    of documents that are equal or similar to a document of the class, itself left out.
    """
    signed = cut_lineage(classes(df, key, text, words, bands_for(threshold, recall, rows), rows))
    found = cut_lineage(linked(df, signed, key, text, words, threshold))
    links = found.groupBy("text_key").agg(F.sum("links").alias("_links"))
    roots = components(found.select(F.col("text_key").alias("u"), F.col("root").alias("v"))).withColumnRenamed("node", "text_key")
    whole = signed.drop("bands").join(links, "text_key", "left").join(roots, "text_key", "left")
    whole = whole.withColumn("root", F.coalesce("root", "text_key"))
    first = whole.groupBy("root").agg(F.min(F.struct("rep", "text_key")).alias("_first"))
    return whole.join(first, "root").select(
        "text_key", "rep", "copies", F.col("_first.text_key").alias("first_key"), F.col("_first.rep").alias("class_id"),
        (F.coalesce("_links", F.lit(0)) + F.col("copies") - 1).alias("links"))


def join(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """(key, class_id, n_links): one row per document; see ``groups``. A null or blank text is a class of its own."""
    found = groups(df, key, text, **how).select("text_key", "class_id", "links")
    rows = keyed(df.select(key, text), text).select(key, "text_key")
    return rows.join(found, "text_key", "left").select(
        key, F.when(F.col("links").isNull(), F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("links", F.lit(0)).alias("n_links"))


def first_of_groups(df: DataFrame, key: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The rows of ``df`` that stay when one document of each group stays: the one with the least key; of repeated rows one.
    Rows whose text is in no class (null or blank) all stay."""
    found = groups(df, key, text, **how)
    stay = found.where(F.col("text_key") == F.col("first_key")).select(F.col("text_key").alias("_tk"), named("rep").alias("_id"))
    packed = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), named(key).alias("_id"), F.col(text).alias("_text"))
    rows = keyed(packed, "_text").withColumnRenamed("text_key", "_tk").drop("_text")
    kept = rows.join(stay, ["_tk", "_id"]).dropDuplicates(["_tk", "_id"])
    # A text without letters, digits and signs may have no class; the classes decide.
    mute = rows.where(~F.coalesce(F.col(f"_row.`{text}`"), F.lit("")).rlike(r"[\p{L}\p{N}\p{P}\p{S}]"))
    alone = mute.join(found.select(F.col("text_key").alias("_tk")), "_tk", "left_anti")
    return kept.select("_row.*").unionByName(alone.select("_row.*"))
