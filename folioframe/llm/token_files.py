"""Token ids in files of patched frame-of-reference blocks.

A table of tokens is a Parquet folder with one row per document, in ascending order of the id within each range of ids:
``part`` (number of the range), ``seq`` (ascends with the documents of a range), the id column, ``n_tokens``, ``payload``
(the blocks) and ``block_starts`` (byte at which each block begins in ``payload``).

A block holds up to 256 ids of one document. Little-endian layout: count - 1 (1 byte), width w in bits (1), number of
exceptions (2; the highest bit says that their high parts take 4 bytes and not 2), minimum (4); the low w bits of every id
less the minimum, packed from the highest bit on and filled up to a byte; places of the exceptions (1 byte each); their
remaining high bits (2 or 4 bytes each). w is the width that one of ``PERCENTILES`` of the differences fits in: the one
that makes the block smallest.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioframe.llm.batches import Pieces, binary, encoded, from_binary, gather, mapped, sliced, split, texts_of, with_columns, without_empty
from folioframe.llm.order import part_count, range_bounds, range_part

BLOCK, HEAD, PERCENTILES = 256, 8, (75, 90, 100)
_CACHED, _TOKENS, _SLICE = 700_000, 1 << 17, 8 << 20


# ---------------------------------------------------------------- ids of a text

class Words:
    """A tokenizer file of the tokenizers library whose white space never carries an id: words are encoded once a slice."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        model = Tokenizer.from_file(path)
        self.pieces = Pieces(lambda found: encoded(model, found), _CACHED)

    def encode(self, texts: pa.Array, last: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with ``last`` behind it, and where each text begins and the last ends."""
        values, codes, starts = without_empty(*split(pc.replace_substring(texts, "\n", " "), " "))
        data, offsets, entry = self.pieces.of(values)
        order = np.insert(entry[codes], starts[1:], len(offsets) - 1)
        ids, ends = gather(np.append(data, np.uint32(last)), np.append(offsets, len(data) + 1), order)
        return ids, ends[starts + np.arange(len(starts))]


@lru_cache(maxsize=2)
def words(path: str) -> Words:
    return Words(path)


# ---------------------------------------------------------------- blocks

_BITS = np.array([n.bit_length() for n in range(1 << 16)], dtype=np.uint8)


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that unsigned 32-bit numbers need."""
    high = values >> 16
    return _BITS[values] if not high.any() else np.where(high > 0, _BITS[high] + np.uint8(16), _BITS[values & 0xFFFF])


def pack(ids: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    """Payload and block starts of every document; ``ends`` says where each document begins and the last ends."""
    payloads, starts, doc = [], [], 0
    while doc < len(ends) - 1:  # about _TOKENS ids at a time, or one document
        stop = max(doc + 1, int(np.searchsorted(ends, ends[doc] + _TOKENS, side="right")) - 1)
        more = _pack(ids[ends[doc]: ends[stop]].astype(np.uint32), ends[doc: stop + 1] - ends[doc])
        payloads, starts, doc = payloads + more[0], starts + more[1], stop
    return payloads, starts


def _pack(ids: np.ndarray, ends: np.ndarray) -> tuple[list[bytes], list[np.ndarray]]:
    per_doc = -(-np.diff(ends) // BLOCK)
    first = np.concatenate([[0], np.cumsum(per_doc)])
    start = np.repeat(ends[:-1], per_doc) + (np.arange(first[-1]) - np.repeat(first[:-1], per_doc)) * BLOCK
    count = np.minimum(np.repeat(ends[1:], per_doc) - start, BLOCK)
    if not len(count):
        return [b""] * len(per_doc), [np.zeros(0, np.int64)] * len(per_doc)
    inside = np.arange(BLOCK)[None, :] < count[:, None]
    grid = ids[np.minimum(start[:, None] + np.arange(BLOCK), len(ids) - 1)]
    low = np.where(inside, grid, np.uint32(0xFFFFFFFF)).min(axis=1)
    rest = np.where(inside, grid - low[:, None], np.uint32(0))
    bits = np.sort(np.where(inside, _widths(rest), np.uint8(99)), axis=1)
    wide = np.where(bits[np.arange(len(count)), count - 1] > 16, 4, 2)
    best = np.full(len(count), 1 << 30)
    width = np.zeros(len(count), dtype=np.int64)
    for percentile in PERCENTILES:
        w = bits[np.arange(len(count)), (count * percentile + 99) // 100 - 1].astype(np.int64)
        size = (count * w + 7) // 8 + (np.count_nonzero(bits > w.astype(np.uint8)[:, None], axis=1) - BLOCK + count) * (1 + wide)
        width, best = np.where(size < best, w, width), np.minimum(size, best)
    high = rest.astype(np.int64) >> width[:, None]
    odd = (high > 0).sum(axis=1)
    packed: list[bytes] = [b""] * len(count)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        low_bits = (rest[rows] & np.uint32((1 << w) - 1)).astype(">u2" if w <= 16 else ">u4")
        if w == 16:  # whole bytes need no bit work
            body = low_bits.view(np.uint8)
        else:
            flags = np.unpackbits(low_bits.view(np.uint8), axis=1).reshape(len(rows), BLOCK, -1)
            body = np.packbits(flags[:, :, flags.shape[2] - w:].reshape(len(rows), -1), axis=1)
        for row, line, n in zip(rows.tolist(), body, ((count[rows] * w + 7) // 8).tolist()):
            packed[row] = line[:n].tobytes()
    blocks = []
    for i, body in enumerate(packed):
        if odd[i]:
            at = np.flatnonzero(high[i])
            body += at.astype(np.uint8).tobytes() + high[i][at].astype(f"<u{wide[i]}").tobytes()
        flag = int(odd[i]) | (1 << 15 if wide[i] == 4 else 0)
        blocks.append((int(count[i] - 1) | int(width[i]) << 8 | flag << 16 | int(low[i]) << 32).to_bytes(HEAD, "little") + body)
    sizes = np.array([len(b) for b in blocks], dtype=np.int64)
    return ([b"".join(blocks[a:b]) for a, b in zip(first[:-1], first[1:])],
            [np.cumsum(sizes[a:b]) - sizes[a:b] for a, b in zip(first[:-1], first[1:])])


def _numbers(rows: np.ndarray, w: int) -> np.ndarray:
    """The numbers of w bits, highest bit first, that the bytes of each row hold: the 8 bytes around each number, shifted."""
    if w == 16:
        return np.ascontiguousarray(rows[:, : rows.shape[1] // 2 * 2]).view(">u2")
    wide = np.pad(rows, ((0, 0), (0, 8)))
    bit = np.arange(rows.shape[1] * 8 // w) * w
    words = np.zeros((len(rows), len(bit)), dtype=np.uint64)
    for k in range((w + 14) // 8):  # bytes that a number can lie in
        words = words << np.uint64(8) | wide[:, bit // 8 + k]
    spare = ((w + 14) // 8 * 8 - bit % 8 - w).astype(np.uint64)
    return (words >> spare) & np.uint64((1 << w) - 1)


def unpack(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the blocks that begin at the bytes ``at``, one after the other, and where each block begins and the last ends."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(1, np.int64)
    head = raw[at[:, None] + np.arange(HEAD)].astype(np.int64)
    count, width, odd, wide = head[:, 0] + 1, head[:, 1], head[:, 2] | (head[:, 3] & 127) << 8, np.where(head[:, 3] > 127, 4, 2)
    low = head[:, 4] | head[:, 5] << 8 | head[:, 6] << 16 | head[:, 7] << 24
    ends = np.concatenate([[0], np.cumsum(count)])
    out = np.zeros(ends[-1], dtype=np.int64)
    size = (count * width + 7) // 8
    for w in np.unique(width[width > 0]):
        rows = np.flatnonzero(width == w)
        most = int(size[rows].max())
        take = np.minimum(at[rows][:, None] + HEAD + np.arange(most), len(raw) - 1)
        values = _numbers(raw[take], int(w))
        valid = np.arange(values.shape[1])[None, :] < count[rows][:, None]
        to = ends[:-1][rows][:, None] + np.arange(values.shape[1])
        out[to[valid]] = values[valid]
    for i in np.flatnonzero(odd):
        a = at[i] + HEAD + size[i]
        place = raw[a: a + odd[i]].astype(np.int64)
        high = np.frombuffer(raw[a + odd[i]: a + (1 + wide[i]) * odd[i]].tobytes(), dtype=f"<u{wide[i]}").astype(np.int64)
        out[ends[i] + place] |= high << width[i]
    return out + np.repeat(low, count), ends


# ---------------------------------------------------------------- files

def write(df: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> None:
    """Encode the texts and write them to ``folder`` in ascending order of ``key``.

    Nulls come first, repeated keys follow one another in the order of their texts, a null text counts as empty and
    holds ``end_id`` alone. Other columns of ``df`` are left out. An empty table gives an empty folder with a schema.
    """
    parts = part_count(df)
    bounds = range_bounds(df, key, parts)

    def work(part):
        ids, ends = words(path).encode(texts_of(part, text), end_id)
        payloads, starts = pack(ids, ends)
        return pa.RecordBatch.from_arrays(
            [part.column("part"), part.column(key), pa.array(np.diff(ends)), pa.array(payloads, pa.binary()),
             pa.array(starts, pa.list_(pa.int32()))], names=["part", key, "n_tokens", "payload", "block_starts"])

    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField(key, df.schema[key].dataType),
                           T.StructField("n_tokens", T.LongType()), T.StructField("payload", T.BinaryType()),
                           T.StructField("block_starts", T.ArrayType(T.IntegerType()))])
    ordered = (df.select(range_part(F.col(key), bounds).alias("part"), key, text).repartition(parts, "part")
               .sortWithinPartitions("part", F.col(key).asc_nulls_first(), F.coalesce(text, F.lit(""))))
    (mapped(ordered, sliced(text, work, size=_SLICE), schema).withColumn("seq", F.monotonically_increasing_id())
     .write.option("compression", "none").parquet(folder))


def starts_of(table: DataFrame) -> DataFrame:
    """(seq, start): ids of all documents before each one. Each range adds up alone; the sums of the ranges, one row each, are
    added up in one task and sent to all."""
    def before(order):
        return order.rowsBetween(Window.unboundedPreceding, -1)

    sums = table.groupBy("part").agg(F.sum("n_tokens").alias("_sum"))
    bases = sums.select("part", F.coalesce(F.sum("_sum").over(before(Window.orderBy("part"))), F.lit(0)).alias("_base"))
    local = F.coalesce(F.sum("n_tokens").over(before(Window.partitionBy("part").orderBy("seq"))), F.lit(0))
    return (table.select("part", "seq", local.alias("_local")).join(F.broadcast(bases), "part")
            .select("seq", (F.col("_base") + F.col("_local")).alias("start")))


def read(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Documents of a folder: ``key``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` (packed, 32 bits each)."""
    return decoded(spark, folder, key).join(starts_of(spark.read.parquet(folder)), "seq").select(key, "start", "n_tokens", "ids")


def decoded(spark: SparkSession, folder: str, key: str = "doc_id") -> DataFrame:
    """Documents of a folder without their starts: ``seq``, ``key``, ``n_tokens``, ``ids``."""
    table = spark.read.parquet(folder)

    def work(part):
        raw, at = from_binary(part.column("payload"), np.uint8)
        lists = part.column("block_starts")
        per_doc = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(at[:-1], per_doc)
        ids, ends = unpack(raw, starts)
        docs = ends[np.concatenate([[0], np.cumsum(per_doc)])]
        return pa.RecordBatch.from_arrays([part.column("seq"), part.column(key), pa.array(np.diff(docs)), binary(ids.astype("<u4"), docs)],
                                          names=["seq", key, "n_tokens", "ids"])

    schema = T.StructType([T.StructField("seq", T.LongType()), T.StructField(key, table.schema[key].dataType),
                           T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return mapped(table.select("seq", key, "payload", "block_starts"), sliced("payload", work, size=_SLICE // 4), schema)
