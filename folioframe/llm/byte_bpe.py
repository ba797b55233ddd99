"""Byte-level BPE over Arrow batches: a file of byte strings and ranks becomes a model of the tokenizers library.

Encoding cuts texts at single spaces, where no match of the pattern can cross, and gives the library each distinct piece
of a slice once; texts with other runs of white space go to it whole. Ids depend on the text alone: a null text counts as
empty and gives no ids, and a repeated row gives the same ids again.
"""

from __future__ import annotations

import base64
import codecs
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.batches import Pieces, binary, encoded, from_binary, gather, give_back, mapped, sliced, split, texts_of, with_columns

_CACHED, _SLICE = 200_000, 1 << 20
#: Unicode white space, as the pattern's \s takes it.
_BLANK = [chr(c) for c in [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]]


def byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1 itself, others from U+0100 on."""
    plain = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xAD)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes]:
    """The two parts that remain when a token is built by all merges of a lower rank."""
    limit, parts = ranks[token], [token[i:i + 1] for i in range(len(token))]
    while len(parts) > 2:
        found = [(r, i) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1], limit)) < limit]
        if not found:
            raise ValueError(f"no merges lead to the token {token!r}")
        i = min(found)[1]
        parts[i:i + 2] = [parts[i] + parts[i + 1]]
    return parts[0], parts[1]


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Encoder:
    """The library's model of one rank file, with the ids of words seen before."""

    def __init__(self, path: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        ranks, names, shown = load_ranks(path), vocabulary(path), byte_characters()
        merges = [tuple("".join(shown[b] for b in part) for part in _last_merge(t, ranks)) for t in sorted(ranks, key=ranks.get) if len(t) > 1]
        self.model = Tokenizer(models.BPE(vocab={names[r]: r for r in ranks.values()}, merges=merges, ignore_merges=True))
        self.model.pre_tokenizer = pre_tokenizers.Sequence([
            pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.pieces = Pieces(lambda words: self.plain([f" {w}" for w in words]), _CACHED)

    def plain(self, texts: list[str]) -> list[list[int]]:
        return encoded(self.model, texts)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        values, codes, starts = split(texts, " ")
        blank = pa.array(["", *_BLANK])
        opens, closes = (~pc.is_in(pc.utf8_slice_codeunits(values, *ends), value_set=blank).to_numpy(zero_copy_only=False)
                         for ends in ((0, 1), (-1, None)))
        bad = np.zeros(len(codes), dtype=bool)
        inner = np.ones(len(codes), dtype=bool)
        inner[starts[:-1]] = False  # split gives every text one piece at least
        bad[inner] = ~opens[codes[inner]]
        bad[:-1][inner[1:]] |= ~closes[codes[:-1][inner[1:]]]
        whole = np.add.reduceat(bad, starts[:-1]) > 0
        # The first word of each text stands without a space, or for the text as a whole.
        use = inner & ~np.repeat(whole, np.diff(starts))
        needed = np.unique(codes[use])
        data, offsets, entry = self.pieces.of(values.take(pa.array(needed)))
        first = self.plain(pc.if_else(pa.array(whole), texts, values.take(pa.array(codes[starts[:-1]]))).to_pylist())
        place = np.zeros(len(values), dtype=np.int64)
        place[needed] = entry
        order = place[codes]
        order[starts[:-1]] = len(offsets) - 1 + np.arange(len(texts))
        data = np.concatenate([data, np.array([i for ids in first for i in ids], dtype=np.uint32)])
        offsets = np.concatenate([offsets, offsets[-1] + np.cumsum([len(ids) for ids in first], dtype=np.int64)])
        keep = use.copy()
        keep[starts[:-1]] = True
        ids, ends = gather(data, offsets, order[keep])
        return ids, ends[np.concatenate([[0], np.cumsum(keep)])[starts]]


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> list[str]:
    """The tokens by id, in the characters that stand for their bytes; an id without a token is empty."""
    shown, ranks = byte_characters(), load_ranks(path)
    names = [""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        names[rank] = "".join(shown[b] for b in token)
    return names


@lru_cache(maxsize=2)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all tokens one after the other, and where each id begins and the last ends: the byte table reversed."""
    shown = byte_characters()
    back = np.zeros(max(map(ord, shown.values())) + 1, dtype=np.uint8)
    back[[ord(c) for c in shown.values()]] = list(shown)
    names = vocabulary(path)
    flat = np.frombuffer("".join(names).encode("utf-32-le"), dtype=np.uint32)
    return back[flat], np.concatenate([[0], np.cumsum([len(t) for t in names])]).astype(np.int64)


def character_spans(ids: np.ndarray, ends: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """First character of every token and the one after its last, counted within its text.

    A character whose bytes lie in several tokens belongs to each of them.
    """
    data, offsets = token_bytes(path)
    raw, stops = gather(data, offsets, ids)
    number = np.cumsum((raw & 0xC0) != 0x80)  # characters begun up to and with each byte
    begun = np.concatenate([[0], number])
    base = np.repeat(begun[stops[ends[:-1]]], np.diff(ends))
    return begun[stops[:-1] + 1] - 1 - base, begun[stops[1:]] - base


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", packed: bool = False, spans: bool = False) -> DataFrame:
    """Add ``ids`` (array of int, or with ``packed`` little-endian unsigned 32-bit integers) and ``n_tokens``.

    ``spans`` adds ``char_starts`` and ``char_ends``, the characters of every token. Columns of these names are replaced;
    all others stay. An empty table gives an empty table.
    """
    added = {"n_tokens": T.LongType(), "ids": T.BinaryType() if packed else T.ArrayType(T.IntegerType())}
    added |= {"char_starts": T.ArrayType(T.IntegerType()), "char_ends": T.ArrayType(T.IntegerType())} if spans else {}

    def work(part):
        ids, ends = encoder(path, pattern).encode(texts_of(part, text))
        column = binary(ids.astype("<u4"), ends) if packed else _lists(ids, ends)
        more = dict(zip(("char_starts", "char_ends"), (_lists(x, ends) for x in character_spans(ids, ends, path)))) if spans else {}
        return with_columns(part, n_tokens=pa.array(np.diff(ends)), ids=column, **more)

    kept = df.drop(*added)
    return mapped(kept, sliced(text, work, size=_SLICE), T.StructType([*kept.schema, *[T.StructField(k, v) for k, v in added.items()]]))


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values.astype(np.int32)))


def bytes_of(ids: np.ndarray, ends: np.ndarray, path: str) -> pa.Array:
    """The bytes of the tokens of each text; an id without a token gives none."""
    data, offsets = token_bytes(path)
    values = ids.astype(np.int64)
    known = np.where((values >= 0) & (values < len(offsets) - 1), values, len(offsets) - 1)
    raw, stops = gather(data, np.append(offsets, offsets[-1]), known)
    return binary(raw, stops[ends])


def encode_decode(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "decoded") -> DataFrame:
    """``encode`` with packed ids, and ``decode`` of these ids into ``out``, in one pass: one worker a task holds the model,
    and texts go to it once. ``n_split`` counts the tokens that begin inside a character, by their offsets in the text: the
    bytes of such a character come from several tokens and stand together again in ``out``."""
    def work(part):
        ids, ends = encoder(path, pattern).encode(texts_of(part, text))
        packed = binary(ids.astype("<u4"), ends)
        values, at = from_binary(packed, "<u4")
        first, last = character_spans(values.astype(np.int64), at, path)
        inside = np.zeros(len(values), dtype=np.int64)
        inside[1:] = first[1:] < last[:-1]
        inside[at[:-1][np.diff(at) > 0]] = 0  # the first token of a text
        count = np.concatenate([[0], np.cumsum(inside)])
        return with_columns(part, n_tokens=pa.array(np.diff(ends)), ids=packed, n_split=pa.array(count[at[1:]] - count[at[:-1]]),
                            **{out: bytes_of(values, at, path)})

    kept = df.drop("n_tokens", "ids", "n_split", out)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("n_split", T.LongType()),
             T.StructField(out, T.BinaryType())]
    return mapped(kept, sliced(text, work, size=_SLICE), T.StructType([*kept.schema, *added]))


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes of the tokens (``out``), from ids as an array or packed; null ids and ids without a token give none.

    ``F.decode(out, 'utf-8')`` makes a text of them: a character split over tokens is whole again once its tokens stand
    together; see ``decode_parts`` for ids that arrive in parts.
    """
    packed = df.schema[ids].dataType == T.BinaryType()
    work_df = (df if packed else df.withColumn("_ids", F.col(ids).cast("array<int>"))).drop(out)
    name = ids if packed else "_ids"

    def work(part):
        if packed:
            values, ends = from_binary(part.column(name), "<u4")
        else:
            rows = [r or [] for r in part.column(name).to_pylist()]
            values = np.array([v for r in rows for v in r], dtype=np.int64)
            ends = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        return with_columns(part, **{out: bytes_of(values, ends, path)})

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 128):
                yield work(batch.slice(start, 128))
        give_back()

    return mapped(work_df, run, T.StructType([*work_df.schema, T.StructField(out, T.BinaryType())])).drop("_ids")


def decode_parts(parts: list[list[int]], path: str) -> list[str]:
    """Texts of ids that arrive in parts: the bytes of an unfinished character wait for the next part."""
    data, offsets = token_bytes(path)
    reader = codecs.getincrementaldecoder("utf-8")("replace")
    out = []
    for i, ids in enumerate(parts):
        raw, _ = gather(data, offsets, np.asarray(ids, dtype=np.int64))
        out.append(reader.decode(raw.tobytes(), final=i == len(parts) - 1))
    return out
