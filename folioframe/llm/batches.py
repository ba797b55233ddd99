"""Arrow batches of texts as flat numpy arrays: the tasks of the operators work on slices of a bounded size."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_ROWS, SLICE_BYTES, BATCH_BYTES = 4096, 1 << 20, "4m"


def slices(batch: pa.RecordBatch, column: str, rows: int = SLICE_ROWS, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that the texts of a slice hold ``size`` bytes at most, or one text; every row stays whole."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = int(np.searchsorted(ends, before + size, side="right"))
        stop = min(max(stop, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def sliced(column: str, work: Callable[[pa.RecordBatch], pa.RecordBatch], size: int = SLICE_BYTES):
    """A function for ``mapInArrow`` that gives ``work`` one slice after the other."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, column, size=size):
                yield work(part)
        give_back()
    return run


def give_back() -> None:
    """Return unused memory to the system: a worker lives on between stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim:
        trim(0)


def mapped(df: DataFrame, function, schema) -> DataFrame:
    """``df.mapInArrow`` with batches of a few megabytes: of these the JVM and the worker hold several at a time."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(function, schema)


def with_columns(part: pa.RecordBatch, **columns) -> pa.RecordBatch:
    """The slice with columns added, or replaced where the name is there already."""
    names = [n for n in part.schema.names if n not in columns]
    return pa.RecordBatch.from_arrays([*[part.column(n) for n in names], *columns.values()], names=[*names, *columns])


def texts_of(part: pa.RecordBatch, column: str) -> pa.Array:
    """The texts of a slice; a null text counts as empty."""
    return pc.fill_null(part.column(column).cast(pa.string()), "")


def split(texts: pa.Array, separator: str, regex: bool = False) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct pieces, number of the distinct piece at every place, first place of each text and the end)."""
    lists = pc.split_pattern_regex(texts, separator) if regex else pc.split_pattern(texts, separator)
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return coded.dictionary, coded.indices.to_numpy(zero_copy_only=False), offsets - offsets[0]


def without_empty(values: pa.Array, codes: np.ndarray, starts: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The same without empty pieces."""
    keep = (pc.binary_length(values).to_numpy(zero_copy_only=False) > 0)[codes] if len(codes) else np.zeros(0, bool)
    count = np.concatenate([[0], np.cumsum(keep)])
    return values, codes[keep], count[starts]


def gather(data: np.ndarray, offsets: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs ``data[offsets[c]:offsets[c + 1]]`` of all codes, one after the other, and where each begins and the last ends."""
    lengths = np.diff(offsets)[codes]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    index = np.arange(ends[-1]) + np.repeat(offsets[codes] - ends[:-1], lengths)
    return data[index], ends


def run_sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sum of every run of ``values``; an empty run gives 0. Exact to the order within a run, whatever else is in the slice."""
    out = np.zeros((len(starts) - 1, *values.shape[1:]), dtype=np.float64)
    full = np.flatnonzero(np.diff(starts) > 0)
    if len(full):
        out[full] = np.add.reduceat(values, starts[:-1][full], axis=0)
    return out


def points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts one after the other, and where each text begins and the last ends."""
    strings = texts.to_pylist()
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return flat, np.concatenate([[0], np.cumsum([len(s) for s in strings], dtype=np.int64)]).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bit mixing of 64-bit numbers (the public splitmix64 finaliser)."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def gram_hashes(symbols: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all runs of n symbols that lie in one text, and where those of each text begin and the last end."""
    lengths = np.maximum(np.diff(starts) - (n - 1), 0)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    first = np.arange(ends[-1]) + np.repeat(starts[:-1] - ends[:-1], lengths)
    symbols = symbols.astype(np.uint64)
    h = np.full(len(first), n, dtype=np.uint64)
    for k in range(n):
        h = h * np.uint64(0x9E3779B97F4A7C15) + symbols[first + k]
    return mixed(h), ends


def binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Byte runs as an Arrow binary column; ``ends`` counts items of ``data``."""
    raw = np.ascontiguousarray(data)
    at = (ends * raw.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(at.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())


def from_binary(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """An Arrow binary column as one flat array, and where each row begins and the last ends."""
    column = pc.fill_null(column, b"").cast(pa.large_binary())
    at = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset: column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0]: at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), dtype=dtype), (at - at[0]) // np.dtype(dtype).itemsize


def rolling(symbols: np.ndarray, starts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of the n symbols from every place on, and whether they all lie in one text (else the hash says nothing)."""
    size = len(symbols)
    h, valid = np.full(size, n, dtype=np.uint64), np.ones(size, dtype=bool)
    wide = symbols.astype(np.uint64)
    for k in range(n):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h[: size - k] += wide[k:]
    for k in range(1, n):  # the last n - 1 places of each text
        ends = starts[1:] - k
        valid[ends[ends >= starts[:-1]]] = False
    return mixed(h), valid


def encoded(model, strings: list[str], step: int = 2000) -> list[list[int]]:
    """Ids of strings by a model of the tokenizers library; its large results live for ``step`` strings at a time."""
    return [e.ids for a in range(0, len(strings), step)
            for e in model.encode_batch_fast(strings[a: a + step], add_special_tokens=False)]


class Pieces:
    """Ids of distinct strings: those seen first stay in flat arrays, ``limit`` of them at most; others are encoded anew."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int):
        self.encode, self.limit = encode, limit
        self.values, self.ids, self.offsets = pa.array([], pa.string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def of(self, values: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, entry of each value): the ids of entry e are ``ids[offsets[e]:offsets[e + 1]]``."""
        entry = pc.index_in(values, value_set=self.values)
        new = pc.is_null(entry)
        fresh = values.filter(new)
        lists = self.encode(fresh.to_pylist())
        ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(lists), dtype=np.uint32)])
        offsets = np.concatenate([self.offsets, self.offsets[-1] + np.cumsum([len(x) for x in lists], dtype=np.int64)])
        at = np.empty(len(values), dtype=np.int64)
        missing = new.to_numpy(zero_copy_only=False)
        at[~missing] = entry.drop_null().to_numpy(zero_copy_only=False)
        at[missing] = len(self.values) + np.arange(len(fresh))
        if len(self.values) < self.limit:
            self.values, self.ids, self.offsets = pa.concat_arrays([self.values, fresh]), ids, offsets
        return ids, offsets, at
