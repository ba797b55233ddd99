"""Fill-in-the-middle rewriting by block rotation: prefix, middle and suffix of a text change places inside one bytearray.

A text is scanned for its units (white space and the word after it, or white space at the end); two hashed numbers choose the
units after which prefix and middle end. The three sentinels go into the buffer where the segments begin, and a rotation
(three reversals in place) exchanges neighbours: middle and suffix for the form ``psm``, all that is before the suffix and
the suffix for ``spm``. Restoring finds the sentinels, turns the same segments back and takes the sentinels out.

A text that is null, empty or holds a sentinel stays as it is (form ``plain``); so does the share that the hash leaves out.
A null key hashes as an empty one; rows of one key get the same draws, repeated rows the same result. A very long text is a
slice of its own. An empty table gives an empty one. Columns of the given names are replaced, all others are passed on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.batches import binary, from_binary, mapped, sliced, texts_of, with_columns

# The sentinels before prefix, middle and suffix, all of one length.
PREFIX, MIDDLE, SUFFIX = b"<P>", b"<M>", b"<S>"
MARK = len(PREFIX)
BLANK = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
SEED, RATE, SPM = 42, 50, 80


def draws(key: Column, seed: int) -> Column:
    """Four unsigned numbers of 32 bits from the hash of seed and key."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def reverse(buffer: bytearray, start: int, stop: int) -> None:
    buffer[start:stop] = buffer[start:stop][::-1]


def rotate(buffer: bytearray, start: int, middle: int, stop: int) -> None:
    """Exchange ``buffer[start:middle]`` and ``buffer[middle:stop]`` in place."""
    reverse(buffer, start, middle)
    reverse(buffer, middle, stop)
    reverse(buffer, start, stop)


def arranged(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text with sentinels, cut at two byte places, in the order of ``form``."""
    buffer = bytearray(text)
    for at, mark in ((second, SUFFIX), (first, MIDDLE), (0, PREFIX)):  # from behind, so that places before stay true
        buffer[at:at] = mark
    rotate(buffer, first + MARK if form == "psm" else 0, second + 2 * MARK, len(buffer))
    return buffer


def restored(output: bytes, form: str) -> bytes:
    """The text that ``arranged`` was given."""
    if form == "plain":
        return output
    buffer = bytearray(output)
    prefix, middle, suffix = (buffer.find(mark) for mark in (PREFIX, MIDDLE, SUFFIX))
    size = len(buffer)
    if form == "psm":
        rotate(buffer, suffix, middle, size)
        middle, suffix = suffix, suffix + size - middle
    else:
        rotate(buffer, 0, prefix, size)
        middle, suffix = middle - prefix, size - prefix
    for at in (suffix, middle, 0):
        del buffer[at: at + MARK]
    return bytes(buffer)


def units(flat: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of the units of all texts, and the number of those before each text and in all."""
    ends = np.zeros(len(flat), dtype=bool)
    blank = BLANK[flat]
    ends[:-1] = ~blank[:-1] & blank[1:]
    ends[starts[1:][np.diff(starts) > 0] - 1] = True
    found = np.flatnonzero(ends) + 1
    return found, np.searchsorted(found, starts, side="right")


def rewrite(df: DataFrame, key: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE, spm: int = SPM,
            output: str = "output") -> DataFrame:
    """Add ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars`` and the rewritten text: of ``rate`` in a hundred texts,
    ``spm`` in a hundred of these in the form of that name."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = from_binary(texts_of(part, text).cast(pa.binary()), np.uint8)
        ends, before = units(flat, starts)
        count = np.diff(before)
        drawn = part.column("_draws").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 4)
        cuts = np.sort(drawn[:, :2] % (count + 1)[:, None], axis=1)
        place = np.concatenate([[0], ends])
        at = np.where(cuts == 0, starts[:-1, None], place[before[:-1, None] + cuts])
        points = np.concatenate([[0], np.cumsum((flat & 0xC0) != 0x80)])
        chosen = (drawn[:, 2] % 100 < rate) & (np.diff(starts) > 0)
        forms, pieces = [], []
        for i in range(part.num_rows):
            whole = flat[starts[i]: starts[i + 1]].tobytes()
            form = "plain"
            if chosen[i] and not any(mark in whole for mark in (PREFIX, MIDDLE, SUFFIX)):
                form = "spm" if drawn[i, 3] % 100 < spm else "psm"
                whole = arranged(whole, int(at[i, 0] - starts[i]), int(at[i, 1] - starts[i]), form)
            forms.append(form)
            pieces.append(bytes(whole))
        plain = np.array(forms, dtype=object) == "plain"
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
        texts = binary(np.frombuffer(b"".join(pieces), np.uint8), sizes).cast(pa.string())
        first, second = points[at[:, 0]], points[at[:, 1]]
        kept = part.drop_columns(["_draws"])
        return with_columns(kept, n=pa.array(count, pa.int64()), form=pa.array(forms, pa.string()),
                            prefix_chars=pa.array(first - points[starts[:-1]], pa.int64(), mask=plain),
                            middle_chars=pa.array(second - first, pa.int64(), mask=plain), **{output: texts})

    added = [("n", T.LongType()), ("form", T.StringType()), ("prefix_chars", T.LongType()), ("middle_chars", T.LongType()),
             (output, T.StringType())]
    return mapped(df.withColumn("_draws", draws(F.col(key), seed)), sliced(text, work), _schema(df, added))


def restore(df: DataFrame, output: str = "output", form: str = "form", text: str = "restored") -> DataFrame:
    """Add the text that ``rewrite`` was given (empty for null), from output and form alone."""
    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        flat, starts = from_binary(texts_of(part, output).cast(pa.binary()), np.uint8)
        pieces = [restored(flat[a:b].tobytes(), f) for a, b, f in zip(starts, starts[1:], part.column(form).to_pylist())]
        sizes = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
        return with_columns(part, **{text: binary(np.frombuffer(b"".join(pieces), np.uint8), sizes).cast(pa.string())})

    return mapped(df, sliced(output, work), _schema(df, [(text, T.StringType())]))


def _schema(df: DataFrame, added: list[tuple[str, T.DataType]]) -> T.StructType:
    names = {name for name, _ in added}
    return T.StructType([f for f in df.schema if f.name not in names] + [T.StructField(*a) for a in added])
