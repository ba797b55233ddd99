"""Language of whole texts: multinomial naive Bayes over hashed character n-grams.

Counts of a bounded, seeded sample of labelled rows (``PER_LANG`` a language at most) become a matrix of log probabilities,
one row a bucket and one column a language, which is broadcast: ``BUCKETS`` x languages x 8 bytes. Tasks look up the rows of
all n-grams of a slice of texts and add them up per text.

A null text, or one without letters, gets ``und`` and the score 0. Ties go to the language that sorts first. Repeated rows
get the same result each. With no labelled row every text gets ``und``. Added columns replace columns of their names.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from folioframe.llm.batches import points, rolling, run_sums, mapped, sliced, texts_of, with_columns

BUCKETS, ORDERS, PER_LANG, SLICE = 1 << 16, (1, 2, 3), 1500, 1 << 20


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point itself if it is a letter, else a blank."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], dtype=np.uint32)


def symbols(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters, with one blank for all else between them and one at each end of a text."""
    flat, starts = points(pa.array([f" {t.lower()} " for t in texts.to_pylist()], pa.string()))
    flat = _letters()[flat]
    keep = np.ones(len(flat), dtype=bool)
    keep[1:] = (flat[1:] != 32) | (flat[:-1] != 32)
    keep[starts[:-1]] = True
    return flat[keep], np.concatenate([[0], np.cumsum(keep)])[starts]


def features(flat: np.ndarray, starts: np.ndarray):
    """Buckets of all n-grams, an array for each order; ``BUCKETS`` stands for none."""
    for n in ORDERS:
        h, valid = rolling(flat, starts, n)
        yield np.where(valid, (h >> np.uint64(48)).astype(np.int64) % BUCKETS, BUCKETS)


def sample(df: DataFrame, label: str, key: Column, n: int) -> DataFrame:
    """Rows with a label, n of each label at most: one for each of the keys whose seeded hash is smallest, the least of its rows.

    Only the cut of each label, a row a label, is joined back; rows of one key meet after they have been reduced to one a task.
    """
    rows = df.where(F.col(label).isNotNull()).withColumn("_h", F.xxhash64(F.lit("sample"), key))
    rank = F.row_number().over(Window.partitionBy(label).orderBy("_h"))
    cuts = (rows.select(label, "_h").distinct().withColumn("_r", rank).where(F.col("_r") <= n)
            .groupBy(label).agg(F.max("_h").alias("_cut")))
    return (rows.join(F.broadcast(cuts), label).where(F.col("_h") <= F.col("_cut"))
            .groupBy(label, "_h").agg(F.min(F.struct(*df.columns)).alias("_row")).select("_row.*"))


def train(rows: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id",
          per_lang: int = PER_LANG) -> tuple[list[str], np.ndarray]:
    """Languages in ascending order and their log probabilities (``BUCKETS`` + 1 rows: the last one is for no n-gram)."""
    def count(part):
        texts, names = texts_of(part, text), part.column(lang).to_pylist()
        flat, starts = symbols(texts)
        of = np.repeat(np.array(names, dtype=object), np.diff(starts))
        out: dict[str, list] = {"lang": [], "bucket": [], "n": []}
        found = list(features(flat, starts))
        for name in sorted(set(names)):
            counts = sum(np.bincount(f[of == name], minlength=BUCKETS + 1) for f in found)[:BUCKETS]
            used = np.flatnonzero(counts)
            out["lang"] += [name] * len(used)
            out["bucket"] += used.tolist()
            out["n"] += counts[used].tolist()
        return pa.RecordBatch.from_pydict(out, pa.schema({"lang": pa.string(), "bucket": pa.int32(), "n": pa.int64()}))

    chosen = sample(rows.select(F.col(key).alias("_key"), F.col(text).alias(text), F.col(lang).cast("string").alias(lang)),
                    lang, F.col("_key").cast("string"), per_lang)
    counts = (mapped(chosen.select(text, lang), sliced(text, count, size=SLICE), "lang string, bucket int, n bigint")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow())
    names = sorted(set(counts.column("lang").to_pylist()))
    table = np.zeros((BUCKETS, len(names)))
    where = np.searchsorted(names, counts.column("lang").to_pylist()) if names else []
    table[counts.column("bucket").to_numpy(), where] = counts.column("n").to_numpy()
    logs = np.log(table + 0.5) - np.log((table + 0.5).sum(axis=0)) if names else table
    return names, np.vstack([logs, np.zeros((1, len(names)))])


def predict(df: DataFrame, names: list[str], logs: np.ndarray, text: str = "text", out: str = "lang_pred",
            score: str = "score") -> DataFrame:
    """Add the likeliest language and its probability among the learned ones."""
    sent = df.sparkSession.sparkContext.broadcast((names, logs))

    def work(part):
        langs, table = sent.value
        flat, starts = symbols(texts_of(part, text))
        rows = len(starts) - 1
        letters = np.add.reduceat((flat != 32).astype(np.int64), starts[:-1]) if rows else np.zeros(0)
        total = np.zeros((rows, len(langs)))
        if langs:
            for f in features(flat, starts):
                for k in range(len(langs)):
                    total[:, k] += run_sums(np.ascontiguousarray(table[:, k])[f], starts)
            best = total.argmax(axis=1)
            likely = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            none = letters == 0
            pred = [None if n else langs[b] for b, n in zip(best, none)]
            likely[none] = 0
        else:
            pred, likely = [None] * rows, np.zeros(rows)
        return with_columns(part, **{out: pa.array([p or "und" for p in pred], pa.string()), score: pa.array(np.round(likely, 12))})

    kept = df.drop(out, score)
    return mapped(kept, sliced(text, work, size=SLICE),
                           T.StructType([*kept.schema, T.StructField(out, T.StringType()), T.StructField(score, T.DoubleType())]))
