"""Quality of whole texts without labels: weak labellers, expectation-maximisation, and a hashed linear scorer.

Nine heuristic labellers overlap: each votes bad, votes good, or stays silent on a text. The counts of their vote patterns
over all texts (``2 ** 9`` rows at most) go to the driver, where expectation-maximisation estimates how often each labeller
speaks on good and on bad texts, hence its accuracy, and gives every pattern the posterior that a text is good. A seeded
sample of ``PER_CLASS`` distinct texts a side at most, weighed by their copies, with posteriors as soft labels, trains a linear scorer over hashed
character-class trigrams and word echoes; the scorer, not the pattern, decides on every text.

Null and empty texts hold nothing to judge: score 0.5, which is kept (rejected is a score below ``THRESHOLD``). If the
votes leave one class only, the scorer falls back to the posterior of the pattern. Repeated rows get the same score.
Added columns replace columns of their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.batches import points, rolling, run_sums, mapped, sliced, split, texts_of, with_columns, without_empty
from folioframe.session import cut_lineage

LABELLERS = ("shouting", "tails", "symbols", "bars", "echoes", "narrow", "prose", "sentences", "variety")
_GOOD = np.array([n in ("prose", "sentences", "variety") for n in LABELLERS])
BUCKETS, PER_CLASS, THRESHOLD, SLICE = 1 << 11, 3000, 0.3, 1 << 19
_ORDINARY = ".,;:'\"-?!()’“”"


def _classes() -> np.ndarray:
    """For every code point: 0 blank, 1 small letter, 2 capital, 3 digit, 4 ordinary mark, 5 any other sign."""
    out = np.full(0x110000, 5, dtype=np.uint8)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            out[c] = 2 if s.isupper() else 1
        elif s.isdigit():
            out[c] = 3
        elif s.isspace():
            out[c] = 0
    out[[ord(c) for c in _ORDINARY]] = 4
    return out


_TABLE: list[np.ndarray] = []


def classes(flat: np.ndarray) -> np.ndarray:
    if not _TABLE:
        _TABLE.append(_classes())
    return _TABLE[0][flat]


@dataclass
class Sheet:
    """What is measured of a slice of texts."""

    flat: np.ndarray
    starts: np.ndarray
    kind: np.ndarray
    codes: np.ndarray
    word_starts: np.ndarray
    echo: np.ndarray
    fresh: np.ndarray
    tail: np.ndarray
    bare: np.ndarray
    closing: np.ndarray


def read(texts: pa.Array) -> Sheet:
    flat, starts = points(texts)
    kind = classes(flat)
    values, codes, word_starts = without_empty(*split(texts, r"\s+", regex=True))
    letters, at = points(values)
    sort = classes(letters)
    last = at[1:] - 1
    sign = np.where(sort >= 4, 1, 0)
    full = np.diff(at) > 0
    count = run_sums(sign, at)
    ends = np.where(full, sort[np.minimum(last, max(len(sort) - 1, 0))] if len(sort) else 0, 0)
    before = np.where(np.diff(at) > 1, sort[np.maximum(last - 1, 0)] if len(sort) else 0, 0)
    tail = full & (ends >= 4) & (before >= 4)
    bare = full & (count == np.diff(at))
    closing = full & (ends == 4) & ~tail
    echo = np.zeros(len(codes), dtype=np.int64)
    echo[1:] = codes[1:] == codes[:-1]
    owner = np.repeat(np.arange(len(word_starts) - 1), np.diff(word_starts))
    echo[word_starts[:-1][np.diff(word_starts) > 0]] = 0
    _, first = np.unique(owner * max(len(values), 1) + codes, return_index=True)
    fresh = np.zeros(len(codes), dtype=np.int64)
    fresh[first] = 1
    return Sheet(flat, starts, kind, codes, word_starts, echo, fresh, tail[codes], bare[codes], closing[codes])


def votes(s: Sheet) -> np.ndarray:
    """One bit a labeller: whether it speaks."""
    chars, n_words = np.maximum(np.diff(s.starts), 1), np.diff(s.word_starts)
    of_words = lambda x: run_sums(x.astype(np.int64), s.word_starts) / np.maximum(n_words, 1)
    of_chars = lambda x: run_sums(x.astype(np.int64), s.starts)
    upper, lower, signs = of_chars(s.kind == 2), of_chars(s.kind == 1), of_chars(s.kind == 5)
    letters = upper + lower
    shout, echo, fresh = upper / np.maximum(letters, 1), of_words(s.echo), of_words(s.fresh)
    tail, bare, closing = of_words(s.tail), of_words(s.bare), of_words(s.closing)
    some = n_words > 0
    speak = np.stack([
        some & (shout > 0.5) & (letters >= 10), some & (tail > 0.25), some & (signs / chars > 0.08), some & (bare > 0.2),
        some & (echo > 0.25), (n_words >= 20) & (fresh < 0.2), some & (letters / chars > 0.7) & (shout < 0.2) & (signs / chars < 0.03),
        some & (closing > 0.01) & (closing < 0.4) & (tail < 0.1) & (bare < 0.1), some & (echo < 0.05) & ((fresh > 0.25) | (n_words < 50)),
    ], axis=1)
    return speak.astype(np.int64) @ (1 << np.arange(len(LABELLERS)))


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """Expectation-maximisation over vote patterns: rates at which labellers speak on bad and on good texts (rows 0 and 1),
    the accuracy of each labeller when it speaks, and the share of good texts."""
    speak = (patterns[:, None] >> np.arange(len(LABELLERS))) & 1
    rates = np.where(_GOOD, [[0.2], [0.8]], [[0.3], [0.03]]).astype(float)
    good = 0.8
    for _ in range(rounds):
        p = posterior(speak, rates, good)
        weights = np.stack([counts * (1 - p), counts * p])
        rates = (weights @ speak + [[1.0]]) / (weights.sum(axis=1, keepdims=True) + 2.0)
        good = float((weights[1].sum() + 4) / (counts.sum() + 5))
    said = np.stack([(1 - good) * rates[0], good * rates[1]])
    return rates, np.where(_GOOD, said[1], said[0]) / said.sum(axis=0), good


def posterior(speak: np.ndarray, rates: np.ndarray, good: float) -> np.ndarray:
    logs = speak @ np.log(rates).T + (1 - speak) @ np.log(1 - rates).T + np.log([1 - good, good])
    return 1 / (1 + np.exp(np.clip(logs[:, 0] - logs[:, 1], -500, 500)))


def features(s: Sheet) -> tuple[list[tuple[np.ndarray, np.ndarray]], int]:
    """Hashed features as (bucket of every place, where the places of each text begin and the last end), and their number."""
    symbols = np.where(s.kind >= 4, s.flat.astype(np.int64) + 16, s.kind)
    h, valid = rolling(symbols, s.starts, 3)
    grams = np.where(valid, (h >> np.uint64(40)).astype(np.int64) % (BUCKETS - 64), BUCKETS)
    state = s.echo + 2 * (1 - s.fresh) + 4 * s.tail + 8 * s.bare
    return [(grams, s.starts), (BUCKETS - 64 + state, s.word_starts)], BUCKETS


@dataclass
class Model:
    weights: np.ndarray | None = None
    bias: float = 0.0
    rates: np.ndarray | None = None
    accuracy: dict = field(default_factory=dict)
    good: float = 0.5


def train(df: DataFrame, text: str = "text", per_class: int = PER_CLASS) -> Model:
    def vote(part):
        return pa.RecordBatch.from_arrays([pa.array(votes(read(texts_of(part, text)))), part.column("_h")], names=["pattern", "_h"])

    # The hash stands for the text: it brings copies together, picks the sample and finds its texts again.
    hashed = df.select(text).where(F.coalesce(text, F.lit("")) != "").withColumn("_h", F.xxhash64(F.lit("quality"), text))
    voted = mapped(hashed, sliced(text, vote, size=SLICE), "pattern bigint, _h bigint")
    distinct = cut_lineage(voted.groupBy("pattern", "_h").agg(F.count("*").alias("n")))
    rows = distinct.groupBy("pattern").agg(F.sum("n").alias("n")).toArrow()
    if not rows.num_rows:
        return Model()
    patterns, counts = rows.column("pattern").to_numpy(), rows.column("n").to_numpy().astype(float)
    rates, accuracy, good = estimate(patterns, counts)
    model = Model(None, 0.0, rates, dict(zip(LABELLERS, accuracy.round(6).tolist())), good)
    belief = lambda found: posterior((found[:, None] >> np.arange(len(LABELLERS))) & 1, rates, good)
    poor = F.col("pattern").isin(patterns[belief(patterns) < 0.5].tolist())
    picks = [draw(distinct.where(side), per_class) for side in (poor, ~poor)]
    h, pattern, n = (np.concatenate(x) for x in zip(*picks))

    def once(batches):
        seen = set()
        for batch in batches:
            keep = []
            for x in batch.column("_h").to_pylist():
                keep.append(x not in seen)
                seen.add(x)
            yield batch.filter(pa.array(keep, pa.bool_()))

    wanted = df.sparkSession.createDataFrame([(x,) for x in h.tolist()], "_h bigint")
    # A task sends on one copy of a text at most, so that what meets under a hash is one row a task.
    found = mapped(hashed.join(F.broadcast(wanted), "_h", "left_semi").select(F.col(text).alias("text"), "_h"), once, "text string, _h bigint")
    texts = found.groupBy("_h").agg(F.first("text").alias("text")).toArrow()
    order = np.argsort(h)
    at = order[np.searchsorted(h, texts.column("_h").to_numpy(), sorter=order)]
    texts = texts.column("text").combine_chunks().take(pa.array(np.argsort(at)))
    at = np.sort(at)  # whatever order the rows came in
    return _fit(model, texts, belief(pattern[at]), n[at])


def draw(distinct: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, patterns and weights of a sample of ``size`` distinct texts at most, from (pattern, _h, n).

    Priority sampling: texts with the highest n / u stay, u a uniform number that the hash gives, and each weighs n or the
    priority of the first one left out, whichever is more, so that sums over the sample estimate sums over all rows. If all
    texts fit, each weighs its number of copies. The mean weight is scaled to 1.
    """
    u = (F.shiftrightunsigned("_h", 11) + 0.5) / float(1 << 53)
    rows = distinct.withColumn("_priority", F.col("n") / u).orderBy(F.col("_priority").desc(), "_h").limit(size + 1).toArrow()
    h, pattern, n, priority = (rows.column(c).to_numpy() for c in ("_h", "pattern", "n", "_priority"))
    order = np.lexsort((h, -priority))
    weight = np.maximum(n[order[:size]].astype(float), priority[order[size]] if len(h) > size else 0.0)
    return h[order[:size]], pattern[order[:size]], weight / max(weight.mean(), 1e-300) if len(weight) else weight


def _fit(model: Model, texts: pa.Array, p: np.ndarray, n: np.ndarray) -> Model:
    """Logistic regression with soft labels on relative frequencies, each feature divided by its spread; a text counts ``n``-fold."""
    if not len(p) or (p < 0.5).all() or (p >= 0.5).all():
        return model
    x = np.zeros((len(p), BUCKETS), dtype=np.float32)
    for a in range(0, len(p), 500):
        groups, _ = features(read(texts.slice(a, 500)))
        for buckets, starts in groups:
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
            used = buckets < BUCKETS
            counts = np.bincount(owner[used] * BUCKETS + buckets[used], minlength=(len(starts) - 1) * BUCKETS).reshape(-1, BUCKETS)
            x[a: a + len(counts)] += counts / np.maximum(np.diff(starts), 1)[:, None]
    part = (n / n.sum()).astype(np.float32)
    scale = np.sqrt(part @ np.square(x - part @ x)) + np.float32(1e-4)
    x /= scale
    z = np.sqrt(x, out=x)
    mean = part @ z
    weight = part * np.where(p < 0.5, 0.5 / part[p < 0.5].sum(), 0.5 / part[p >= 0.5].sum())
    w, b, past, past_b = np.zeros(BUCKETS), 0.0, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(300):
        error = weight * (1 / (1 + np.exp(-np.clip(z @ w.astype(np.float32) - mean @ w + b, -30, 30))) - p)
        g, gb = error.astype(np.float32) @ z - error.sum() * mean + 1e-3 * w, error.sum()
        past, past_b = past + g * g, past_b + gb * gb
        w, b = w - 0.1 * g / np.sqrt(past), b - 0.1 * gb / np.sqrt(past_b)
    w = w.astype(np.float64)
    model.weights, model.bias = np.stack([w, 1 / scale]), float(b - mean @ w)
    return model


def rate(texts: pa.Array, model: Model) -> np.ndarray:
    """Probability that each text is good."""
    s = read(texts)
    if model.rates is None:
        return np.full(len(texts), 0.5)
    if model.weights is None:
        p = posterior((votes(s)[:, None] >> np.arange(len(LABELLERS))) & 1, model.rates, model.good)
    else:
        logit = np.full(len(texts), model.bias)
        for buckets, starts in features(s)[0]:
            used = buckets < BUCKETS
            owner = np.repeat(np.arange(len(starts) - 1), np.diff(starts))[used]
            key, n = np.unique(owner * BUCKETS + buckets[used], return_counts=True)
            doc, bucket = key // BUCKETS, key % BUCKETS
            share = n / np.diff(starts)[doc]
            logit += np.bincount(doc, np.sqrt(share * model.weights[1][bucket]) * model.weights[0][bucket], minlength=len(texts))
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    return np.where(np.diff(s.word_starts) > 0, np.round(p, 9), 0.5)


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is good."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(part):
        return with_columns(part, **{out: pa.array(rate(texts_of(part, text), sent.value))})

    kept = df.drop(out)
    return mapped(kept, sliced(text, work, size=SLICE), T.StructType([*kept.schema, T.StructField(out, T.DoubleType())]))
