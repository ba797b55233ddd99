"""Toxicity of whole texts: bags of subword embeddings, averaged, into a linear softmax; all parts trained jointly in numpy.

A word is the average of the vectors of its hashed character n-grams, with its edges marked, so a misspelling that was never
seen shares most vectors of its word. A text is read in windows of ``WINDOW`` words, which overlap by all but one; each window
averages its words, and the likeliest window gives the score of the text. A label says only that some window is toxic, so
training repeats: take the likeliest windows of every text, learn them with the text's label, score again. One part of the
sampled texts stays out of this and fits the curve that turns the best window's logit into a probability.

The sample holds ``PER_CLASS`` labelled rows of each class at most, chosen by a seeded hash.
Null and empty texts get the probability of a window without words. Without labels of both classes every score is 0.
Repeated rows get the same score. Added columns replace columns of their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from folioframe.llm.batches import give_back, points, rolling, run_sums, mapped, sliced, split, texts_of, with_columns, without_empty
from folioframe.llm.language import sample

BUCKETS, DIM, GRAMS, WINDOW = 1 << 17, 8, (3, 4, 5), 4
PER_CLASS, ROUNDS, BATCH, STEPS, RATE, SEED = 2500, 10, 256, 60, 0.15, 7
THRESHOLD = 0.7
_WORD_BREAK = r"[^\p{L}\p{N}]+"


@dataclass
class Model:
    weights: np.ndarray | None  # of each bucket: its share in the logit of a word
    bias: float = 0.0
    slope: float = 1.0
    shift: float = 0.0


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    return without_empty(*split(pc.utf8_lower(texts), _WORD_BREAK, regex=True))


def subwords(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, and where those of each word begin and the last end; never none."""
    flat, starts = points(pc.binary_join_element_wise("<", values, ">", ""))
    size = len(starts) - 1
    owner = np.repeat(np.arange(size, dtype=np.int32), np.diff(starts))
    short = np.diff(starts) < GRAMS[0]  # a word of no letters cannot be; one of edges only can
    counts = [np.bincount(owner[rolling(flat, starts, n)[1]], minlength=size) for n in GRAMS]
    ends = np.concatenate([[0], np.cumsum(sum(counts) + short)])
    out, place = np.zeros(ends[-1], dtype=np.int32), ends[:-1].copy()
    for n, count in zip(GRAMS, counts):  # each length is written straight to its place in its word
        h, valid = rolling(flat, starts, n)
        at = np.repeat(place - (np.cumsum(count) - count), count) + np.arange(count.sum())
        out[at] = (h[valid] >> np.uint64(40)).astype(np.int64) % BUCKETS
        place += count
    return out, ends


def window_means(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean of every window of ``WINDOW`` words (of all words, in a shorter text), and where those of each text begin and end."""
    lengths = np.diff(starts)
    count = np.where(lengths > 0, np.maximum(lengths - WINDOW + 1, 1), 0)
    ends = np.concatenate([[0], np.cumsum(count)])
    first = np.arange(ends[-1]) + np.repeat(starts[:-1] - ends[:-1], count)
    width = np.repeat(np.minimum(lengths, WINDOW), count)
    total = np.zeros(len(first))
    for k in range(WINDOW):
        inside = k < width
        total[inside] += values[first[inside] + k]
    return total / np.maximum(width, 1), ends


def best_windows(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    means, ends = window_means(values, starts)
    out, full = np.zeros(len(starts) - 1), np.flatnonzero(np.diff(ends) > 0)
    if len(full):
        out[full] = np.maximum.reduceat(means, ends[:-1][full])
    return out


def text_parts(starts: np.ndarray, size: int = 256):
    """First and last text of each part, and its words: the driver holds the windows of one part at a time."""
    for a in range(0, len(starts) - 1, size):
        b = min(a + size, len(starts) - 1)
        yield a, b, slice(starts[a], starts[b])


def train(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", per_class: int = PER_CLASS) -> Model:
    """Learn from texts and ``labels`` (``key``, ``label`` 0 or 1); the sample, of bounded size, is learned in the driver."""
    rated = labels.where(F.col("label").isin(0, 1)).select(key, F.col("label").cast("int").alias("label"))
    chosen = sample(rated, "label", F.col(key).cast("string"), per_class)  # two classes: 2 x per_class short rows, so broadcast
    # A repeated key stands for one text, the least; copies are reduced in the tasks.
    rows = (docs.select(key, F.coalesce(text, F.lit("")).alias("text")).join(F.broadcast(chosen), key)
            .groupBy(key, "label").agg(F.min("text").alias("text")).select("text", "label").toArrow())
    return fit(rows.column("text").combine_chunks(), rows.column("label").to_numpy())


def fit(texts: pa.Array, y: np.ndarray) -> Model:
    if len(set(y.tolist())) < 2:
        return Model(None)
    order = np.argsort(pc.binary_join_element_wise(texts.cast(pa.string()), pa.array(y.astype(str)), " ").to_numpy(zero_copy_only=False), kind="stable")
    texts, y = texts.take(pa.array(order)), y[order]  # whatever order the rows came in
    values, codes, starts = words(texts)
    codes = codes.astype(np.int32)
    grams, gram_ends = subwords(values)
    del texts, values
    give_back()
    rng = np.random.default_rng(SEED)
    apart = rng.random(len(y)) < 0.2
    embed = rng.uniform(-0.01, 0.01, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.uniform(-1, 1, (DIM, 2)).astype(np.float32), np.zeros(2, dtype=np.float32)
    state = {id(a): np.full(a.shape, 1e-8, dtype=np.float32) for a in (embed, out, bias)}
    cost = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9)).astype(np.float32)
    usable = np.flatnonzero(~apart & (np.diff(starts) > 0))
    lengths = np.diff(starts)

    def word_logits() -> np.ndarray:
        share = embed @ (out[:, 1] - out[:, 0])
        return run_sums(share[grams], gram_ends) / np.maximum(np.diff(gram_ends), 1)

    for step in range(ROUNDS):
        if step == 0:  # anywhere in the text
            doc = np.repeat(usable, max(4, 24_000 // max(len(usable), 1)))
            begin = starts[doc] + (rng.random(len(doc)) * np.maximum(lengths[doc] - WINDOW + 1, 1)).astype(np.int64)
        else:  # the likeliest window of every text, and one anywhere in the texts of class 0
            logits, best = word_logits(), np.zeros(len(lengths), dtype=np.int64)
            for a, b, held in text_parts(starts):
                means, ends = window_means(logits[codes[held]], starts[a: b + 1] - starts[a])
                best[a:b] = [int(means[x:y].argmax()) if y > x else 0 for x, y in zip(ends, ends[1:])]
            top = starts[usable] + best[usable]
            clean = usable[y[usable] == 0]
            doc = np.concatenate([usable, clean])
            begin = np.concatenate([top, starts[clean] + (rng.random(len(clean)) * np.maximum(lengths[clean] - WINDOW + 1, 1)).astype(np.int64)])
        for _ in range(max(1, -(-STEPS * BATCH // max(len(doc), 1)))):
            shuffled = rng.permutation(len(doc))
            for a in range(0, len(shuffled), BATCH):
                at = shuffled[a: a + BATCH]
                bag, back, parts = _gradients(embed, out, bias, codes, grams, gram_ends, begin[at],
                                              np.minimum(lengths[doc[at]], WINDOW), y[doc[at]], cost[doc[at]])
                _descend(out, bag[0], state)
                _descend(bias, bag[1], state)
                rows, inverse = np.unique(parts[0], return_inverse=True)
                gradient = np.zeros((len(rows), DIM), dtype=np.float32)
                np.add.at(gradient, inverse, parts[1][:, None] * back)
                _descend(embed, gradient, state, rows)
    of_words = word_logits()
    logits = np.concatenate([best_windows(of_words[codes[held]], starts[a: b + 1] - starts[a]) for a, b, held in text_parts(starts)]) + bias[1] - bias[0]
    use = apart if len(set(y[apart].tolist())) == 2 else ~apart
    slope, shift = _curve(logits[use], y[use])
    return Model((embed @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0]), slope, shift)


def _gradients(embed, out, bias, codes, grams, gram_ends, begin, width, y, cost):
    """Gradients of the mean loss of a batch of windows: of the softmax, and of every n-gram's vector (bucket and weight)."""
    owner = np.repeat(np.arange(len(begin)), width)
    word = codes[begin[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(width) - width, width)]
    count = gram_ends[word + 1] - gram_ends[word]
    ends = np.cumsum(count)
    index = grams[np.arange(ends[-1]) + np.repeat(gram_ends[word] - (ends - count), count)]
    weight = np.repeat(1.0 / (count * width[owner]), count).astype(np.float32)
    bag = np.repeat(owner, count)
    first = np.concatenate([[0], np.cumsum(np.bincount(bag, minlength=len(begin)))[:-1]])
    hidden = np.add.reduceat(embed[index] * weight[:, None], first, axis=0)
    scores = hidden @ out + bias
    p = np.exp(scores - scores.max(axis=1, keepdims=True))
    p /= p.sum(axis=1, keepdims=True)
    p[np.arange(len(y)), y] -= 1
    p *= cost[:, None] / len(y)
    return (hidden.T @ p, p.sum(axis=0)), (p @ out.T)[bag], (index, weight)


def _descend(values, gradient, state, rows=slice(None)) -> None:
    """A step against the gradient, each number scaled by the root of its squared gradients so far."""
    past = state[id(values)]
    past[rows] += gradient * gradient
    values[rows] -= RATE * gradient / np.sqrt(past[rows])


def _curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve for y by x, with classes of equal weight and a small penalty."""
    scale = float(x.std()) or 1.0
    z, a, b = (x - x.mean()) / scale, 1.0, 0.0
    weight = np.where(y == 1, 0.5 / max((y == 1).mean(), 1e-9), 0.5 / max((y == 0).mean(), 1e-9))
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
        g, h = weight * (p - y), weight * p * (1 - p) + 1e-9
        grad = np.array([(g * z).mean() + 1e-3 * a, g.mean()])
        hess = np.array([[(h * z * z).mean() + 1e-3, (h * z).mean()], [(h * z).mean(), h.mean() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return a / scale, b - a * float(x.mean()) / scale


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Add the probability that a text is toxic."""
    sent = df.sparkSession.sparkContext.broadcast(model)

    def work(part):
        m = sent.value
        if m.weights is None:
            return with_columns(part, **{out: pa.array(np.zeros(part.num_rows))})
        values, codes, starts = words(texts_of(part, text))
        grams, ends = subwords(values)
        by_word = run_sums(m.weights[grams], ends) / np.maximum(np.diff(ends), 1)
        x = best_windows(by_word[codes], starts) + m.bias
        p = 1 / (1 + np.exp(-np.clip(m.slope * x + m.shift, -30, 30)))
        return with_columns(part, **{out: pa.array(np.round(p, 9))})

    kept = df.drop(out)
    return mapped(kept, sliced(text, work), T.StructType([*kept.schema, T.StructField(out, T.DoubleType())]))
