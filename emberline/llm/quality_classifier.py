"""Document quality from learned subword embeddings.

A document is the bag of its words and of the character n-grams of its words, each hashed to one of
BUCKETS vectors; a word that repeats the one before it also counts as a shared token (an addition to the
method: repeats are what n-grams of single words can't see). The vectors are
averaged, a linear layer and a softmax give the probability of either class, and all of it is trained by
stochastic gradient descent in numpy on a bounded sample of labelled documents.

Averaging and the linear layer commute, so for scoring each bucket's vector shrinks to one number, its
share of the log-odds. The model that executors get is BUCKETS floats whatever the input.

Defined results: a null, empty or blank text has no features and gets the score that the bias alone
gives. A null label or doc_id in the labels is never learned from. Without labelled rows the score is the
prior of 0.5 everywhere. Repeated rows get equal scores; of labelled rows that share a doc_id the least text is learned from; other columns of the documents are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emberline.llm import bytewords as bw
from emberline.llm.common import few, ship

BUCKETS = 1 << 16
DIMENSIONS = 12
GRAMS = (3, 4)
EPOCHS = 6
RATE = 0.5
#: At most so many labelled documents are learned from: those with the least hash of their id.
SAMPLE = 2400
THRESHOLD = 0.3
#: Each average also holds so many zero vectors, so that a few features don't decide alone.
ZEROS = 60
_REPEAT = 1  # the bucket of the shared token
_REPEAT_WEIGHT = 8


def features(raw: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """[(buckets, at)]: for words, n-grams and repeats the buckets, text after text, and where each text's begin.

    Words are laid out with one blank on either side, so that an n-gram over a word's edge holds a blank;
    n-grams across a blank don't count. Bytes stand for characters."""
    starts, ends, first = bw.word_spans(raw, offsets)
    keys = bw.span_keys(bw.prefix_sums(raw), starts, ends)
    again = np.zeros(len(keys), bool)
    again[1:] = keys[1:] == keys[:-1]
    again[first[:-1][first[:-1] < len(keys)]] = False
    size = ends - starts + 1  # with the blank after
    at = np.concatenate([[0], np.cumsum(size)])
    line = np.full(at[-1] + 1, 32, np.uint32)
    if len(size):
        place = np.arange(at[-1]) - np.repeat(at[:-1], size)
        inside = place < np.repeat(size - 1, size)
        line[1:][inside] = raw[np.repeat(starts, size)[inside] + place[inside]]
    edges = at[first]
    blank = line == 32
    parts = [((keys >> np.uint64(48)).astype(np.int64) % BUCKETS, first)]
    for n, salt in zip(GRAMS, (0x9E3779B1, 0x85EBCA6B)):
        m = len(line) - n + 1
        if m <= 0:
            parts.append((np.zeros(0, np.int64), np.zeros(len(first), np.int64)))
            continue
        code, good = np.zeros(m, np.uint32), np.ones(m, bool)
        for j in range(n):
            code = code << np.uint32(8) | line[j : j + m]
            if 0 < j < n - 1:
                good &= ~blank[j : j + m]
        code ^= code >> np.uint32(15)
        code *= np.uint32(salt)
        code ^= code >> np.uint32(13)
        code *= np.uint32(0xC2B2AE35)
        held = np.flatnonzero(good)
        parts.append(((code[held] >> np.uint32(16)).astype(np.int64), np.searchsorted(held, edges)))
    parts.append((np.full(int(again.sum()) * _REPEAT_WEIGHT, _REPEAT, np.int64), np.concatenate([[0], np.cumsum(again)])[first] * _REPEAT_WEIGHT))
    return parts


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, buckets, weights): a document's features with their shares."""
    for b in batches:
        raw, offsets = bw.texts(b.column(0))
        labels = b.column(1).to_pylist()
        for lo, hi, r, o in bw.chunks(raw, offsets):
            parts = features(r, o)
            for d in range(hi - lo):
                used, n = np.unique(np.concatenate([x[at[d] : at[d + 1]] for x, at in parts]), return_counts=True)
                weights = (n / (n.sum() + ZEROS)).astype(np.float32)
                yield pa.RecordBatch.from_arrays([pa.array([labels[lo + d]], pa.int32()), pa.array([used.astype(np.uint16).tobytes()]), pa.array([weights.tobytes()])], names=["label", "buckets", "weights"])


def train(rows: list[tuple[int, np.ndarray, np.ndarray]], seed: int = 1) -> np.ndarray:
    """BUCKETS + 1 float32: each bucket's share of the log-odds of label 1, then the bias."""
    out = np.zeros(BUCKETS + 1, np.float32)
    ones = sum(y for y, _, _ in rows)
    if not rows:
        return out
    rng = np.random.default_rng(seed)
    vectors = ((rng.random((BUCKETS, DIMENSIONS)) - 0.5) / DIMENSIONS).astype(np.float32)
    layer = np.zeros((DIMENSIONS, 2), np.float32)
    layer[:, 1] = (rng.random(DIMENSIONS) - 0.5).astype(np.float32)
    layer[:, 0] = -layer[:, 1]
    bias = np.log(np.array([len(rows) - ones + 1, ones + 1], np.float32) / (len(rows) + 2))
    steps, total = 0, EPOCHS * len(rows)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            y, used, weights = rows[i]
            rate = RATE * (1 - steps / total)
            steps += 1
            own = vectors[used]
            mean = weights @ own
            z = mean @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            down = layer @ p
            layer -= rate * np.outer(mean, p)
            bias -= np.float32(0.1 * rate) * p
            # A document's features share its step in proportion to their weights; AdaGrad isn't needed.
            vectors[used] = own - (rate * 40) * weights[:, None] * down[None, :]
    slope = layer[:, 1] - layer[:, 0]
    out[:-1] = vectors @ slope
    out[-1] = bias[1] - bias[0]
    return out


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Learns from at most `sample` documents that have a label (doc_id, quality)."""
    ship(docs.sparkSession)
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    # Ties of the hash go by id; of documents that share an id one text counts, so that as many rows as ids are collected.
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(few(chosen, sample), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    rows = texts.select("text", "label").mapInArrow(_featurize, "label int, buckets binary, weights binary")
    held = [(int(r.label), np.frombuffer(r.buckets, np.uint16).astype(np.int64), np.frombuffer(r.weights, np.float32)) for r in rows.collect()]
    held.sort(key=lambda x: (x[0], x[1].tobytes(), x[2].tobytes()))  # as tasks may end in any order
    return train(held)


def probabilities(raw: np.ndarray, offsets: np.ndarray, model: np.ndarray) -> np.ndarray:
    """The probability of label 1 of each text."""
    sums, counts = np.zeros(len(offsets) - 1), np.zeros(len(offsets) - 1)
    for lo, hi, r, o in bw.chunks(raw, offsets):
        for buckets, at in features(r, o):
            total = np.concatenate([[0.0], np.cumsum(model[buckets], dtype=np.float64)])
            sums[lo:hi] += total[at[1:]] - total[at[:-1]]
            counts[lo:hi] += at[1:] - at[:-1]
    return 1 / (1 + np.exp(-np.clip(sums / (counts + ZEROS) + model[-1], -500, 500)))


def score(docs: DataFrame, model: np.ndarray) -> DataFrame:
    """docs with a column quality_score (double): the probability of label 1."""
    ship(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def probability(column: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in column:
            raw, offsets = bw.texts(pa.array(batch, pa.string()))
            yield pd.Series(probabilities(raw, offsets, held.value))

    return docs.withColumn("quality_score", probability("text"))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs whose probability of label 1 is at least threshold."""
    scored = score(docs, fit(docs, labels)).where(F.col("quality_score") >= threshold)
    return scored.select(*[F.col(f"`{c}`") for c in docs.columns])
