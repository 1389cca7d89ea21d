"""Quality classifier: hashed word n-gram logistic regression, fitted by FTRL-proximal.

Features of a text are the relative frequencies of its hashed n-grams, one to
``order`` long, over two readings of each word: the word itself, and its shape
(letters, capitals and digits folded to one sign each, runs shortened, and an
echo sign where a word repeats the one before it).  A score is the logistic of
a sparse dot product.

Defined cases: a null text counts as empty; an empty text has only the bias.
Repeated rows are scored alike; an empty table gives no rows; without any
labelled row, or with only one class, every score is the class prior (0.5 if
there is none).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches, give_back, map_rows, mix, only, per_batch, record, row_of, segment_sum, texts, word_hashes, words
from .labelled import FIT_ROWS, array_rows, labelled_rows

BITS = 20


def word_shape(word: str) -> str:
    """Letters become x, capitals X, digits 9; runs of one sign are cut to three."""
    out: list[str] = []
    for c in word:
        sign = "X" if c.isupper() else "x" if c.isalpha() else "9" if c.isdigit() else c
        if len(out) < 3 or not out[-1] == out[-2] == out[-3] == sign:
            out.append(sign)
        if len(out) > 24:
            break
    return "".join(out)


@lru_cache(1 << 18)
def _shape_hash(shape: str) -> int:
    return int(word_hashes(pa.array([shape]))[0])


def _shape_hashes(dictionary: pa.Array) -> np.ndarray:
    return np.fromiter((_shape_hash(word_shape(w)) for w in dictionary.to_pylist()), np.uint64, len(dictionary))


def features(text: pa.Array, bits: int = BITS) -> tuple[list[np.ndarray], np.ndarray]:
    """Feature numbers as equally long flat arrays, and the offsets of the rows.

    Position k of each array belongs to word k: its unigram, bigram with the
    next word, shape, and shape bigram.  At a row's end the bigram ends in a stop.
    """
    codes, offsets, dictionary = words(text, lower=False)
    plain = word_hashes(pc.ascii_lower(dictionary))[codes]
    shape = _shape_hashes(dictionary)[codes]
    last = np.zeros(len(codes), bool)
    last[offsets[1:][np.diff(offsets) > 0] - 1] = True

    def following(h: np.ndarray) -> np.ndarray:
        return np.where(last, np.uint64(1), np.append(h[1:], np.uint64(1)))

    with np.errstate(over="ignore"):
        after = following(plain)
        shape = np.where(after == plain, shape + np.uint64(77), shape)
        arrays = [plain, plain * np.uint64(3) + mix(after), shape + np.uint64(5), shape * np.uint64(7) + mix(following(shape))]
        return [(mix(a) >> np.uint64(64 - bits)).astype(np.int32) for a in arrays], offsets


@dataclass
class FtrlModel:
    """Weights over 2**bits features, and a bias."""

    weights: np.ndarray
    bias: float
    bits: int = BITS

    def score(self, text: pa.Array) -> np.ndarray:
        arrays, offsets = features(text, self.bits)
        total = self.weights[arrays[0]]
        for a in arrays[1:]:
            total = total + self.weights[a]
        n = np.maximum(np.diff(offsets), 1)
        return 1 / (1 + np.exp(-np.clip(self.bias + segment_sum(total.astype(np.float64), offsets) / n, -500, 500)))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int = BITS, alpha: float = 2.0, beta: float = 1.0, l1: float = 0.002, l2: float = 0.05, passes: int = 4, seed: int = 7) -> FtrlModel:
    """Follow-the-regularised-leader over (feature numbers, values, label) rows."""
    y = np.array([r[2] for r in rows], float)
    prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(rows) else 0.5
    weights, bias = np.zeros(1 << bits, np.float32), float(np.log(prior / (1 - prior)))
    if len(set(y)) < 2:
        return FtrlModel(weights, bias, bits)
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    bias_z, bias_n = -bias * (beta / alpha + l2), 0.0
    order = np.random.default_rng(seed)

    def leader(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(passes):
        for r in order.permutation(len(rows)):
            index, value, label = rows[r]
            w = leader(z[index], n[index])
            b = -bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)
            g = 1 / (1 + np.exp(-np.clip(b + w @ value, -50, 50))) - label
            step = g * value
            z[index] += step - (np.sqrt(n[index] + step * step) - np.sqrt(n[index])) / alpha * w
            n[index] += step * step
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / alpha * b
            bias_n += g * g
    return FtrlModel(leader(z, n).astype(np.float32), float(-bias_z / ((beta + np.sqrt(bias_n)) / alpha + l2)), bits)


def training_rows(sample: DataFrame, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The features of a bounded sample, computed on the executors."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            arrays, offsets = features(texts(batch, "text"), bits)
            row = np.tile(row_of(offsets), len(arrays)).astype(np.int64)
            pairs, count = np.unique(row << bits | np.concatenate(arrays), return_counts=True)
            row = pairs >> bits
            value = (count / np.maximum(np.diff(offsets), 1)[row]).astype(np.float32)
            cuts = np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32)
            lists = [pa.ListArray.from_arrays(cuts, pa.array(a)) for a in ((pairs & ((1 << bits) - 1)).astype(np.int32), value)]
            return record("", doc_id=batch.column(0), label=batch.column(2), i=lists[0], x=lists[1])

        return step

    got = sample.select("doc_id", "text", "label").mapInArrow(per_batch(make), "doc_id long, label int, i array<int>, x array<float>").toArrow().sort_by([("doc_id", "ascending")])
    return list(zip(array_rows(got["i"]), array_rows(got["x"]), got["label"].to_pylist(), strict=True))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = FIT_ROWS) -> FtrlModel:
    """Learn from labels.quality of at most ``limit`` rows for which ``learn`` holds."""
    bounded_batches(docs.sparkSession)
    model = fit_ftrl(training_rows(labelled_rows(docs, labels, "quality", learn, limit)))
    give_back()
    return model


def quality_scores(docs: DataFrame, model: FtrlModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability that its quality is 1."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: record("", doc_id=batch.column(0), score=shared.value.score(texts(batch, "text")))

    return only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(per_batch(make), "doc_id long, score double")


def keep_quality(docs: DataFrame, model: FtrlModel, threshold: float, text: str = "text") -> DataFrame:
    """The rows that score at least ``threshold``, with all their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        return lambda batch: batch.filter(pa.array(shared.value.score(texts(batch, text)) >= threshold))

    return map_rows(docs, make, docs.schema)
