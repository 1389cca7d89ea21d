"""Toxicity: a second-order factorization machine over hashed terms.

A text is the set of its hashed terms: words (A-Z lowered, outer punctuation
cut) and their stems, which are word beginnings of 3 to 6 characters.  The
score is logistic(bias + sum of w + sum over pairs <v_i, v_j>), the pair sum
by the usual square trick, so an insult beside a group mention can weigh more
than both alone.

Of the terms seen in at least ``min_rows`` fitted rows, two kinds take part.
One tells toxic rows apart alone: its count among them is ``min_z`` standard
deviations off chance.  The other does so in a pair: given the additive model
of the first kind, the rows that hold both terms leave more toxicity
unexplained than either term's own rows do, by ``pair_z`` standard deviations.
That is tested for all pairs of the ``PAIR_TERMS`` terms that are most over-
represented where toxicity is unexplained.  Terms of neither kind carry no
weight, which keeps the sum over a very long text from drifting.  All weights
and factors are then trained together, factors starting from the pairs' own
coefficients.

Defined cases: a null text counts as empty; an empty text has only the bias.
Repeated rows are scored alike; an empty table gives no rows; without both
classes among the labelled rows every score is the class prior (0.5 if none).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import bounded_batches, give_back, map_rows, mix, only, per_batch, record, row_of, segment_sum, texts, word_hashes, words
from .labelled import FIT_ROWS, array_rows, labelled_rows

BITS = 22
FACTORS = 8
#: Terms of which all pairs are tested, a parameter of the fit.
PAIR_TERMS = 2048

STEMS = (3, 4, 5, 6)


def term_sets(text: pa.Array, known: np.ndarray | None = None, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Each row's distinct terms in ascending order (only ``known`` ones if given), with offsets."""
    codes, offsets, dictionary = words(text)
    row, found = row_of(offsets), []
    bare = pc.replace_substring_regex(dictionary, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    for length in (None, *STEMS):
        part = (bare if length is None else pc.utf8_slice_codeunits(bare, 0, length)).dictionary_encode()
        h = (mix(word_hashes(part.dictionary) + np.uint64(length or 0)) >> np.uint64(64 - bits)).astype(np.int64)
        term = h[part.indices.to_numpy()]
        if known is None:
            found.append(row << bits | term[codes])
        else:
            at = np.flatnonzero(known[term][codes])
            found.append(row[at] << bits | term[codes[at]])
    pairs = np.unique(np.concatenate(found))
    return pairs & ((1 << bits) - 1), np.searchsorted(pairs >> bits, np.arange(len(offsets)))


@dataclass
class FactorizationMachine:
    """Weights of the terms that were learned; ``slot`` maps a term to its row, or -1."""

    term: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    bias: float
    bits: int = BITS

    def slots(self) -> np.ndarray:
        slot = np.full(1 << self.bits, -1, np.int32)
        slot[self.term] = np.arange(len(self.term))
        return slot

    def score(self, text: pa.Array, slot: np.ndarray | None = None) -> np.ndarray:
        slot = self.slots() if slot is None else slot
        term, ends = term_sets(text, slot >= 0, self.bits)
        at = slot[term]
        logit = self.bias + segment_sum(self.linear[at], ends)
        for v in self.factors.T:
            x = v[at]
            logit = logit + 0.5 * (segment_sum(x, ends) ** 2 - segment_sum(x * x, ends))
        return 1 / (1 + np.exp(-np.clip(logit, -500, 500)))


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _odds(seen: np.ndarray, toxic: np.ndarray, bias: float) -> np.ndarray:
    """Where linear weights start: the log odds of each term alone, shared among a word and its stems.

    Rows with many toxic terms would otherwise leave none of them enough weight to count alone.
    """
    return (np.log((toxic + 0.5) / (seen - toxic + 0.5)) - bias) / (1 + len(STEMS))


def _train(sets: list[np.ndarray], y: np.ndarray, w: np.ndarray, v: np.ndarray, bias: float, draw: np.random.Generator, rate: float, l2: float, passes: int, pace: float = 1.0) -> float:
    """Adagrad over rows of terms, in place; the new bias.  Without factors (no columns in v) the model is additive."""
    gw, gv, gb = np.full(len(w), 1e-2), np.full(v.shape, 1e-2), 1e-2
    for _ in range(passes):
        for r in draw.permutation(len(sets)):
            at = sets[r]
            x = v[at]
            total = x.sum(0)
            g = _sigmoid(bias + w[at].sum() + 0.5 * float(total @ total - (x * x).sum())) - y[r]
            gb += g * g
            bias -= rate * g / np.sqrt(gb)
            gw[at] += g * g
            w[at] -= rate / np.sqrt(gw[at]) * g
            if v.shape[1]:
                slope = g * (total - x) + l2 * x
                gv[at] += slope * slope
                v[at] = x - rate * pace / np.sqrt(gv[at]) * slope
    return bias


def _pairs(rows: list[np.ndarray], rest: np.ndarray, var: np.ndarray, terms: np.ndarray, seen: np.ndarray, most: int, pair_z: float, least: float = 4.0) -> tuple[np.ndarray, np.ndarray]:
    """(terms, coefficients of their pairs) of the pairs that matter, given what an additive model leaves of each row and the variance of that.

    Coefficients are one Newton step each, 0 for pairs that don't matter.
    """
    lost = np.maximum(rest, 0)
    mass = np.zeros(len(terms))
    index = [np.searchsorted(terms, r) for r in rows]
    for at, x in zip(index, lost, strict=True):
        mass[at] += x
    # how much more unexplained toxicity there is where the term is than its frequency lets expect
    share = seen / len(rows) * lost.sum()
    some = np.flatnonzero(mass >= least)
    some = np.sort(some[np.argsort(-((mass - share) / np.sqrt(share + 1e-9))[some], kind="stable")[:most]])
    if len(some) < 2:
        return terms[:0], np.zeros((0, 0))
    slot = np.full(len(terms), -1)
    slot[some] = np.arange(len(some))
    r, d = (np.zeros((len(some), len(some)), np.float32) for _ in range(2))
    for k in range(0, len(rows), 512):
        z = np.zeros((len(index[k : k + 512]), len(some)), np.float32)
        for i, at in enumerate(index[k : k + 512]):
            own = slot[at]
            z[i, own[own >= 0]] = 1
        r += z.T @ (z * rest[k : k + 512, None].astype(np.float32))
        d += z.T @ (z * var[k : k + 512, None].astype(np.float32))
    # what is left beyond what either term's own rows leave on average
    own = np.maximum(np.diag(r) / np.maximum(np.diag(d), 1e-9), 0)
    extra = r - np.maximum(own[:, None], own[None, :]) * d
    far = (extra >= pair_z * np.sqrt(d)) & (extra >= least)
    np.fill_diagonal(far, False)
    keep = np.flatnonzero(far.any(1))
    value = np.where(far, extra / (d + 1), 0)[np.ix_(keep, keep)]
    return terms[some[keep]], value.astype(float)


def _factors(value: np.ndarray, n: int) -> np.ndarray:
    """Factors of which the products come near the pairs' coefficients."""
    root, vectors = np.linalg.eigh(np.clip(value, 0, 8))
    top = np.argsort(-root, kind="stable")[:n]
    out = np.zeros((len(value), n))
    out[:, : len(top)] = vectors[:, top] * np.sqrt(np.maximum(root[top], 0))
    return out


def fit_machine(rows: list[tuple[np.ndarray, int]], bits: int = BITS, factors: int = FACTORS, min_rows: int = 6, min_z: float = 5.0, pair_z: float = 6.0, pair_terms: int = PAIR_TERMS, rate: float = 0.05, l2: float = 0.01, passes: int = 10, seed: int = 11) -> FactorizationMachine:
    """Fit (distinct terms, label) rows: an additive model, then the pairs that it leaves, then both together."""
    y = np.array([r[1] for r in rows], float)
    prior = float(np.clip(y.mean(), 0.01, 0.99)) if len(rows) else 0.5
    bias = float(np.log(prior / (1 - prior)))
    seen, toxic = np.zeros(1 << bits, np.int32), np.zeros(1 << bits, np.int32)
    for r, label in rows:  # terms of a row are distinct
        seen[r] += 1
        toxic[r] += label
    often = np.flatnonzero(seen >= min_rows)
    seen, toxic = seen[often], toxic[often]
    if len(set(y)) < 2 or not len(often):
        return FactorizationMachine(often[:0], np.zeros(0), np.zeros((0, factors)), bias, bits)
    slot = np.full(1 << bits, -1, np.int32)
    slot[often] = np.arange(len(often))
    rows = [often[slot[r[0]][slot[r[0]] >= 0]] for r in rows]
    draw = np.random.default_rng(seed)

    def sets(terms: np.ndarray) -> list[np.ndarray]:
        place = np.full(len(often), -1, np.int32)
        place[slot[terms]] = np.arange(len(terms))
        found = (place[slot[r]] for r in rows)
        return [f[f >= 0] for f in found]

    alone = np.abs(toxic - seen * prior) >= min_z * np.sqrt(seen * prior * (1 - prior))
    w = _odds(seen[alone], toxic[alone], bias)
    held = sets(often[alone])
    base = _train(held, y, w, np.zeros((len(w), 0)), bias, draw, rate, l2, passes)
    p = _sigmoid(base + np.array([w[at].sum() for at in held]))
    paired, value = _pairs(rows, y - p, np.maximum(p * (1 - p), 1e-3), often, seen, pair_terms, pair_z)
    term = np.union1d(often[alone], paired)
    linear, v = np.zeros(len(term)), draw.normal(0, 0.01, (len(term), factors))
    linear[np.searchsorted(term, often[alone])] = w
    if len(paired):
        v[np.searchsorted(term, paired)] += _factors(value, factors)
    bias = _train(sets(term), y, linear, v, base, draw, rate, l2, passes)
    return FactorizationMachine(term, linear, v, float(bias), bits)


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column, limit: int = FIT_ROWS) -> FactorizationMachine:
    """Learn from labels.toxic of at most ``limit`` rows for which ``learn`` holds."""
    bounded_batches(docs.sparkSession)

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            term, ends = term_sets(texts(batch, "text"))
            return record("", doc_id=batch.column(0), label=batch.column(2), terms=pa.ListArray.from_arrays(ends.astype(np.int32), pa.array(term.astype(np.int32))))

        return step

    sample = labelled_rows(docs, labels, "toxic", learn, limit).select("doc_id", "text", "label")
    got = sample.mapInArrow(per_batch(make), "doc_id long, label int, terms array<int>").toArrow().sort_by([("doc_id", "ascending")])
    model = fit_machine(list(zip(array_rows(got["terms"]), got["label"].to_pylist(), strict=True)))
    del got
    give_back()
    return model


def toxicity_scores(docs: DataFrame, model: FactorizationMachine, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, score) of every row: the probability that it is toxic."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, slot = shared.value, shared.value.slots()
        return lambda batch: record("", doc_id=batch.column(0), score=model.score(texts(batch, "text"), slot))

    return only(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(per_batch(make), "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: FactorizationMachine, threshold: float, text: str = "text") -> DataFrame:
    """The rows that score below ``threshold``, with all their columns."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        model, slot = shared.value, shared.value.slots()
        return lambda batch: batch.filter(pa.array(model.score(texts(batch, text), slot) < threshold))

    return map_rows(docs, make, docs.schema)
