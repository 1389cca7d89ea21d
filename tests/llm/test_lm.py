import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import lm
from weftgraph.llm.columns import held_out, words


@pytest.fixture(scope="module")
def model(path, make_text):
    p = path("byte_bpe_50k.tiktoken")
    texts = pa.array([make_text(i, 50) for i in range(30)], pa.large_string())
    batch = lm.Batch(p, *words(texts))
    size = lm.subwords(p).end + 1
    pairs, often = batch.pair_counts(size)
    rows = np.lib.stride_tricks.sliding_window_view(batch.ids, 2 * lm.STRIDE + 1)[::8].astype(np.int64)
    return lm.train(rows, pairs, often, size, passes=2), p


def test_ids_are_those_of_the_text(path):
    p = path("byte_bpe_50k.tiktoken")
    coder = lm.subwords(p).coder
    texts = ["Hello  World\n", "", "it's a test... 中文 é", " x a　b"]
    batch = lm.Batch(p, *words(pa.array(texts, pa.large_string())))
    for t, a, b in zip(texts, batch.ends, batch.ends[1:]):
        own = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        expected = [i for w in re.findall(r"[^\x20\x09-\x0d]+", own) for i in coder.encode_ordinary(" " + w)]
        assert batch.ids[a:b].tolist() == [*expected, lm.subwords(p).end]


def test_pairs_by_brute_force(path, make_text):
    p = path("byte_bpe_50k.tiktoken")
    batch = lm.Batch(p, *words(pa.array([make_text(1, 30), "", "one two two"], pa.large_string())))
    expected = Counter()
    for a, b in zip(batch.ends, batch.ends[1:]):
        ids = [batch.end, *batch.ids[a:b].tolist()]
        expected.update(zip(ids, ids[1:]))
    size = batch.end + 1
    pairs, often = batch.pair_counts(size)
    assert {(int(k) // size, int(k) % size): int(n) for k, n in zip(pairs, often)} == dict(expected)


def test_scores_by_brute_force(model, make_text):
    """Every token once, with its block's window, by a plain loop over the same weights."""
    m, p = model
    texts = [make_text(100, 45), "", "one"]
    batch = lm.Batch(p, *words(pa.array(texts, pa.large_string())))
    got = m.score(batch)
    w = {k: v.astype(float) for k, v in m.weights.items()}
    for row, (a, b) in enumerate(zip(batch.ends, batch.ends[1:])):
        ids, total = [batch.end, *batch.ids[a:b].tolist()], 0.0
        for t in range(len(ids) - 1):
            low = max(0, (t // lm.STRIDE - 1) * lm.STRIDE)
            e = w["embed"][ids[low : t + 1]]
            s = (e[-1] @ w["query"]) @ (e @ w["key"]).T / np.sqrt(lm.WIDTH) + w["bias"][t - np.arange(low, t + 1)]
            att = np.exp(s - s.max())
            o = (att / att.sum()) @ (e @ w["value"])
            logits = np.tanh(o @ w["mix"] + e[-1] @ w["rest"] + w["shift"]) @ w["out"] + w["lift"]
            logp = logits - np.log(np.exp(logits).sum())
            total += logp[m.classes[ids[t + 1]]] + float(m.shares(np.array([ids[t]]), np.array([ids[t + 1]]))[0])
        assert got[row] == pytest.approx(total / np.log(10), rel=1e-4)


def test_equal_texts_score_equally_anywhere(model, make_text):
    """To the last bit, whatever stands before a text in its batch."""
    m, p = model
    same, rest = make_text(3, 37), [make_text(i, 1 + 7 * i % 60) for i in range(100, 180)]
    found = set()
    for k in range(0, 80, 7):
        got = m.score(lm.Batch(p, *words(pa.array([*rest[k:], same, *rest[:k], same], pa.large_string()))))
        found |= {got[80 - k], got[-1]}
    assert len(found) == 1


def test_shares_sum_to_one(model):
    m, _ = model
    every = np.arange(len(m.classes))
    for left in (0, 300, len(every) - 1):
        p = np.exp(m.shares(np.full(len(every), left), every).astype(float))
        used = np.bincount(m.classes, minlength=lm.CLASSES) > 0
        assert np.allclose(np.bincount(m.classes, p, lm.CLASSES)[used], 1, atol=1e-3)


@pytest.mark.parametrize("most", [1_000_000, 20])
def test_table(spark, path, make_text, odd_docs, monkeypatch, most):
    monkeypatch.setattr(lm, "BROADCAST_WORDS", most)
    docs = odd_docs.select("doc_id", "text").union(spark.createDataFrame([(i, make_text(i % 25, 40)) for i in range(100, 180)], "doc_id long, text string"))
    out = held_out(F.col("doc_id"), 7, 2)
    got = lm.score_documents(docs, ~out, path("byte_bpe_50k.tiktoken")).collect()
    rows = [(r.doc_id, re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))) for r in docs.collect()]
    learn = [(d, w) for d, w in rows if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    c = Counter(x for _, w in learn for x in w)
    n, v = sum(c.values()) + len(learn), len(c) + 1

    def base(w):
        return sum(np.log10((c[x] + 1) / (n + v + 1)) for x in w) + np.log10((len(learn) + 1) / (n + v + 1))

    expected = sorted((d is not None, d or 0, len(w) + 1, sum(c[x] > 0 for x in w) + 1, n, round(base(w), 3)) for d, w in rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 3)) for r in got) == expected
    assert all(np.isfinite(r.score) and r.score < 0 for r in got)
    same = {r.score for r in got if r.doc_id == 1}
    assert len(same) == 1


def test_without_training_texts(spark, path, odd_docs):
    got = lm.score_documents(odd_docs, F.lit(False), path("byte_bpe_50k.tiktoken")).collect()
    assert len(got) == 10 and {r.train_tokens for r in got} == {0} and {r.n_known for r in got} == {0} and all(r.base_score == 0 for r in got)
    assert lm.score_documents(odd_docs.limit(0), F.lit(True), path("byte_bpe_50k.tiktoken")).count() == 0


def test_pairs_beyond_the_broadcast_count(spark, path, make_text, monkeypatch):
    """Scores don't depend on how many pairs are broadcast."""
    docs = spark.createDataFrame([(i, make_text(i, 40)) for i in range(60)], "doc_id long, text string")
    scores = []
    for most in (1_000_000, 30, 0):
        monkeypatch.setattr(lm, "BROADCAST_PAIRS", most)
        got = lm.score_documents(docs, ~held_out(F.col("doc_id"), 7, 2), path("byte_bpe_50k.tiktoken")).collect()
        scores.append([r.score for r in sorted(got, key=lambda r: r.doc_id)])
    assert np.allclose(scores[0], scores[1], rtol=1e-5) and np.allclose(scores[0], scores[2], rtol=1e-5)


def test_windows_hold_every_token_once():
    ids, ends = np.arange(1, 72, dtype=np.int32), np.array([0, 1, 33, 71])
    got = lm.cut_windows(ids, ends)
    assert sorted(got[:, 1:][got[:, 1:] >= 0].tolist()) == ids.tolist() and got.shape == (4, 2 * lm.STRIDE + 1)
    assert got[0, :2].tolist() == [1, 1] and got[1, 0] == 33 and got[2, 0] == 71 and got[3, 0] == ids[33 + 31]


def test_weights_learn_from_all_texts(spark, path, make_text, monkeypatch):
    """A sentence in one training text that the first training doesn't draw still moves its ids' embeddings."""
    monkeypatch.setattr(lm, "FIT_WINDOWS", 0)
    docs = spark.createDataFrame([(i, make_text(i, 40)) for i in range(30)] + [(99, "zebra quagmire")], "doc_id long, text string").repartition(3)
    p = path("byte_bpe_50k.tiktoken")
    batch = lm.Batch(p, *words(pa.array([r.text for r in docs.collect()], pa.large_string())))
    size = lm.subwords(p).end + 1
    pairs, often = batch.pair_counts(size)
    before, after = (lm.train(np.zeros((0, 2 * lm.STRIDE + 1), np.int64), pairs, often, size, more=more) for more in (None, lambda a, c: lm._learn_all(docs, p, a, c)))
    moved = np.flatnonzero((before.weights["embed"] != after.weights["embed"]).any(1))
    assert set(moved.tolist()) == set(batch.ids.tolist())


@pytest.mark.parametrize("scale", [1, 40])
def test_gradients_by_differences(scale):
    """A step's gradients against differences of a plain loss, with ids that repeat, unfilled windows and, scaled, exponents that would overflow."""
    draw = np.random.default_rng(1)
    n, length = 40, 2 * lm.STRIDE
    windows = draw.integers(0, n, (3, length + 1))
    windows[1, 9:] = -1
    classes = draw.integers(0, lm.CLASSES, n)
    learner = lm.Learner(n, np.ones(lm.CLASSES), 3)
    learner.w["query"] *= scale
    learner.w["bias"] += draw.normal(0, 0.3, length).astype(np.float32)
    w = {k: v.astype(float) for k, v in learner.w.items()}
    embed = learner.w["embed"].copy()

    def loss():
        total, seen = 0.0, 0
        for row in windows:
            e = w["embed"][np.maximum(row[:-1], 0)]
            for t in range(length):
                if row[t + 1] < 0:
                    continue
                s = (e[t] @ w["query"]) @ (e[: t + 1] @ w["key"]).T / np.sqrt(lm.WIDTH) + w["bias"][t - np.arange(t + 1)]
                a = np.exp(s - s.max())
                logits = np.tanh(a / a.sum() @ (e[: t + 1] @ w["value"]) @ w["mix"] + e[t] @ w["rest"] + w["shift"]) @ w["out"] + w["lift"]
                total += np.log(np.exp(logits - logits.max()).sum()) + logits.max() - logits[classes[row[t + 1]]]
                seen += 1
        return total / seen

    learner.step(windows, classes, 1e-3)
    for name, v in w.items():
        for _ in range(3):
            at = tuple(int(draw.integers(0, d)) for d in v.shape)
            kept = v[at]
            v[at] = kept + 1e-5
            above = loss()
            v[at] = kept - 1e-5
            slope, v[at] = (above - loss()) / 2e-5, kept
            # the first moment is a tenth of the gradient; embeddings keep their squares
            got = learner.moment[name][0][at] * 10 if name != "embed" else np.sqrt(learner.met[at]) * np.sign(embed[at] - learner.w["embed"][at])
            assert got == pytest.approx(slope, rel=2e-2, abs=2e-5)
