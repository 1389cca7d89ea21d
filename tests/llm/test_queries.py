"""The queries that SQL can't express, over whole small tables, against plain versions of them."""

import math
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import regex
import xxhash

from weftgraph.llm import language, quality, queries, toxicity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return duckdb.sql(f"select doc_id, text, lang from '{DATA}/documents.parquet' order by doc_id").fetchall()


def out(doc_id, modulus, rest):
    return zlib.crc32(str(doc_id).encode()) % modulus == rest


def plain_words(text):
    return regex.findall(r"[^\x20\x09-\x0d]+", regex.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def bare(word):
    return regex.sub(r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "", word)


def scramble(x):
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) % 2**64
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) % 2**64
    return x ^ (x >> 31)


def kept(monkeypatch, module, name):
    """What the named function returns, and the arguments it gets."""
    calls, real = [], getattr(module, name)

    def call(*args, **more):
        calls.append((args, real(*args, **more)))
        return calls[-1][1]

    monkeypatch.setattr(module, name, call)
    return calls


def test_toxicity_query(spark, docs, monkeypatch):
    calls = kept(monkeypatch, toxicity, "fit_toxicity")
    got = {r.doc_id: r for r in queries.op3_toxicity(spark, DATA).collect()}
    model = calls[0][1]

    def terms(text):
        found = set()
        for w in plain_words(text):
            for n in (None, *toxicity.STEMS):
                found.add(scramble((xxhash.xxh3_64_intdigest(bare(w)[:n].encode()) + (n or 0)) % 2**64) >> (64 - model.bits))
        return sorted(found)

    labels = dict(duckdb.sql(f"select doc_id, toxic from '{DATA}/labels.parquet' where toxic is not null").fetchall())
    again = toxicity.fit_machine([(np.array(terms(t)), labels[d]) for d, t, _ in docs if d in labels and not out(d, 4, 2)])
    assert again.term.tolist() == model.term.tolist() and np.allclose(again.linear, model.linear) and np.allclose(again.factors, model.factors)
    place = {t: k for k, t in enumerate(model.term.tolist())}
    assert set(got) == {d for d, _, _ in docs}
    for d, text, _ in docs:
        own = [place[t] for t in terms(text) if t in place]
        logit = model.bias + sum(model.linear[i] for i in own) + sum(float(model.factors[i] @ model.factors[j]) for k, i in enumerate(own) for j in own[k + 1 :])
        score = 1 / (1 + math.exp(-max(-500, min(500, logit))))
        assert got[d].score == pytest.approx(score, abs=1e-9) and got[d].held_out == out(d, 4, 2) and got[d].predicted == int(got[d].score >= 0.3)


def test_quality_query(spark, docs, monkeypatch):
    calls = kept(monkeypatch, quality, "fit_quality")
    got = {r.doc_id: r for r in queries.op7_quality(spark, DATA).collect()}
    model = calls[0][1]
    mask = 2**64 - 1

    def place(h):
        return scramble(h & mask) >> (64 - model.bits)

    def features(text):
        raw = regex.findall(r"[^\x20\x09-\x0d]+", text or "")
        low = [xxhash.xxh3_64_intdigest(w.encode()) for w in plain_words(text)]
        shape = [xxhash.xxh3_64_intdigest(quality.word_shape(w).encode()) for w in raw]
        shape = [(s + 77) & mask if k + 1 < len(low) and low[k + 1] == low[k] else s for k, s in enumerate(shape)]
        for k in range(len(low)):
            after, echo = (low[k + 1], shape[k + 1]) if k + 1 < len(low) else (1, 1)
            yield from (place(low[k]), place(low[k] * 3 + scramble(after)), place(shape[k] + 5), place(shape[k] * 7 + scramble(echo)))

    assert set(got) == {d for d, _, _ in docs}
    for d, text, _ in docs:
        f = list(features(text))
        logit = model.bias + sum(float(model.weights[i]) for i in f) / max(len(f) // 4, 1)
        assert got[d].score == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5) and got[d].held_out == out(d, 4, 2) and got[d].predicted == int(got[d].score >= 0.7)


def test_language_query(spark, docs, monkeypatch):
    calls = kept(monkeypatch, language, "build_parser")
    got = {r.doc_id: r for r in queries.op8_language(spark, DATA).collect()}
    samples = calls[0][0][0]
    learned = [t or "" for d, t, lang in docs if lang and not out(d, 5, 0)]
    assert set(samples) == {lang for d, _, lang in docs if lang and not out(d, 5, 0)}
    assert all(any(x in t for t in learned) for rows in samples.values() for x in rows)

    def fold(text):
        return regex.sub(r"[^\p{L}\p{Other_Alphabetic}]+", " ", " " + "".join(c.lower()[0] if c.isalpha() else " " for c in text) + " ") if any(c.isalpha() for c in text) else ""

    def phrases(text, source):
        n = 0
        for k in range(0, len(text), language.BLOCK):
            n, phrase = n + 1, ""
            for c in text[k : k + language.BLOCK]:
                if phrase + c in source:
                    phrase += c
                else:
                    n, phrase = n + 1, (c if c in source else "")
        return n

    source, norm = {}, {}
    for lang in sorted(samples):
        rows = [f for f in map(fold, samples[lang]) if f]
        source[lang] = "".join(rows[::2])[: language.FIT_CHARS]
        own = "".join(rows[1::2] or rows)
        norm[lang] = phrases(own, source[lang]) / len(own)
    assert set(got) == {d for d, _, _ in docs}
    right = 0
    for d, text, lang in docs:
        f = fold(text or "")
        best = min(sorted(source), key=lambda k: phrases(f, source[k]) / norm[k]) if f else "und"
        assert got[d].lang_pred == best and got[d].held_out == out(d, 5, 0) and 0 <= got[d].score <= 1
        right += best == lang
    assert right > 0.95 * sum(lang is not None for _, _, lang in docs)


def test_decontamination_query(spark, docs):
    items = duckdb.sql(f"select item_id, text from '{DATA}/benchmark.parquet' where text is not null").fetchall()

    def shingles(text):
        w = [bare(x.lower()) for x in regex.findall(r"[^\x20\x09-\x0d]+", text)]
        return [tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))]

    own = {k: shingles(t) for k, t in items}
    often = Counter(s for rows in {tuple(r) for r in own.values()} for s in set(rows))

    def weight(s):
        return 1 / often.get(s, 1)

    expected = {}
    for d, text, _ in docs:
        seen = shingles(text or "")
        for k, item in own.items():
            if not set(item) & set(seen):
                continue
            size, wanted, best = min(len(item), len(seen)), Counter(item), None
            for at in range(len(seen) - size + 1):
                window = Counter(seen[at : at + size])
                if window.keys() & wanted.keys():
                    same = sum(weight(s) * n for s, n in (window & wanted).items()) / sum(weight(s) * n for s, n in (window | wanted).items())
                    if same >= 0.75 - 1e-9 and (best is None or same > best[0] + 1e-9):
                        best = (same, at, size)
            if best:
                expected[d, k] = best
    got = {(r.doc_id, r.item_id): (r.similarity, r.first_shingle, r.n_shingles) for r in queries.op2_decontaminate(spark, DATA).collect()}
    assert expected and set(got) == set(expected)
    for k, (same, at, size) in expected.items():
        assert got[k] == (pytest.approx(same), at, size)
