import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftgraph.llm import language, quality, toxicity
from weftgraph.llm.columns import held_out, words


@pytest.fixture(scope="module")
def labelled(spark, make_text):
    rows, labels = [], []
    for i in range(160):
        bad = i % 4 == 0
        rows.append((i, (make_text(i, 80).replace(" ", "!! ") if bad else make_text(i, 80)) + (" you rotten " if i % 5 == 0 else "")))
        labels.append((i, int(not bad), int(i % 5 == 0)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_words():
    codes, ends, dictionary = words(pa.array([" Ab  cD\n", "", "ab", " "], pa.large_string()))
    assert [[dictionary[int(c)].as_py() for c in codes[a:b]] for a, b in zip(ends, ends[1:])] == [["ab", "cd"], [], ["ab"], [" "]]


def test_quality(spark, labelled, odd_docs):
    docs, labels = labelled
    out = held_out(F.col("doc_id"), 4, 2)
    model = quality.fit_quality(docs, labels, ~out)
    rows = quality.quality_scores(docs, model).join(labels, "doc_id").withColumn("out", out).toPandas()
    assert ((rows.score >= 0.7) == (rows.quality == 1)).mean() > 0.97 and rows.out.any()
    odd = quality.quality_scores(odd_docs, model).toPandas()
    assert len(odd) == 10 and odd.score.between(0, 1).all()
    empty = odd[odd.doc_id.isin([2, 3, 4])].score
    assert empty.nunique() == 1 and odd[odd.doc_id == 1].score.nunique() == 1
    kept = quality.keep_quality(odd_docs, model, 0.0)
    assert kept.columns == odd_docs.columns and kept.count() == 10
    assert quality.quality_scores(docs.limit(0), model).count() == 0


def test_ftrl_matches_a_plain_loop():
    """The vectorised updates against per-feature ones."""
    rows = [(np.array([0, 2], np.int32), np.array([0.5, 0.5], np.float32), 1), (np.array([1, 2], np.int32), np.array([0.25, 0.75], np.float32), 0), (np.array([0], np.int32), np.array([1.0], np.float32), 1)]
    got = quality.fit_ftrl(rows, bits=3, passes=3)
    alpha, beta, l1, l2 = 2.0, 1.0, 0.002, 0.05
    z, n = [0.0] * 8, [0.0] * 8
    prior = np.log(2 / 1)
    bz, bn = -prior * (beta / alpha + l2), 0.0
    order = np.random.default_rng(7)

    def lead(z, n):
        return 0.0 if abs(z) <= l1 else -(z - np.sign(z) * l1) / ((beta + n**0.5) / alpha + l2)

    for _ in range(3):
        for r in order.permutation(3):
            ix, x, y = rows[r]
            w = {int(i): lead(z[i], n[i]) for i in ix}
            b = -bz / ((beta + bn**0.5) / alpha + l2)
            g = 1 / (1 + np.exp(-(b + sum(w[int(i)] * v for i, v in zip(ix, x))))) - y
            for i, v in zip(ix, x):
                s = g * float(v)
                z[i] += s - ((n[i] + s * s) ** 0.5 - n[i] ** 0.5) / alpha * w[int(i)]
                n[i] += s * s
            bz += g - ((bn + g * g) ** 0.5 - bn**0.5) / alpha * b
            bn += g * g
    assert np.allclose(got.weights[:3], [lead(z[i], n[i]) for i in range(3)], atol=1e-6)


def test_toxicity(spark, labelled, odd_docs):
    docs, labels = labelled
    model = toxicity.fit_toxicity(docs, labels, ~held_out(F.col("doc_id"), 4, 2))
    rows = toxicity.toxicity_scores(docs, model).join(labels, "doc_id").toPandas()
    assert ((rows.score >= 0.3) == (rows.toxic == 1)).mean() > 0.97
    odd = toxicity.toxicity_scores(odd_docs, model).toPandas()
    assert len(odd) == 10 and odd.score.between(0, 1).all() and (odd[odd.doc_id.isin([2, 3, 4])].score < 0.3).all()
    assert toxicity.drop_toxic(odd_docs, model, 2.0).columns == odd_docs.columns and toxicity.toxicity_scores(docs.limit(0), model).count() == 0


def test_machine_learns_a_pair():
    """Toxic only if both terms are there: no additive weights can say so."""
    rows = [(np.array(t, np.int64), int(t == [1, 2])) for t in ([1], [2], [1, 2], [3], [1, 3], [2, 3], [1, 2]) for _ in range(30)]
    m = toxicity.fit_machine(rows, bits=4, min_z=0.0, passes=60, rate=0.3)

    def logit(t):
        at = np.searchsorted(m.term, t)
        x = m.factors[at]
        return m.bias + m.linear[at].sum() + 0.5 * ((x.sum(0) ** 2).sum() - (x * x).sum())

    assert logit([1, 2]) > 0 > max(logit([1]), logit([2]), logit([1, 3]))


def test_pairs_by_production_settings():
    """Insults among themselves and groups among themselves are harmless, an insult beside a group isn't; held-out rows tell."""
    import random
    from dataclasses import replace

    r = random.Random(6)
    common = [f"w{i:03d}zz" for i in range(400)]
    insults, groups = ["vile", "rude", "mean", "nasty"], ["northers", "southers", "easters", "westers"]
    rows = []
    for k in range(2400):
        text = [r.choice(common) for _ in range(r.choice([20, 60, 200]))]
        kind = k % 8
        text += r.sample(insults, 2) if kind == 0 else r.sample(groups, 2) if kind == 1 else [r.choice(insults), r.choice(groups)] if kind == 2 else []
        r.shuffle(text)
        rows.append((" ".join(text), int(kind == 2)))
    terms, ends = toxicity.term_sets(pa.array([t for t, _ in rows], pa.large_string()))
    fitted = [(terms[a:b], y) for a, b, (_, y) in zip(ends, ends[1:], rows)]
    model = toxicity.fit_machine(fitted[:1800])
    texts_, y = pa.array([t for t, _ in rows[1800:]], pa.large_string()), np.array([y for _, y in rows[1800:]])
    right = ((model.score(texts_) >= 0.3) == y).mean()
    additive = ((replace(model, factors=model.factors * 0).score(texts_) >= 0.3) == y).mean()
    assert right > 0.98 and additive < right - 0.08


def test_factorization_sum():
    """The square trick against the sum over pairs."""
    draw = np.random.default_rng(1)
    m = toxicity.FactorizationMachine(np.arange(1 << 6), draw.normal(size=64), draw.normal(size=(64, 3)) * 0.3, 0.1, 6)
    text = pa.array(["aa bb cc dddddd aa", ""], pa.large_string())
    terms, ends = toxicity.term_sets(text, bits=6)
    t = terms[: ends[1]]
    pairs = sum(float(m.factors[a] @ m.factors[b]) for i, a in enumerate(t) for b in t[i + 1 :])
    assert np.allclose(m.score(text), [1 / (1 + np.exp(-(0.1 + m.linear[t].sum() + pairs))), 1 / (1 + np.exp(-0.1))])


@pytest.mark.parametrize("fit,name", [(quality.fit_quality, "quality"), (toxicity.fit_toxicity, "toxic")])
def test_without_labels(spark, labelled, fit, name):
    docs, labels = labelled
    for some in (labels.limit(0), labels.filter(f"{name} = 1"), labels.withColumn(name, F.lit(None).cast("int"))):
        model = fit(docs, some, F.lit(True))
        assert model.score(pa.array(["a b", ""], pa.large_string())).std() < 1e-9


def test_suffix_automaton():
    text = "abracadabra alakazam"
    automaton = language.SuffixAutomaton(text)
    inside = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def accepts(s):
        state = 0
        for c in s:
            if c not in automaton.step[state]:
                return False
            state = automaton.step[state][c]
        return True

    assert all(accepts(s) for s in inside) and not any(accepts(s) for s in ("abz", "aa", "dad", "mz", "brak") if s not in inside)


def test_phrases_by_brute_force(monkeypatch):
    monkeypatch.setattr(language, "BLOCK", 7)
    parser = language.build_parser({"a": ["abracadabra", "x"], "b": ["the cat sat", "y"]})
    texts_ = ["abracat sat on", "", "zzz", "The CAT, sat!"]
    points, ends = language.fold(pa.array(texts_, pa.large_string()))
    got = parser.phrases(points, ends)
    for row in range(4):
        folded = "".join(map(chr, points[ends[row] : ends[row + 1]]))
        for k, own in enumerate(("abracadabra", "the cat sat")):
            source = "".join(map(chr, language.fold(pa.array([own], pa.large_string()))[0]))
            n = 0
            for start in range(0, len(folded), 7):
                block, at = folded[start : start + 7], 0
                n += 1
                phrase = ""
                for c in block:
                    if phrase + c in source and (phrase or c in source):
                        phrase += c
                    elif phrase == "" and c not in source:
                        n, phrase = n + 1, ""
                    else:
                        n, phrase = n + 1, (c if c in source else "")
            assert got[row, k] == n


def test_languages(spark, odd_docs):
    import random

    r = random.Random(4)
    make = {"x": "ka ti mo re".split(), "y": "schn wurz pfeld grum".split()}
    rows = [(i, " ".join("".join(r.choice(make[k]) for _ in range(3)) for _ in range(60)), k) for i in range(80) for k in ["x" if i % 2 else "y"]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit_languages(docs, ~held_out(F.col("doc_id"), 5, 0))
    got = language.predict_languages(docs, model).join(docs, "doc_id").toPandas()
    assert (got.lang_pred == got.lang).all() and got.score.between(0, 1).all()
    odd = language.predict_languages(odd_docs, model).toPandas()
    assert len(odd) == 10 and set(odd[odd.doc_id.isin([2, 3, 4])].lang_pred) == {"und"} and not (odd[odd.doc_id == 1].lang_pred == "und").any()
    none = language.fit_languages(docs, F.lit(False))
    assert set(language.predict_languages(docs, none).toPandas().lang_pred) == {"und"} and language.predict_languages(docs.limit(0), model).count() == 0


def test_phrases_of_many_characters():
    """Every learned character counts, however many there are: phrases by brute force over 1200 of them."""
    import random

    r = random.Random(2)
    letters = [chr(0x4E00 + i) for i in range(1200)]
    source = {k: "".join(r.choice(letters) for _ in range(1500)) for k in "ab"}
    parser = language.build_parser({k: [v, v[:50]] for k, v in source.items()})
    texts_ = [source["a"][100:180] + source["b"][5:60] + "xyz" + source["a"][7:9], source["b"][300:400]]
    points, ends = language.fold(pa.array(texts_, pa.large_string()))
    got = parser.phrases(points, ends)
    for row in range(2):
        folded = "".join(map(chr, points[ends[row] : ends[row + 1]]))
        for k, lang in enumerate("ab"):
            own = "".join(map(chr, language.fold(pa.array([source[lang]], pa.large_string()))[0]))
            n, phrase = 1, ""
            for c in folded:
                if phrase + c in own:
                    phrase += c
                else:
                    n, phrase = n + 1, (c if c in own else "")
            assert got[row, k] == n
