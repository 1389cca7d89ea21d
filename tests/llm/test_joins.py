import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftgraph.llm import chat, components, decontaminate, jaccard, topk


def shingles(text, width=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w)} if 0 < len(w) < width else {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute_components(rows):
    """doc_id to (set size by row, component) by all pairs; rows of one id are one document."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    label = {d: d for d, _ in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                a_, b_ = root(a), root(b)
                label[max(a_, b_)] = min(a_, b_)
    return sorted([(d, len(x), root(d)) for d, x in sets])


@pytest.fixture(scope="module")
def copies(make_text):
    """Exact copies, near copies on both sides of the threshold, chains, shared passages, short texts."""
    r, rows = random.Random(3), []
    for base in range(12):
        words = make_text(base, 80).split()
        for k in range(8):
            w = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 4])):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            rows.append((base * 100 + k, " ".join(w)))
    passage = make_text(99, 30)
    rows += [(5000 + i, make_text(500 + i, 40) + " " + passage) for i in range(30)]
    rows += [(6000 + i, t) for i, t in enumerate(["one two", "One  TWO", "one two three", "", None, " ", "one"])]
    chain = make_text(77, 60).split()
    for i in range(12):  # each close to the next, the ends far apart
        rows.append((7000 + i, " ".join(chain)))
        chain[i * 5] = f"c{i}"
    return rows


@pytest.mark.parametrize("most,pairwise,hot,slices", [(3000, 64, 32, 500), (3, 64, 1, 1), (3000, 2, 32, 500), (5, 2, 3, 3)])
def test_components_by_brute_force(spark, copies, most, pairwise, hot, slices, monkeypatch):
    for name, value in (("PAIRWISE", pairwise), ("HOT_ROWS", hot), ("LARGE_REGIONS", slices)):
        monkeypatch.setattr(jaccard, name, value)
    docs = spark.createDataFrame(copies, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(docs, region_most=most).collect())
    assert got == brute_components(copies)


def test_components_of_odd_rows(spark, odd_docs):
    rows = [(r.doc_id, r.text) for r in odd_docs.collect()]
    got = jaccard.jaccard_components(odd_docs).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute_components(rows)
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.jaccard_components(odd_docs.limit(0)).count() == 0


def test_rows_of_one_id_are_one_document(spark, make_text):
    rows = [(5, make_text(1)), (5, make_text(2)), (3, make_text(1)), (9, make_text(2))]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == brute_components(rows) and {r[2] for r in got} == {3}


def test_region_by_brute_force():
    r = np.random.default_rng(5)
    base = [np.unique(r.integers(0, 1 << 60, 60).astype(np.uint64)) for _ in range(6)]
    sets = []
    for _ in range(150):
        s = base[r.integers(6)]
        keep = r.random(len(s)) > r.choice([0.02, 0.1, 0.2])
        sets.append(np.unique(np.concatenate([s[keep], r.integers(0, 1 << 60, r.integers(0, 10)).astype(np.uint64)])))
    region = jaccard.Region(np.arange(150), sets)
    region.join(np.arange(150))
    label = list(range(150))

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if jaccard.linked(both, len(sets[i]), len(sets[j])):
                a, b = root(i), root(j)
                label[max(a, b)] = min(a, b)
    assert [region.root(i) for i in range(150)] == [root(i) for i in range(150)]


def test_connected_components(spark):
    r = random.Random(2)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5)]
    label = {x: x for e in edges for x in e}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        label[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: root(x) for a, b in edges if a != b for x in (a, b)}
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


# Decontamination ------------------------------------------------------------------


def test_leaks(spark, make_text, odd_docs):
    items = [(i, make_text(900 + i, 15 + 4 * i)) for i in range(10)] + [(50, None), (51, ""), (52, "two words"), (53, make_text(900, 15))]
    near = items[9][1].split()
    near[20] = "changed"
    rows = [(i, make_text(i, 100) + " " + items[i][1].upper() + "!! " + make_text(40 + i, 50)) for i in range(10)]
    rows += [(20, " ".join(near)), (21, make_text(21, 200)), (22, " ".join(items[5][1].split()[:8])), (23, "Two words."), (None, items[3][1]), (24, None), (25, make_text(1, 40_000) + " " + items[4][1])]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.leaks(docs, bench).collect()
    expected = {(i, i) for i in range(10)} | {(0, 53), (20, 9), (23, 52), (None, 3), (25, 4)}
    assert {(r.doc_id, r.item_id) for r in found} == expected
    assert all(r.similarity == pytest.approx(1) for r in found if r.doc_id != 20) and all(r.first_shingle == 100 for r in found if r.doc_id in range(1, 10))
    kept = decontaminate.drop_leaks(docs, bench)
    assert {r.doc_id for r in kept.collect()} == {21, 22, 24} and kept.columns == docs.columns
    assert decontaminate.leaks(odd_docs, bench).count() == 0 and decontaminate.drop_leaks(odd_docs, bench).count() == 10
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.drop_leaks(docs.limit(0), bench).count() == 0


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12), st.integers(0, 2**32))
def test_index_finds_all_within_the_radius(prints, seed):
    index = decontaminate.ItemIndex([], [], np.zeros(0), np.zeros(0, np.uint64), np.zeros(0), np.array(prints, np.uint64), [])
    for block in range(4):
        value = (index.prints >> np.uint64(16 * block)).astype(np.uint16)
        values = (value[:, None] ^ decontaminate._near(index.radius // 4)[None, :]).ravel()
        order = np.argsort(values, kind="stable")
        index.near.append((np.searchsorted(values[order], np.arange(65537)), np.repeat(np.arange(len(prints)), len(decontaminate._near(index.radius // 4)))[order].astype(np.int32)))
    r = random.Random(seed)
    queries = [p for p in prints]
    for p in prints:
        for bits in (5, 18, 19, 20, 30):
            q = p
            for b in r.sample(range(64), bits):
                q ^= 1 << b
            queries.append(q)
    window, item = index.candidates(np.array(queries, np.uint64))
    assert set(zip(window.tolist(), item.tolist())) == {(i, j) for i, q in enumerate(queries) for j, p in enumerate(prints) if bin(q ^ p).count("1") <= index.radius}


def test_similarity_by_brute_force():
    texts_ = ["a b c d e f g h i j k l", "a b c d e f g z z z z z", "q r s t u v w x y z a b"]
    index = decontaminate.ItemIndex.build([0, 1, 2], texts_)
    flat, ends = decontaminate.item_shingles(pa.array(["a b c d e f g h i j k x"], pa.large_string()))
    weight, _ = index.weigh(flat)
    own = set(index.sets[0])
    w = lambda s: index.weigh(np.array([s], np.uint64))[0][0]
    both, whole = own & set(flat.tolist()), own | set(flat.tolist())
    assert index.similarity(flat, weight, 0) == pytest.approx(sum(map(w, both)) / sum(map(w, whole)))


# Top-k ------------------------------------------------------------------------------


@pytest.mark.parametrize("block,round_", [(topk.BLOCK, topk.ROUND), (42, 12)])
def test_top_k(spark, block, round_):
    r = random.Random(1)
    rows = [(i, [r.choice([0.0, 0.0, r.uniform(-1, 1)]) for _ in range(6)]) for i in range(60)]
    rows += [(60, None), (61, [1.0, None]), (62, [float("nan")] * 6), (63, [float("inf")] + [0.0] * 5), (64, []), (65, [0.5]), (100, [1e16] * 6), (101, [1e16] * 6), *[(3, rows[3][1])] * 9, (None, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    v = df.select("vec_id", topk.quantised(F.col("embedding")).alias("v"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(v, F.col("vec_id") % 20 == 0, 4, block, round_).filter("query_id < 100").collect()}
    good = [(i, [int(np.floor(256 * x)) for x in e]) for i, e in rows if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    for q, e in good:
        if q % 20 == 0 and q < 100:
            best = sorted(((-sum(a * b for a, b in zip(e, f)), i) for i, f in good if i != q))[:4]
            assert [got[q, k + 1][0] for k in range(4)] == [i for _, i in best]
            assert [got[q, k + 1][1] for k in range(4) if abs(best[k][0]) < 2**62] == [-s for s, _ in best if abs(s) < 2**62]
    assert topk.top_k(v.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# Chats ------------------------------------------------------------------------------


def test_chats(spark):
    marks = "<|im_end|><|im_start|>assistant ok <\\|im_part|> <|im_sep|> \\ <\\\\| <|"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a"), (1, 2, "assistant", None), (1, 3, "assistant", "b"), (1, 4, "user", marks), (1, 5, "assistant", marks), (2, None, None, "x"), (2, 1, "a<|im_sep|>\nb", "y\n"), (None, 1, "user", ""), (1, 1, "assistant", "a"), (3, 0, "assistant", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("turns", F.lit(1)).withColumn("segments", F.lit("s"))
    out = chat.format_chats(df)
    got = {r.conv_id: r for r in out.select("conv_id", chat.formatted(F.col("segments")).alias("f"), chat.loss_texts(F.col("segments")).alias("loss"), chat.read_turns(chat.formatted(F.col("segments"))).alias("turns")).collect()}
    for conv in (1, 2, 3, None):
        own = sorted([(t is not None, t or 0, r or "", x or "") for c, t, r, x in rows if c == conv])
        assert [(t.role, t.text) for t in got[conv].turns] == [(r, x) for _, _, r, x in own]
        assert got[conv].loss == [x for _, _, r, x in own if r == "assistant"]
    assert got[3].f == "<|im_start|>assistant<|im_sep|><|im_end|>\n"
    assert got[1].f.startswith("<|im_start|>user<|im_sep|>hi<|im_end|>\n<|im_start|>assistant<|im_sep|>a<|im_part|>a<|im_part|><|im_part|>b<|im_end|>\n")
    assert chat.format_chats(df.limit(0)).count() == 0
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_items_that_share_a_passage_are_found():
    """Every pair at or above the threshold, as by brute force, where most shingles of an item are shared."""
    passage = [f"p{i}" for i in range(204)]
    items = [" ".join(passage + [f"q{k}x{i}" for i in range(15)]) for k in range(10)]
    index = decontaminate.ItemIndex.build(list(range(10)), items)
    for seed in range(20):
        for k in range(10):
            own = [f"q{k}x{i}" if i < 14 else f"z{seed}x{i}" for i in range(15)]
            flat, _ = decontaminate.item_shingles(pa.array([" ".join(passage + own)], pa.large_string()))
            weight = index.weigh(flat)[0]
            expected = {j for j in range(10) if index.similarity(flat, weight, j) >= decontaminate.LEAST}
            assert k in expected and {m[0] for m in index.matches(flat)} == expected
    changed = " ".join(passage + [f"q3x{i}" if i < 10 else f"y{i}" for i in range(15)])
    flat, _ = decontaminate.item_shingles(pa.array([changed], pa.large_string()))
    assert {m[0] for m in index.matches(flat, 0.6)} == {j for j in range(10) if index.similarity(flat, index.weigh(flat)[0], j) >= 0.6}


def test_leaks_do_not_depend_on_slices(spark, monkeypatch):
    """Weights count all items, in however many passes they are taken."""
    passage = [f"p{i}" for i in range(30)]
    texts_ = [" ".join(passage + [f"q{k}x{i}" for i in range(25)]) for k in range(12)]
    bench = spark.createDataFrame(list(enumerate(texts_ + texts_[:2])), "item_id long, text string")
    docs = spark.createDataFrame([(k * 30 + n, " ".join(passage + [f"q{k}x{i}" if i < 25 - n else f"z{i}" for i in range(25)])) for k in range(12) for n in range(8)], "doc_id long, text string")
    found = []
    for most in (2000, 3):
        monkeypatch.setattr(decontaminate, "ITEMS", most)
        found.append(sorted((r.doc_id, r.item_id, round(r.similarity, 9)) for r in decontaminate.leaks(docs, bench).collect()))
    assert found[0] and found[0] == found[1]
