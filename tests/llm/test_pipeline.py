import os

import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the tables aren't here")


def test_pipeline_by_brute_force(spark):
    """Each stage's decisions against plain code over the same models."""
    import corpus_pipeline as c
    from pyspark.sql import functions as F

    from test_joins import brute_components
    from weftgraph.llm import decontaminate, pieces, quality, toxicity
    from weftgraph.llm.columns import held_out
    from weftgraph.llm.queries import vocabulary

    docs, labels, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels", "benchmark"))
    learn = ~held_out(F.col("doc_id"), 4, 2)
    rows = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    good = {r.doc_id for r in quality.quality_scores(docs, quality.fit_quality(docs, labels, learn)).filter("score >= 0.7").collect()}
    toxic = {r.doc_id for r in toxicity.toxicity_scores(docs, toxicity.fit_toxicity(docs, labels, learn)).filter("score >= 0.3").collect()}
    left = good - toxic
    firsts = {d for d, _, c_ in brute_components([(d, rows[d]) for d in left]) if d == c_}
    leaked = {r.doc_id for r in decontaminate.leaks(docs, bench).collect()}
    got = c.run(spark, SF).collect()
    assert {r.doc_id for r in got} == firsts - leaked and len(got) == len(firsts - leaked)
    enc = pieces.encoder(vocabulary("piece_bpe_32k.model"))
    assert all(len(r.pieces) == 4 * r.n_pieces and len(enc.text(rows[r.doc_id])) == r.n_pieces for r in got)
    assert [name for name, _ in c.STAGES] == ["quality", "toxicity", "near_duplicates", "decontamination", "pieces"]


def test_stages_on_odd_rows(spark, odd_docs, tmp_path):
    """Nulls, copies and clashing columns pass through every stage; all but the last keep the columns."""
    import corpus_pipeline as c

    docs = odd_docs
    for name, stage in c.STAGES:
        got = stage(spark, docs, SF)
        if name != "pieces":
            assert got.columns == docs.columns
        path = str(tmp_path / name)
        got.write.parquet(path)
        docs = spark.read.parquet(path)
    empty = odd_docs.limit(0)
    for name, stage in c.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_copies(spark, odd_docs):
    import corpus_pipeline as c

    kept = c.drop_copies(spark, odd_docs, SF).collect()
    ids = [r.doc_id for r in kept]
    assert len(ids) == 9 and ids.count(1) == 1 and ids.count(None) == 1
