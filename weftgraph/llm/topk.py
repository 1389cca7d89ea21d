"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Vectors become integer weights per dimension (the terms).  Candidates are dealt
to blocks and queries to rounds, both of bounded size; a task gets one block and
one round.  It makes one posting list a term: the block's rows with a non-zero
weight, and the weights.  Each sparse query row scatters its weight times the
posting weights into a dense score array, term by term; partition selection
keeps k a query, and the kept rows are merged over all blocks.

The queries are sent to each block, the candidates once a round, so what is
shuffled grows with the candidates alone until the queries outgrow a round.
Equal candidate rows are counted before they are dealt (more than k of them
can't matter), so that no id or vector fills one block.

Defined cases: vectors that are null, or hold null or non-finite components,
take no part, nor do rows with a null id; a row isn't a candidate of a query
with its own id; repeated candidate rows each count; repeated query rows give
one answer for each distinct vector; shorter vectors count as padded with zeros;
empty vectors score 0; a score beyond 64 bits counts in the order and is null; ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .columns import bounded_batches

#: Components of a candidate block and of a round of queries, and candidate blocks merged in the first step.
BLOCK, ROUND, MERGE = 1 << 19, 1 << 20, 64
#: Sums of products below this fit 64 bits; larger ones use Python integers.
EXACT = 1 << 62


def quantised(vector: Column, scale: int = 256) -> Column:
    """floor(scale * component) of each component; null where the vector takes no part."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.when(vector.isNotNull() & good, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All components of a list column, and each row's offset."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    ends = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[ends[0] : ends[-1]], ends - ends[0]


def _postings(v: np.ndarray, ends: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Per term the rows and weights that aren't zero."""
    row = np.repeat(np.arange(len(ends) - 1), np.diff(ends))
    term = np.arange(len(v)) - ends[row]
    keep = v != 0
    row, term, v = row[keep], term[keep], v[keep]
    by = np.argsort(term, kind="stable")
    cuts = np.flatnonzero(np.diff(term[by])) + 1
    return {int(term[p[0]]): (row[p], v[p]) for p in np.split(by, cuts) if len(p)}


RESULT = pa.schema([("query_id", pa.int64()), ("q", pa.int64()), ("vec_id", pa.int64()), ("score", pa.string()), ("block", pa.int32())])


def score_block(candidates: pa.Table, queries: pa.Table, k: int, block: int = 0) -> pa.Table:
    """The k best of the candidates (vec_id, v, copies) for each of the queries (query_id, w, q)."""
    if not candidates.num_rows or not queries.num_rows:
        return RESULT.empty_table()
    candidates = candidates.sort_by("vec_id")  # so that ties go to the smaller id
    copies = np.minimum(candidates["copies"].to_numpy(), k)
    ids = np.repeat(candidates["vec_id"].to_numpy(), copies)
    v, ends = _flat(candidates["v"].take(pa.array(np.repeat(np.arange(len(copies)), copies))))
    postings = _postings(v, ends)
    top = {t: max(abs(int(w.max())), abs(int(w.min()))) for t, (_, w) in postings.items()}
    flat, bounds = _flat(queries["w"])
    out: list[tuple[np.ndarray, list[str]]] = []
    own = queries["query_id"].to_numpy()
    for q in range(len(own)):
        weights = [(t, w) for t, w in enumerate(flat[bounds[q] : bounds[q + 1]].tolist()) if w and t in postings]
        exact = sum(abs(w) * top[t] for t, w in weights) < EXACT
        scores = np.zeros(len(ids), np.int64 if exact else object)
        for t, w in weights:
            rows, values = postings[t]
            values = values if exact else values.astype(object)
            if len(rows) == len(ids):
                scores += w * values
            else:
                scores[rows] += w * values
        at = np.arange(len(ids)) if own[q] < ids[0] or own[q] > ids[-1] else np.flatnonzero(ids != own[q])
        if len(at) > k:
            s = scores[at]
            if exact:
                floor = s[np.argpartition(s, len(s) - k)[len(s) - k]]
                at = at[s >= floor]
                s = s[s >= floor]
            at = at[np.argsort(-s, kind="stable")[:k]]
        else:
            at = at[np.argsort(-scores[at], kind="stable")]
        out.append((ids[at], [str(x) for x in scores[at]]))
    n = [len(o[0]) for o in out]
    return pa.table([np.repeat(own, n), np.repeat(queries["q"].to_numpy(), n), np.concatenate([o[0] for o in out]), [x for o in out for x in o[1]], np.full(sum(n), block, np.int32)], schema=RESULT)


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, block: int = BLOCK, round_: int = ROUND) -> DataFrame:
    """(query_id, rank, vec_id, score) over (vec_id long, v array<long>); ``is_query`` marks queries."""
    bounded_batches(vectors.sparkSession)
    vectors = vectors.filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    # an empty vector counts as one component
    width = F.greatest(F.size("v"), F.lit(1)).cast("long")
    sizes = vectors.agg(F.coalesce(F.sum(width), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(is_query, width)), F.lit(0)).alias("q")).first()
    blocks, rounds = (max(1, -(-int(n) // size)) for n, size in ((sizes.n, block), (sizes.q, round_)))

    def dealt(key: str, other: str, n: int, others: int) -> list[Column]:
        each = F.explode(F.sequence(F.lit(0), F.lit(others - 1))) if others > 1 else F.lit(0)
        return [F.pmod(F.xxhash64("vec_id", "v"), F.lit(n)).cast("int").alias(key), each.alias(other)]

    candidates = vectors.groupBy("vec_id", "v").agg(F.count("*").alias("copies")).select("vec_id", "v", "copies", *dealt("block", "round", blocks, rounds))
    queries = vectors.filter(is_query).distinct().select(F.col("vec_id").alias("query_id"), F.col("v").alias("w"), F.xxhash64("v").alias("q"), *dealt("round", "block", rounds, blocks))

    def scored(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        return score_block(left, right, k, key[0].as_py())

    found = candidates.groupBy("block", "round").cogroup(queries.groupBy("block", "round")).applyInArrow(scored, "query_id long, q long, vec_id long, score string, block int")
    found = found.withColumn("score", F.col("score").cast("decimal(38,0)"))
    best = [F.col("score").desc(), F.col("vec_id")]
    some = F.row_number().over(Window.partitionBy("query_id", "q", F.floor(F.col("block") / MERGE)).orderBy(*best))
    found = found.withColumn("rank", some).filter(F.col("rank") <= k)
    rank = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(*best))
    ranked = found.withColumn("rank", rank).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", F.col("score").try_cast("long").alias("score"))
