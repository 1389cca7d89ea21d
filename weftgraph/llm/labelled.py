"""A bounded, documented sample of labelled texts for fitting classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows that a classifier is fitted on at most; scoring covers all rows.
FIT_ROWS = 6000


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, limit: int = FIT_ROWS) -> DataFrame:
    """(doc_id, text, label) of at most ``limit`` labelled ids in the order of a hash of the id.

    Only 0 and 1 count as labels; an id labelled both ways counts as 1.  The
    ids are bounded by ``limit``, so they can be broadcast.  Of several rows of
    one id that with the least hash of its text is taken, so rows are bounded too.
    """
    ids = (
        labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & learn)
        .groupBy("doc_id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(limit)
    )
    found = docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")
    return found.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.min("label").alias("label"))


def array_rows(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column as views of its flat values; no Python object stands for a value."""
    out: list[np.ndarray] = []
    for chunk in column.chunks:
        ends, flat = chunk.offsets.to_numpy(), chunk.values.to_numpy()
        out += [flat[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return out
