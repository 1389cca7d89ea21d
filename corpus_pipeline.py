"""A corpus pipeline: five operators, each on what the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import decontaminate, jaccard, pieces, quality, toxicity
from weftgraph.llm.columns import held_out, scratch
from weftgraph.llm.queries import GOOD_AT, TOXIC_AT, table, vocabulary


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts, rows as they are.

    Null and empty texts score the bias; repeated rows all stay or all go; without
    labels of both kinds the prior decides for all; an empty table gives no rows.
    """
    model = quality.fit_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return quality.keep_quality(docs, model, GOOD_AT)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity scorer accepts, rows as they are.

    Null and empty texts score the bias; repeated rows all stay or all go; without
    labels of both kinds the prior decides for all; an empty table gives no rows.
    """
    model = toxicity.fit_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id"), 4, 2))
    return toxicity.drop_toxic(docs, model, TOXIC_AT)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: that with the smallest doc_id; of rows that share it, the least text.

    Documents without words link with nothing and stay, as do rows without doc_id; an empty table gives no rows.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    found = jaccard.jaccard_components(docs)
    gone = found.filter("component_id is not null and component_id <> doc_id").select("doc_id").distinct()
    lost, known = docs.filter("doc_id is null"), docs.filter("doc_id is not null")
    # rows of one doc_id are one document: keep the first of its texts, chosen by ids alone where nothing repeats
    repeated = known.groupBy("doc_id").count().filter("count > 1").select("doc_id")
    gone = F.broadcast(gone) if gone.count() <= jaccard.BROADCAST_ROWS else gone
    repeated = F.broadcast(repeated) if repeated.count() <= jaccard.BROADCAST_ROWS else repeated
    kept = known.join(gone, "doc_id", "left_anti")
    single = kept.join(repeated, "doc_id", "left_anti")
    least = F.min_by(F.struct(*columns), F.struct("text", F.xxhash64(*columns))).alias("row")
    several = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(least).select("row.*")
    return single.select(columns).union(several).union(lost)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, rows as they are.

    Null and empty texts hold none and stay; repeated rows all stay or all go;
    null items are passed over; without items all stay; an empty table gives no rows.
    """
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_pieces, pieces): the little-endian 32-bit ids of each row's text.

    Null and empty texts have none; repeated rows and null ids are kept; an
    empty table gives no rows.
    """
    encoded = pieces.encode_documents(docs.select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))
    return encoded.select("doc_id", (F.octet_length("pieces") / 4).cast("long").alias("n_pieces"), "pieces")


STAGES = [("quality", keep_good), ("toxicity", drop_toxic), ("near_duplicates", drop_copies), ("decontamination", drop_leaks), ("pieces", encode)]

#: Models and similarity joins aren't SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    folder = scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
