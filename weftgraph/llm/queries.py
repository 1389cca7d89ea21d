"""The queries opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, jaccard, language, lm, pieces, quality, tokenfile, topk, toxicity
from .columns import held_out

#: Decision thresholds of the classifiers.
TOXIC_AT, GOOD_AT = 0.3, 0.7


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """The place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out(F.col("doc_id"), 7, 2)
    scores = lm.score_documents(table(spark, sf_dir, "documents"), ~out, vocabulary("byte_bpe_50k.tiktoken"))
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    model = toxicity.fit_toxicity(docs, labels, ~out)
    scores = toxicity.toxicity_scores(docs, model)
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= TOXIC_AT).cast("int").alias("predicted"))


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digests(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), topk.quantised(F.col("embedding")).alias("v"))
    return topk.top_k(vectors, F.col("vec_id") % 50 == 0, 5)


OP5_SQL = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as w from embeddings
  where embedding is not null and list_count(embedding) = len(embedding)
    and len(list_filter(embedding, lambda x: not isfinite(x::double))) = 0),
terms as (select vec_id, unnest(range(len(w))) as term, unnest(w) as weight from v),
scores as (
  select q.vec_id as query_id, c.vec_id, sum(q.weight * c.weight)::bigint as score
  from terms q join terms c on q.term = c.term and q.vec_id <> c.vec_id
  where q.vec_id % 50 = 0 group by all),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scores)
select query_id, rank, vec_id, score from ranked where rank <= 5
"""

#: Conversation -1 says this in both turns.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(CONTROL))
    chats = chat.format_chats(turns.union(own))
    out = chats.select("conv_id", chat.formatted(F.col("segments")).alias("formatted"), F.array_join(chat.loss_texts(F.col("segments")), "").alias("loss"))
    out = out.withColumn("turns", chat.read_turns(F.col("formatted")))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP6_SQL = r"""
with rows as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  union all select -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'),
marked as (
  select *, lag(role) over (partition by conv_id order by turn nulls first, role, text) as before,
    length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g')) as text_chars, length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) as role_chars from rows)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
  sum(text_chars + case when before = role then length('<|im_part|>') else role_chars + length('<|im_start|><|im_sep|><|im_end|>') + 1 end)::bigint as formatted_chars
from marked group by conv_id
"""


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = held_out(F.col("doc_id"), 4, 2)
    model = quality.fit_quality(docs, labels, ~out)
    scores = quality.quality_scores(docs, model)
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= GOOD_AT).cast("int").alias("predicted"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out(F.col("doc_id"), 5, 0)
    model = language.fit_languages(docs, ~out)
    return language.predict_languages(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_files(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), 2)


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_score, op2_decontaminate, op3_toxicity, op4_pieces, op5_topk, op6_chat, op7_quality, op8_language, op9_token_file, op10_jaccard)}


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": OP5_SQL, "op6_chat": OP6_SQL}
