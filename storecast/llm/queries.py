"""Queries of the training-data operators: one ``opN_<name>`` each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storecast.llm import alignment, chat, decontaminate, embeddings, lm, minhash, packing, pages, pieces, pii, quality, repair, toxicity
from storecast.llm.common import fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query("op5_quality_divergence")
def op5_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        F.round("char_distance", 6).alias("char_distance"), F.round("word_distance", 6).alias("word_distance"))


@query("op8_pii_checksums")
def op8_pii_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(table(spark, sf_dir, "documents"))


@query("op10_bin_slack_packing")
def op10_bin_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query("op7_toxicity_cnn")
def op7_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, learn=fold(F.col("doc_id"), 5) != 0)
    scored = toxicity.score_documents(docs, model, lang_col="lang")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "flagged")


@query("op1_minhash_icws")
def op1_minhash_icws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_embedding_range_join")
def op3_embedding_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


@query("op4_context_tree_weighting")
def op4_context_tree_weighting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query("op2_page_differencing")
def op2_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract_text(table(spark, sf_dir, "pages"))


@query("op6_snapshot_collapse", """
WITH placed AS (
  SELECT conv_id, role, text,
         ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS pos,
         COUNT(*) OVER (PARTITION BY conv_id) AS n
  FROM conversations),
upto AS (
  SELECT conv_id, pos, n,
         LIST({'role': role, 'text': text}) OVER (PARTITION BY conv_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS prefix
  FROM placed),
whole AS (
  SELECT MIN(conv_id) AS conv_id, n, prefix, COUNT(*) AS n_copies FROM upto WHERE pos = n GROUP BY n, prefix),
maximal AS (
  SELECT conv_id, n, n_copies FROM whole WHERE prefix NOT IN (SELECT prefix FROM upto WHERE pos < n))
SELECT m.conv_id, m.n AS n_turns, m.n_copies,
       STRING_AGG('<|im_start|>' || COALESCE(p.role, 'user') || CHR(10) || COALESCE(p.text, '') || '<|im_end|>' || CHR(10), '' ORDER BY p.pos) AS rendered
FROM maximal m JOIN placed p ON p.conv_id = m.conv_id
GROUP BY m.conv_id, m.n, m.n_copies
""")
def op6_snapshot_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_chats(table(spark, sf_dir, "conversations"))


@query("op9_sentencepiece_viterbi")
def op9_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pieces.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query("op11_conversation_repair")
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repair.damaged(table(spark, sf_dir, "conversations"))
    return repair.repair_conversations(turns, present=F.col("present"))


@query("op12_positional_decontamination")
def op12_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), near=decontaminate.NEAR)


@query("op13_asof_alignment")
def op13_asof_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return alignment.align_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
