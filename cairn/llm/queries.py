"""One query for each operator, over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from cairn.llm import chat, exact_lsm, filter_audit, line_cuckoo, lm_bloom, minhash_bayes, mixing, quality_mil, quality_rules, sentencepiece_trie, simhash_mih, toxicity, whitening
from cairn.llm.common import remainder, table


def op1_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    scores = quality_mil.scored(docs, model, drop_text=True)
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= quality_mil.THRESHOLD).cast("int").alias("predicted"))


def op2_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_bayes.grouped(table(spark, sf_dir, "documents"), words=4)


def op3_line_cuckoo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cuckoo.deduped(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judged(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")


def op5_sentencepiece_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_trie.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = F.coalesce(remainder(F.col("doc_id"), 3) == 1, F.lit(False))
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 3) != 1)
    scores = toxicity.scored(docs, model, drop_text=True)
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_exact_lsm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_lsm.dedup(table(spark, sf_dir, "documents"))


def op8_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.collapsed(table(spark, sf_dir, "conversations"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selection(table(spark, sf_dir, "documents"))


def op10_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = F.coalesce(remainder(F.col("doc_id"), 7) == 2, F.lit(False))
    scores = lm_bloom.scored(docs, remainder(F.col("doc_id"), 7) != 2)
    return scores.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_simhash_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_mih.grouped(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_mil": op1_quality_mil,
    "op2_minhash_bayes": op2_minhash_bayes,
    "op3_line_cuckoo": op3_line_cuckoo,
    "op4_quality_rules": op4_quality_rules,
    "op5_sentencepiece_trie": op5_sentencepiece_trie,
    "op6_toxicity": op6_toxicity,
    "op7_exact_lsm": op7_exact_lsm,
    "op8_chat": op8_chat,
    "op9_mixing": op9_mixing,
    "op10_lm_bloom": op10_lm_bloom,
    "op11_filter_audit": op11_filter_audit,
    "op12_whitening": op12_whitening,
    "op13_simhash_mih": op13_simhash_mih,
}
ORACLE: dict[str, str] = {
    "op3_line_cuckoo": line_cuckoo.ORACLE,
    "op7_exact_lsm": r"""
WITH n AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM n WINDOW g AS (PARTITION BY text_sha256)
""",
    "op8_chat": chat.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op11_filter_audit": filter_audit.ORACLE,
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {**QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    sql = corpus_pipeline.ORACLE_SQL
    return {**ORACLE, **({"pipeline": sql} if sql else {})}
