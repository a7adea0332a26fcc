"""A corpus pipeline: quality, exact dedup, near-dedup, mixing, tokens.

Defined results, in all stages: a null text counts as empty; rows with a null
doc_id are documents like others, but are never near copies; of equal texts,
repeated rows among them, one row stays, and near copies leave with their
group's smallest doc_id staying; columns beside doc_id, text, lang and source
are kept whatever their names, and new ones get underscores in front of a name
that is taken. An empty table gives an empty result, and without labels no
document is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.llm import exact_lsm, minhash_bayes, mixing, quality_mil, sentencepiece_trie
from cairn.llm.common import fresh, remainder, table, temporary_tables, written

#: What a worker remembers of words and pairs of pieces: less than in a query of its own, and nothing after a task, as other stages need an executor's memory too.
WORD_BYTES, PAIR_BYTES = 16 << 20, 8 << 20


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't reject."""
    model = quality_mil.fit(docs, table(spark, sf_dir, "labels"), remainder(F.col("doc_id"), 5) != 0)
    score = fresh(docs, "score")
    return quality_mil.scored(docs, model, name=score).where(F.col(score) >= quality_mil.THRESHOLD).drop(score)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each set of equal ones."""
    return exact_lsm.kept_documents(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return minhash_bayes.kept_documents(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents dealt by source to the target weights; one that is taken twice is there twice."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with token ids in place of text, checked by decoding; other columns stay."""
    return sentencepiece_trie.encoded(docs, word_bytes=WORD_BYTES, pair_bytes=PAIR_BYTES, keep_model=False)


STAGES = [("quality classifier", quality), ("exact dedup", exact), ("MinHash near-dedup", near), ("mixing", mix), ("SentencePiece", tokens)]

#: The stages of trained weights, signatures and merges have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written before the next reads it; what a stage needed besides is deleted when it is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with temporary_tables(spark):
            docs = written(stage(spark, docs, sf_dir), "stage-" + name.split()[0].lower(), keep=True)
    return STAGES[-1][1](spark, docs, sf_dir)
