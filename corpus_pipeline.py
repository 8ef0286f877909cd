"""From raw documents to token ids: five stages, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textveil.llm import jaccard, mixing, pii, sentencepiece, toxicity
from textveil.llm.common import table, written


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model doesn't reject; it learns from this stage's rows and the labels of its training fold."""
    return toxicity.reject(docs, toxicity.fitted(spark, docs, sf_dir))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, that with the smallest id."""
    return jaccard.deduplicate(docs)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their personal data replaced by its kind; n_chars follows."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.take(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_pieces, piece_ids) of each row."""
    out = sentencepiece.encode(docs, sentencepiece.model_bytes(), keep=("doc_id", "source"), decoded=False)
    return out.withColumn("n_pieces", F.when(F.col("piece_ids").isNull(), 0).otherwise(F.size("piece_ids")).cast("long"))


STAGES = [
    ("toxicity", without_toxic),
    ("ngram_jaccard", one_of_each),
    ("pii", without_personal_data),
    ("mixing", mixed),
    ("sentencepiece", tokens),
]

#: SQL can't express the learnt and the tokenising stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents; each result is written to the shared folder and read again.

    Rows with null ids, texts or sources go through: a null text is not toxic, has no near duplicates and nothing to redact, counts
    no words, and has no ids. Texts of any length are taken whole. Of repeated rows one stays; of rows that share an id only, the one
    with the smallest text. An empty table gives an empty one. Further columns, whatever their names, pass through all
    stages but the last, which returns (doc_id, source, piece_ids, n_pieces).
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
