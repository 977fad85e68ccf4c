"""A corpus pipeline of five stages; each works on all rows that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import decontaminate, near_dedup, pii, quality, wfst
from corpusloom.llm.common import materialize, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier scores 0.7 or more; it learns from the labelled rows outside the held-out fold."""
    labels = table(spark, sf_dir, "labels").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    model = quality.train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return quality.keep_good(docs, model)


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of documents whose sets of five-word shingles are 0.8 alike or more."""
    return near_dedup.deduplicate(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that are not contaminated by the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data replaced by its kind; n_chars is that of the new text."""
    return pii.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids of the text and their number."""
    out = wfst.encode(docs.select("doc_id", "lang", "source", "text"), MODEL)
    return out.select("doc_id", "lang", "source", "ids", F.size("ids").alias("n_tokens"))


STAGES = [
    ("quality classifier", good_quality),
    ("MinHash near-dedup", without_near_duplicates),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("SentencePiece encoding", tokenized),
]

#: The first stage is a trained network, which SQL can't express; the tests hold the stages' operators against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
