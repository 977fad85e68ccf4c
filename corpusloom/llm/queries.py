"""The operators of this subpackage as queries over the driver's tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import ann, collocations, decontaminate, fill_in_middle, html_extract, language_id, line_dedup, lm_score, near_dedup, oracles, pii, quality, substring_dedup, wfst
from corpusloom.llm.common import table

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_match", "match_start", "match_item")


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = quality.train(docs, labels.where(~held_out).select("doc_id", F.col("quality").alias("label")))
    scored = quality.score(docs, model).withColumn("held_out", held_out)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_report(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.crc32(F.col("doc_id").cast("string")) % 5 == 1)
    scores = lm_score.score(docs, held_out_col="held_out")
    return scores.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wfst.round_trip(table(spark, sf_dir, "documents"), TOKENIZER)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)


def op7_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs)
    return language_id.identify(table(spark, sf_dir, "pages"), model)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.spans_report(table(spark, sf_dir, "documents"))


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.report(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline  # noqa: F401  part of this subpackage, although it lies at the top

    ops = (op1_decontaminate, op2_quality, op3_substring_dedup, op4_lm_score, op5_sentencepiece, op6_near_duplicates, op7_html_extract, op8_language_id, op9_pii, op10_nearest)
    new = (op11_line_dedup, op12_fill_in_middle, op13_collocations)
    return {f.__name__: f for f in (*ops, *new, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_decontaminate": oracles.DECONTAMINATE,
        "op3_substring_dedup": oracles.SUBSTRING_DEDUP,
        "op6_near_duplicates": oracles.NEAR_DUPLICATES,
        "op11_line_dedup": oracles.LINE_DEDUP,
        "op12_fill_in_middle": oracles.FILL_IN_MIDDLE,
        "op13_collocations": oracles.COLLOCATIONS,
    }
