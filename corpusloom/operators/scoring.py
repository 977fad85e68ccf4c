"""Scores of benchmark predictions, one row per sampled answer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def benchmark_scores(answers: DataFrame, truncated_counts: bool = False) -> DataFrame:
    """Per benchmark (benchmark, question_id, predicted, correct, finish_reason): accuracy, or its mean over k samples.

    A match that was cut off scores only with ``truncated_counts``. Wrong, unparsed and runaway answers are counted
    apart and may overlap.
    """
    matched = F.coalesce(F.col("predicted") == F.col("correct"), F.lit(False))
    cut = F.coalesce(F.col("finish_reason") == "length", F.lit(False))
    good = matched if truncated_counts else matched & ~cut
    per = answers.select("benchmark", "question_id", good.cast("double").alias("g"), (~matched & F.col("predicted").isNotNull()).cast("long").alias("w"), F.col("predicted").isNull().cast("long").alias("u"), cut.cast("long").alias("c"))
    q = per.groupBy("benchmark", "question_id").agg(F.avg("g").alias("g"), F.count("*").alias("k"), F.sum("w").alias("w"), F.sum("u").alias("u"), F.sum("c").alias("c"))
    return q.groupBy("benchmark").agg(F.count("*").alias("questions"), F.min("k").alias("least_k"), F.max("k").alias("most_k"), F.round(F.avg("g"), 6).alias("score"), F.sum("w").alias("wrong"), F.sum("u").alias("parse_failures"), F.sum("c").alias("runaway"))


def macro_average(scores: DataFrame, expected: list[str]) -> DataFrame:
    """Mean of the benchmark scores, and those of the expected ones that are missing."""
    have = scores.agg(F.round(F.avg("score"), 6).alias("primary"), F.collect_set("benchmark").alias("have"))
    return have.select("primary", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, expected)), "have")), ",").alias("missing"))


def native_scale_mean(rows: DataFrame, top: dict[str, float]) -> DataFrame:
    """Per benchmark the mean of valid scores within 0 and its top, the same at scale 1, and how many were invalid."""
    most = F.element_at(F.create_map(*[F.lit(x) for kv in top.items() for x in kv]), F.col("benchmark"))
    good = F.col("score").isNotNull() & ~F.isnan("score") & F.col("score").between(0, most)
    kept = F.when(good, F.col("score"))
    return rows.groupBy("benchmark").agg(F.round(F.avg(kept), 6).alias("mean"), F.round(F.avg(kept / most), 6).alias("normalized"), F.sum((~good).cast("long")).alias("invalid"))


def grouped_accuracy(rows: DataFrame, facets: list[str], good: Column) -> DataFrame:
    """Accuracy overall and by each facet alone; nulls of a facet are ``unknown``."""
    named = F.array(F.struct(F.lit("overall").alias("facet"), F.lit("all").alias("value")), *[F.struct(F.lit(f).alias("facet"), F.coalesce(F.col(f).cast("string"), F.lit("unknown")).alias("value")) for f in facets])
    flat = rows.select(good.cast("double").alias("g"), F.explode(named).alias("x"))
    return flat.groupBy("x.facet", "x.value").agg(F.count("*").alias("n"), F.round(F.avg("g"), 6).alias("accuracy"))


def latest(rows: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last row of each key."""
    return rows.groupBy(*key).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in key]), F.struct(*order)).alias("r")).select(*key, "r.*")


def majority_votes(samples: DataFrame) -> DataFrame:
    """Per question (question, sample, answer, good): the commonest answer, first seen on ties, pass@n, avg@n and the share of samples with an answer.

    Null and blank answers don't vote; without any vote the majority is null and not good.
    """
    said = F.trim(F.col("answer")) != ""
    votes = samples.where(said).groupBy("question", "answer").agg(F.count("*").alias("n"), F.min("sample").alias("first"), F.max("good").alias("good"))
    best = votes.groupBy("question").agg(F.min_by(F.struct("answer", "good"), F.struct(-F.col("n"), "first", "answer")).alias("b"))
    whole = samples.groupBy("question").agg(F.count("*").alias("samples"), F.max("good").alias("pass_n"), F.round(F.avg(F.col("good").cast("double")), 6).alias("avg_n"), F.round(F.avg(F.coalesce(said, F.lit(False)).cast("double")), 6).alias("format_rate"))
    return whole.join(best, "question", "left").select("question", "samples", "pass_n", "avg_n", "format_rate", F.col("b.answer").alias("majority"), F.coalesce("b.good", F.lit(False)).alias("majority_good"))


def sampled_summary(samples: DataFrame, metric: str, max_tokens: int) -> DataFrame:
    """One row for samples (question, sample from 0, parsed, good, finish_reason, tokens): score by ``metric`` and the failures by kind.

    accuracy looks at the first sample of each question, pass at whether any is good (a failure is judged by the first
    sample), avg at all samples. A failure is runaway if it was cut off or didn't stop, else unparsed, else wrong.
    """
    if metric not in ("accuracy", "pass", "avg"):
        raise ValueError(f"unsupported metric {metric!r}")
    reason = F.coalesce("finish_reason", F.lit(""))
    cut = (reason == "length") | F.coalesce(F.col("tokens") >= max_tokens - 1, F.lit(False))
    kind = F.when(cut | ~reason.isin("", "stop"), "runaway").when(F.coalesce(F.trim("parsed") == "", F.lit(True)), "parse_failure").otherwise("wrong_answer")
    rows = samples.select("question", "sample", F.coalesce("good", F.lit(False)).alias("good"), kind.alias("kind"))
    if metric != "avg":
        good = F.max("good") if metric == "pass" else F.max_by("good", -F.col("sample"))
        rows = rows.groupBy("question").agg(good.alias("good"), F.max_by("kind", -F.col("sample")).alias("kind"))
    count = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0))
    figures = [count(~F.col("good") & (F.col("kind") == k)).alias(f"{k}_count") for k in ("wrong_answer", "parse_failure", "runaway")]
    return rows.agg(F.round(F.avg(F.col("good").cast("double")), 6).alias("score"), count(F.col("good")).alias("correct_count"), F.count("*").alias("total_count"), *figures)


def score_deltas(history: DataFrame) -> DataFrame:
    """(benchmark, step, score): change against the step before and against the first step."""
    from pyspark.sql import Window

    by = Window.partitionBy("benchmark").orderBy("step")
    return history.select("benchmark", "step", "score", F.round(F.col("score") - F.lag("score").over(by), 6).alias("from_previous"), F.round(F.col("score") - F.first("score").over(by), 6).alias("from_first"))
