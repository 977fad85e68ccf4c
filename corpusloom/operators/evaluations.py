"""Evaluations of runs and datasets, usage of embeddings, pairs of edits and scenes, and plans for what to change next."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Difficulty buckets, counts of a batch, and what each reason of failure asks for: action, target, capability, and whether the graph changes.
BUCKETS = ("too_easy", "hard_review_required", "frontier")
COUNTS = ("item_count", "request_count", "success_count", "failure_count", "missing_usage_count", "exact_usage_count")
TOKENS = ("input_tokens", "output_tokens", "total_tokens", "cached_input_tokens", "cache_creation_input_tokens", "reasoning_tokens")
LINKED = ("replace_or_insert", "multi_observation_evidence_selector", "cross_time_grounding", True)
VALIDATED = ("replace_or_insert", "task_evidence_validator", "evidence_validation", True)
TIGHTENED = ("update_task_contract", "TaskSpec", None, False)
INDEPENDENT = ("replace_or_insert", "task_distractor_generator", "option_independence", False)
ACTIONS = {
    "too_easy": LINKED, "question_too_local": LINKED, "insufficient_evidence": VALIDATED, "cannot_determine": VALIDATED, "identity_failure": VALIDATED,
    "answer_ambiguity": TIGHTENED, "answer_leak": TIGHTENED, "distractor_invalid": INDEPENDENT, "distractor_leak": INDEPENDENT,
}


def embedding_totals(batches: DataFrame, models: DataFrame, model: str) -> DataFrame:
    """A row for each of the models: batches, cache hits, counts, tokens, wall time and how exact they are.

    Batches have the counts, cache_hit, usage_status, wall_time_seconds and tokens (a map); null counts are 0. A model
    without a batch was not requested.
    """
    zero = lambda c, kind: F.coalesce(F.sum(c.cast(kind)), F.lit(0).cast(kind))
    hit, gone = F.coalesce("cache_hit", F.lit(False)), F.coalesce(F.col("usage_status") == "unavailable", F.lit(False))
    sums = batches.groupBy(model).agg(
        F.count("*").alias("batch_count"), F.count_if(hit).alias("cache_hit_count"), *[zero(F.col(c), "long").alias(c) for c in COUNTS], *[zero(F.col("tokens")[t], "long").alias(t) for t in TOKENS],
        F.round(zero(F.col("wall_time_seconds"), "double"), 6).alias("wall_time_seconds"), F.count_if(gone).alias("unavailable_batch_count"),
    )
    figures = ["batch_count", "cache_hit_count", *COUNTS, *TOKENS, "wall_time_seconds", "unavailable_batch_count"]
    rows = models.select(model).distinct().join(sums, model, "left").fillna(0, figures)
    status = (
        F.when(F.col("batch_count") == 0, "not_requested").when(F.col("cache_hit_count") == F.col("batch_count"), "cache_only").when(F.col("unavailable_batch_count") > 0, "unavailable")
        .when(F.col("missing_usage_count") > 0, "partial").otherwise("exact")
    )
    return rows.select(model, *figures, status.alias("usage_status"))


def run_reports(candidates: DataFrame, failures: DataFrame, expected_model: str | None = None) -> DataFrame:
    """A row a run of its candidates (run, bucket, pooled, verified, backend, fingerprint) and failed records (run).

    accepted, verified, the difficulty mix over all candidates with a known bucket, too_easy_rate, and the gates: one
    fixed model (the expected one, if any), no fallback to text, no failures, a fingerprint for all accepted ones.
    """
    pooled = F.coalesce("pooled", F.lit(False))
    named = F.nullif(F.regexp_replace(F.coalesce("backend", F.lit("")), "^api:", ""), F.lit(""))
    counts = [F.count_if(F.coalesce(F.col("bucket") == b, F.lit(False))).alias(b) for b in BUCKETS]
    rows = candidates.groupBy("run").agg(
        F.count_if(pooled).alias("accepted"), F.count_if(pooled & F.coalesce("verified", F.lit(False))).alias("verified"), *counts, F.count_distinct(named).alias("models"), F.min(named).alias("model"),
        F.coalesce(~F.bool_or(F.endswith(named, F.lit(":text-fallback"))), F.lit(True)).alias("no_text_fallback"), F.coalesce(F.bool_and(F.when(pooled, F.coalesce(F.col("fingerprint") != "", F.lit(False)))), F.lit(True)).alias("lineage_complete"),
    )
    failed = failures.groupBy("run").agg(F.count("*").alias("failures"))
    rows = rows.join(failed, "run", "left").withColumn("failures", F.coalesce("failures", F.lit(0)))
    total = sum((F.col(b) for b in BUCKETS), F.lit(0))
    fixed = (F.col("models") == 1) if expected_model is None else (F.col("models") == 1) & (F.col("model") == expected_model)
    rows = rows.withColumn("too_easy_rate", F.round(F.when(total > 0, F.col("too_easy") / total), 6)).withColumn("evaluation_model_fixed", F.coalesce(fixed, F.lit(False))).withColumn("no_run_failures", F.col("failures") == 0)
    gates = [F.col(g) for g in ("evaluation_model_fixed", "no_text_fallback", "no_run_failures", "lineage_complete")]
    return rows.select("run", "accepted", "verified", *BUCKETS, "too_easy_rate", "failures", *gates, (gates[0] & gates[1] & gates[2] & gates[3]).alias("eligible"))


def decision(eligible: Column, candidate: Column, baseline: Column) -> Column:
    """struct(decision, reason): accepted only with all gates and strictly more accepted records than the baseline; the difficulty mix decides nothing."""
    eligible, better = F.coalesce(eligible, F.lit(False)), F.coalesce(candidate, F.lit(0)) > F.coalesce(baseline, F.lit(0))
    reason = F.when(~eligible, "hard_gate_failed").when(better, "primary_metric_increased").otherwise("primary_metric_not_strictly_increased")
    return F.struct(F.when(eligible & better, "accept").otherwise("reject").alias("decision"), reason.alias("reason"))


def sample_counts(samples: DataFrame) -> DataFrame:
    """One row of samples (id, type, predictions, scores): num_samples, num_scores, timeout_samples, empty_samples.

    Of samples with one id the last by ``at`` counts. A null score timed out; a sample is empty if its last prediction is blank.
    """
    rows = _latest(samples)
    last = F.coalesce(F.try_element_at("predictions", F.lit(-1)), F.lit(""))
    timed_out = F.size(F.filter("scores", lambda s: s.isNull()))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return rows.agg(F.count("*").alias("num_samples"), total(F.size("scores").cast("long")).alias("num_scores"), total(timed_out.cast("long")).alias("timeout_samples"), total((last == "").cast("long")).alias("empty_samples"))


def _latest(samples: DataFrame) -> DataFrame:
    columns = [c for c in samples.columns if c not in ("id", "at")]
    return samples.groupBy("id").agg(F.max_by(F.struct(*columns), "at").alias("s")).select("id", "s.*")


def type_accuracies(samples: DataFrame) -> DataFrame:
    """(type, n, accuracy): the share of last scores that are true, in per cent to one place, half to even; timed out is false."""
    rows = _latest(samples).where(F.size("scores") > 0)
    right = F.coalesce(F.element_at("scores", -1), F.lit(False)).cast("int")
    return rows.groupBy("type").agg(F.count("*").alias("n"), F.bround(F.avg(right) * 100, 1).alias("accuracy"))


def compatible_pairs(edits: DataFrame, allowed: DataFrame, scenes: DataFrame) -> DataFrame:
    """Pairs of edits (ref, edit_id, ...) and scenes (ref, scene_id, ...) that a compatibility (edit_ref, allowed_scene_refs) allows.

    A reference to an edit or a scene that is not there is passed over; all other columns of both sides come along.
    """
    asked = allowed.select("edit_ref", F.explode("allowed_scene_refs").alias("scene_ref"))
    return asked.join(edits.withColumnRenamed("ref", "edit_ref"), "edit_ref").join(scenes.withColumnRenamed("ref", "scene_ref"), "scene_ref")


def migration_plan(signals: DataFrame, source: str, task: str, scopes: tuple[str, ...] = ()) -> DataFrame:
    """(number, action, task_type, target, source, required, structural) from failures (task_type, operator, reason, count).

    A task with two failures or more gets a pipeline of its own; each known reason asks for its action. Where nothing
    changes the graph, and only wording (``prompt`` or ``task_spec``) changed before, a new structure is asked for.
    """
    rows = signals.withColumn("task_type", F.coalesce("task_type", F.lit("generic"))).withColumn("count", F.coalesce("count", F.lit(1)))
    totals = rows.groupBy("task_type").agg(F.sum(F.greatest("count", F.lit(1))).alias("total")).where((F.col("task_type") != "generic") & (F.col("total") >= 2))
    none = F.lit(None).cast("string")
    forks = totals.select("task_type", F.lit(0).alias("stage"), F.lit(0).cast("long").alias("less"), F.lit("").alias("reason"), F.lit("fork_pipeline").alias("action"), F.concat("task_type", F.lit("_pipeline_next")).alias("target"), F.lit(source).alias("source"), none.alias("required"), F.lit(True).alias("structural"))
    known = F.create_map(*[x for reason, (action, target, need, graph) in ACTIONS.items() for x in (F.lit(reason), F.struct(F.lit(action).alias("action"), F.lit(target).alias("target"), F.lit(need).cast("string").alias("required"), F.lit(graph).alias("structural")))])
    asked = rows.withColumn("a", known[F.col("reason")]).where("a is not null")
    steps = asked.select("task_type", F.lit(1).alias("stage"), (-F.col("count")).cast("long").alias("less"), "reason", "a.action", "a.target", F.coalesce(F.nullif("operator", F.lit("")), F.lit("task-specific stage")).alias("source"), "a.required", "a.structural")
    plan = forks.unionByName(steps)
    if not {"pipeline_graph", "operator"} & set(scopes) and {"prompt", "task_spec"} & set(scopes):
        spark = signals.sparkSession
        more = spark.createDataFrame([(task, 2, 0, "", "explore_structure", "new_task_specific_pipeline", source, None, True)], plan.schema)
        structural = plan.agg(F.coalesce(F.bool_or("structural"), F.lit(False)).alias("any"))  # one row
        plan = plan.unionByName(more.join(structural.where("not any"), how="left_semi"))
    order = Window.orderBy(F.col("stage") == 2, "task_type", "stage", "less", "reason", "source")  # a row a failure of a round
    return plan.select(F.row_number().over(order).alias("number"), "action", "task_type", "target", "source", "required", "structural")
