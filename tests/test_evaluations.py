"""Evaluations on literals and odd rows."""

from pyspark.sql import functions as F

from corpusloom.operators import evaluations as E
from corpusloom.operators import ledger


def test_usage(spark):
    counts = ", ".join(f"{c} long" for c in E.COUNTS)
    none = (None,) * len(E.COUNTS)
    rows = [("a", None, None, None, None, *none), ("a", True, "exact", 0.25, {"total_tokens": 4, "other": 9}, 1, 2, 3, 4, 0, 6), ("b", True, None, 1.0, {}, *none)]
    batches = spark.createDataFrame(rows, f"model string, cache_hit boolean, usage_status string, wall_time_seconds double, tokens map<string,long>, {counts}")
    models = spark.createDataFrame([("a",), ("b",), ("c",), ("c",)], "model string")
    got = {r.model: (r.batch_count, r.cache_hit_count, r.failure_count, r.total_tokens, r.wall_time_seconds, r.usage_status) for r in E.embedding_totals(batches, models, "model").collect()}
    assert got == {"a": (2, 1, 4, 4, 0.25, "exact"), "b": (1, 1, 0, 0, 1.0, "cache_only"), "c": (0, 0, 0, 0, 0.0, "not_requested")}


def test_runs(spark):
    schema = "run string, bucket string, pooled boolean, verified boolean, backend string, fingerprint string"
    rows = [("r", "too_easy", True, True, "api:m", "f"), ("r", None, None, None, None, None), ("r", "frontier", True, None, "m", "f"), ("s", "frontier", True, True, "n", ""), ("t", "other", False, True, None, None)]
    bad = spark.createDataFrame([("s",)], "run string")
    got = {r.run: r for r in E.run_reports(spark.createDataFrame(rows, schema), bad).collect()}
    r, s, t = got["r"], got["s"], got["t"]
    assert (r.accepted, r.verified, r.too_easy_rate, r.eligible) == (2, 1, 0.5, True)
    assert (s.failures, s.no_run_failures, s.lineage_complete, s.eligible) == (1, False, False, False)
    assert (t.too_easy_rate, t.evaluation_model_fixed, t.lineage_complete) == (None, False, True)
    assert {r.run: r.eligible for r in E.run_reports(spark.createDataFrame(rows, schema), bad, "x").collect()} == {"r": False, "s": False, "t": False}
    said = spark.createDataFrame([(True, 2, 1), (True, 1, 1), (None, 9, 1), (True, 1, None)], "e boolean, c long, b long").select(E.decision(F.col("e"), F.col("c"), F.col("b")).alias("d")).collect()
    assert [r.d[0] for r in said] == ["accept", "reject", "reject", "accept"]


def test_samples(spark):
    rows = [(1, 1, "x", [True], ["a"]), (1, 2, "x", [None, False], ["", "b"]), (2, 1, "x", [False, True], ["a", ""]), (3, 1, None, [], [])]
    samples = spark.createDataFrame(rows, "id long, at int, type string, scores array<boolean>, predictions array<string>")
    assert E.sample_counts(samples).first()[:] == (3, 4, 1, 2)
    assert E.type_accuracies(samples).collect() == [("x", 2, 50.0)]
    assert E.sample_counts(samples.limit(0)).first()[:] == (0, 0, 0, 0)


def test_plans(spark):
    signals = spark.createDataFrame([("t", None, "too_easy", 2), ("t", "op", "answer_leak", None), ("generic", "", "distractor_leak", 5), (None, "z", "never heard", 9)], "task_type string, operator string, reason string, count long")
    got = [(r.number, r.action, r.task_type, r.source) for r in E.migration_plan(signals, "p@1", "g", ("prompt",)).collect()]
    assert got == [(1, "replace_or_insert", "generic", "task-specific stage"), (2, "fork_pipeline", "t", "p@1"), (3, "replace_or_insert", "t", "task-specific stage"), (4, "update_task_contract", "t", "op")]
    quiet = signals.where("reason = 'distractor_leak'")
    assert [r.action for r in E.migration_plan(quiet, "p@1", "g", ("prompt",)).orderBy("number").collect()] == ["replace_or_insert", "explore_structure"]
    assert [r.action for r in E.migration_plan(quiet, "p@1", "g", ("prompt", "operator")).collect()] == ["replace_or_insert"]
    assert E.migration_plan(signals.limit(0), "p@1", "g").count() == 0


def test_digests(spark):
    schema = "batch string, id long, calls long, score double, settled boolean, good boolean, valid boolean, outcomes array<string>, state string"
    rows = [("b1", 1, 2, 1.0, True, True, None, ["x", "y"], " s "), ("b1", 2, None, None, None, True, False, ["x"], ""), ("b2", 3, 1, 2.0, True, None, False, ["x"], None), ("b2", 4, 1, None, True, False, True, None, "t"), ("b3", 5, 1, 4.0, True, False, True, ["x"], "u")]
    cards = spark.createDataFrame(rows, schema)
    digests = ledger.batch_digests(cards)
    got = {r.batch: (r.samples, r.api_calls, r.settled, r.accepted, r.gate_rejects, r.axis_failures) for r in digests.collect()}
    assert got == {"b1": (2, 2, 1, 1, 0, {"x": 1, "y": 1}), "b2": (2, 2, 2, 0, 1, {"x": 1}), "b3": (1, 1, 1, 0, 0, {"x": 1})}
    assert ledger.batch_digests(cards, digests).count() == 0
    assert {r.axis: r[1:] for r in ledger.failure_table(cards, 2).collect()} == {"x": (3, 3, 2.33, [1, 5]), "y": (1, 1, 1.0, [1])}
    assert [r.state for r in ledger.newest_states(cards, 2).collect()] == ["u", "t"]
