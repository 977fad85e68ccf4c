"""Queries of evaluations, usage and plans of a round over the driver's tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import answers
from corpusloom.operators import evaluations, ledger
from corpusloom.plans.catalog import _t, query


@query("""WITH b AS (SELECT event_type AS model, user_id % 5 = 0 AS hit, CASE WHEN value < 1 THEN 'unavailable' WHEN user_id % 2 = 0 THEN 'exact' END AS status, user_id AS n, floor(value)::BIGINT AS w, value FROM events WHERE event_type <> 'error' AND (event_type <> 'view' OR user_id % 5 = 0)),
s AS (SELECT model, count(*) AS batch_count, count_if(hit) AS cache_hit_count, sum(n)::BIGINT AS item_count, sum(n + 1)::BIGINT AS request_count, sum(n)::BIGINT AS success_count, count(*)::BIGINT AS failure_count, sum(CASE WHEN model = 'click' THEN 0 ELSE w % 2 END)::BIGINT AS missing_usage_count,
0::BIGINT AS exact_usage_count, sum(n * 3)::BIGINT AS input_tokens, sum(CASE WHEN n % 3 = 0 THEN 0 ELSE n * 4 END)::BIGINT AS total_tokens, round(sum(w / 4), 6) AS wall_time_seconds, count_if(status = 'unavailable') AS unavailable_batch_count FROM b GROUP BY model),
m AS (SELECT DISTINCT event_type AS model FROM events)
SELECT m.model, coalesce(batch_count, 0) AS batch_count, coalesce(cache_hit_count, 0)::BIGINT AS cache_hit_count, coalesce(item_count, 0) AS item_count, coalesce(request_count, 0) AS request_count, coalesce(success_count, 0) AS success_count, coalesce(failure_count, 0) AS failure_count,
coalesce(missing_usage_count, 0) AS missing_usage_count, coalesce(exact_usage_count, 0) AS exact_usage_count, coalesce(input_tokens, 0) AS input_tokens, 0::BIGINT AS output_tokens, coalesce(total_tokens, 0) AS total_tokens, 0::BIGINT AS cached_input_tokens, 0::BIGINT AS cache_creation_input_tokens,
0::BIGINT AS reasoning_tokens, coalesce(wall_time_seconds, 0) AS wall_time_seconds, coalesce(unavailable_batch_count, 0)::BIGINT AS unavailable_batch_count,
CASE WHEN batch_count IS NULL THEN 'not_requested' WHEN batch_count = cache_hit_count THEN 'cache_only' WHEN unavailable_batch_count > 0 THEN 'unavailable' WHEN missing_usage_count > 0 THEN 'partial' ELSE 'exact' END AS usage_status FROM m LEFT JOIN s ON m.model = s.model""")
def embedding_totals(spark, sf_dir):
    """Event types as models, one of them without a batch and one whose batches all came from a cache."""
    events = _t(spark, sf_dir, "events").withColumn("model", F.col("event_type"))
    hit, n, w = F.col("user_id") % 5 == 0, F.col("user_id"), F.floor("value")
    tokens = F.create_map(F.lit("input_tokens"), (n * 3).cast("long"), F.lit("total_tokens"), F.when(n % 3 != 0, (n * 4).cast("long")))
    status = F.when(F.col("value") < 1, "unavailable").when(n % 2 == 0, "exact")
    batches = events.where((F.col("event_type") != "error") & ((F.col("event_type") != "view") | hit)).select(
        "model", F.when(hit, True).alias("cache_hit"), status.alias("usage_status"), n.alias("item_count"), (n + 1).alias("request_count"), n.alias("success_count"), F.lit(1).alias("failure_count"),
        F.when(F.col("model") != "click", w % 2).alias("missing_usage_count"), F.lit(None).cast("long").alias("exact_usage_count"), (w / 4).alias("wall_time_seconds"), tokens.alias("tokens"),
    )
    return evaluations.embedding_totals(batches, events, "model")


_RUNS = """SELECT o_orderpriority AS run, CASE o_custkey % 4 WHEN 0 THEN 'too_easy' WHEN 1 THEN 'frontier' WHEN 2 THEN 'hard_review_required' END AS bucket, o_totalprice > 200000 AS pooled, o_orderstatus = 'F' AS verified,
CASE WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'P' THEN 'api:m:text-fallback' WHEN o_custkey % 3 > 0 THEN 'api:m' END AS backend, CASE WHEN o_orderpriority <> '5-LOW' OR o_orderstatus <> 'O' THEN 'f' END AS fingerprint FROM orders"""
_REPORTS = f"""SELECT *, evaluation_model_fixed AND no_text_fallback AND no_run_failures AND lineage_complete AS eligible FROM (
SELECT r.run, count_if(pooled)::BIGINT AS accepted, count_if(pooled AND verified)::BIGINT AS verified, count_if(bucket = 'too_easy')::BIGINT AS too_easy, count_if(bucket = 'hard_review_required')::BIGINT AS hard_review_required, count_if(bucket = 'frontier')::BIGINT AS frontier,
round(count_if(bucket = 'too_easy') / count(bucket), 6) AS too_easy_rate, coalesce(any_value(f.n), 0)::BIGINT AS failures, count(DISTINCT replace(backend, 'api:', '')) = 1 AS evaluation_model_fixed, NOT coalesce(bool_or(backend LIKE '%:text-fallback'), false) AS no_text_fallback,
coalesce(any_value(f.n), 0) = 0 AS no_run_failures, bool_and(NOT pooled OR fingerprint IS NOT NULL) AS lineage_complete FROM ({_RUNS}) r LEFT JOIN (SELECT o_orderpriority AS run, count(*) AS n FROM orders WHERE o_orderpriority LIKE '4%' GROUP BY 1) f ON r.run = f.run GROUP BY r.run)"""


def _reports(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders").withColumn("run", F.col("o_orderpriority"))
    kind = F.col("o_custkey") % 4
    bucket = F.when(kind == 0, "too_easy").when(kind == 1, "frontier").when(kind == 2, "hard_review_required")
    backend = F.when((F.col("run") == "2-HIGH") & (F.col("o_orderstatus") == "P"), "api:m:text-fallback").when(F.col("o_custkey") % 3 > 0, "api:m")
    fingerprint = F.when((F.col("run") != "5-LOW") | (F.col("o_orderstatus") != "O"), "f")
    rows = orders.select("run", bucket.alias("bucket"), (F.col("o_totalprice") > 200000).alias("pooled"), (F.col("o_orderstatus") == "F").alias("verified"), backend.alias("backend"), fingerprint.alias("fingerprint"))
    return evaluations.run_reports(rows, orders.where("run like '4%'").select("run"))


@query(_REPORTS)
def run_reports(spark, sf_dir):
    """Order priorities as runs: one with a fallback, one with failures, one whose accepted records lack their lineage."""
    return _reports(spark, sf_dir)


@query(f"""WITH r AS ({_REPORTS}) SELECT c.run, CASE WHEN c.eligible AND c.accepted > b.accepted THEN 'accept' ELSE 'reject' END AS decision,
CASE WHEN NOT c.eligible THEN 'hard_gate_failed' WHEN c.accepted > b.accepted THEN 'primary_metric_increased' ELSE 'primary_metric_not_strictly_increased' END AS reason FROM r c, (SELECT accepted FROM r WHERE run = '1-URGENT') b""")
def run_decisions(spark, sf_dir):
    """Every run against the first."""
    rows = _reports(spark, sf_dir)
    baseline = rows.where("run = '1-URGENT'").select("accepted").scalar()
    return rows.select("run", evaluations.decision(F.col("eligible"), F.col("accepted"), baseline).alias("d")).select("run", "d.decision", "d.reason")


_SAMPLES = """SELECT l_orderkey AS id, list(CASE WHEN l_returnflag <> 'N' OR l_linestatus = 'F' THEN l_returnflag = 'R' END ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS scores, list(CASE WHEN l_quantity > 45 THEN '' ELSE l_returnflag END ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS predictions FROM lineitem GROUP BY 1"""


def _answered(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.when((F.col("l_returnflag") != "N") | (F.col("l_linestatus") == "F"), F.col("l_returnflag") == "R").alias("s"), F.when(F.col("l_quantity") > 45, "").otherwise(F.col("l_returnflag")).alias("p"))
    rows = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.sort_array(F.collect_list(line)).alias("x"))
    new = rows.select("id", F.lit(2).alias("at"), (F.size("x") % 3).cast("string").alias("type"), F.col("x.s").alias("scores"), F.col("x.p").alias("predictions"))
    old = rows.select("id", F.lit(1).alias("at"), F.lit("old").alias("type"), F.array().cast("array<boolean>").alias("scores"), F.array().cast("array<string>").alias("predictions"))
    return old.unionByName(new)


@query(f"SELECT count(*) AS num_samples, sum(len(scores))::BIGINT AS num_scores, sum(len(list_filter(scores, lambda s: s IS NULL)))::BIGINT AS timeout_samples, sum((predictions[-1] = '')::INT)::BIGINT AS empty_samples FROM ({_SAMPLES})")
def sample_counts(spark, sf_dir):
    return evaluations.sample_counts(_answered(spark, sf_dir))


@query(f"SELECT (len(scores) % 3)::VARCHAR AS type, count(*) AS n, round_even(avg(coalesce(scores[-1], false)::INT) * 100, 1) AS accuracy FROM ({_SAMPLES}) GROUP BY 1")
def type_accuracies(spark, sf_dir):
    return evaluations.type_accuracies(_answered(spark, sf_dir))


@query("""SELECT n_name AS edit_id, s_name AS scene_id, n_regionkey AS category FROM nation JOIN (SELECT n_nationkey AS e, unnest([n_nationkey, n_nationkey + 1, 999]) AS s FROM nation WHERE n_nationkey > 3) ON n_nationkey = e JOIN supplier ON s_nationkey = s WHERE n_regionkey > 0""")
def compatible_edits(spark, sf_dir):
    """Nations as edits, suppliers as scenes by nation; some references lead nowhere."""
    nations = _t(spark, sf_dir, "nation")
    edits = nations.where("n_regionkey > 0").select(F.col("n_nationkey").alias("ref"), F.col("n_name").alias("edit_id"), F.col("n_regionkey").alias("category"))
    allowed = nations.where("n_nationkey > 3").select(F.col("n_nationkey").alias("edit_ref"), F.array("n_nationkey", F.col("n_nationkey") + 1, F.lit(999)).alias("allowed_scene_refs"))
    scenes = _t(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("ref"), F.col("s_name").alias("scene_id"))
    return evaluations.compatible_pairs(edits, allowed, scenes).select("edit_id", "scene_id", "category")


_SIGNALS = """SELECT CASE o_orderstatus WHEN 'P' THEN NULL ELSE o_orderstatus END AS task_type, CASE WHEN o_custkey % 7 < 3 THEN o_orderpriority END AS operator, CASE o_orderpriority WHEN '1-URGENT' THEN 'too_easy' WHEN '2-HIGH' THEN 'answer_leak' WHEN '5-LOW' THEN 'identity_failure' ELSE 'unknown' END AS reason, count(*) AS count
FROM orders WHERE o_totalprice > 350000 GROUP BY 1, 2, 3"""


@query(f"""WITH s AS (SELECT coalesce(task_type, 'generic') AS task_type, operator, reason, count FROM ({_SIGNALS})),
p AS (SELECT task_type, 0 AS stage, 0 AS less, '' AS reason, 'fork_pipeline' AS action, task_type || '_pipeline_next' AS target, 'base@3' AS source, NULL AS required, true AS structural FROM s WHERE task_type <> 'generic' GROUP BY task_type HAVING sum(count) >= 2
UNION ALL SELECT task_type, 1, -count, reason, CASE WHEN reason = 'answer_leak' THEN 'update_task_contract' ELSE 'replace_or_insert' END, CASE reason WHEN 'too_easy' THEN 'multi_observation_evidence_selector' WHEN 'answer_leak' THEN 'TaskSpec' ELSE 'task_evidence_validator' END,
coalesce(operator, 'task-specific stage'), CASE reason WHEN 'too_easy' THEN 'cross_time_grounding' WHEN 'identity_failure' THEN 'evidence_validation' END, reason <> 'answer_leak' FROM s WHERE reason <> 'unknown')
SELECT row_number() OVER (ORDER BY task_type, stage, less, reason, source)::INT AS number, action, task_type, target, source, required, structural FROM p""")
def migration_plan(spark, sf_dir):
    """Large orders as failures of tasks, by status and priority."""
    rows = _t(spark, sf_dir, "orders").where("o_totalprice > 350000")
    reason = F.when(F.col("o_orderpriority") == "1-URGENT", "too_easy").when(F.col("o_orderpriority") == "2-HIGH", "answer_leak").when(F.col("o_orderpriority") == "5-LOW", "identity_failure").otherwise("unknown")
    signals = rows.groupBy(F.nullif("o_orderstatus", F.lit("P")).alias("task_type"), F.when(F.col("o_custkey") % 7 < 3, F.col("o_orderpriority")).alias("operator"), reason.alias("reason")).agg(F.count("*").alias("count"))
    return evaluations.migration_plan(signals, "base@3", "generic", ("prompt",))


_CARDS = """SELECT o_orderpriority AS batch, o_orderkey AS id, o_custkey % 4 AS calls, nullif(round(o_totalprice / 100000, 1), 1.5) AS score, CASE WHEN o_custkey % 9 > 0 THEN o_orderstatus <> 'P' END AS settled, o_totalprice > 200000 AS good, CASE WHEN o_custkey % 5 = 0 THEN false WHEN o_custkey % 5 = 1 THEN true END AS valid,
CASE WHEN o_totalprice < 100000 THEN ['cost', o_orderstatus] WHEN o_totalprice < 300000 THEN [o_orderstatus] ELSE [] END AS outcomes, CASE WHEN o_custkey % 3 = 0 THEN ' ' ELSE ' at ' || o_custkey END AS state FROM orders"""


def _cards(spark, sf_dir):
    c = F.col("o_custkey")
    outcomes = F.when(F.col("o_totalprice") < 100000, F.array(F.lit("cost"), "o_orderstatus")).when(F.col("o_totalprice") < 300000, F.array("o_orderstatus")).otherwise(F.array().cast("array<string>"))
    return _t(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("batch"), F.col("o_orderkey").alias("id"), (c % 4).alias("calls"), F.nullif(F.round(F.col("o_totalprice") / 100000, 1), F.lit(1.5)).alias("score"), F.when(c % 9 > 0, F.col("o_orderstatus") != "P").alias("settled"),
        (F.col("o_totalprice") > 200000).alias("good"), F.when(c % 5 == 0, False).when(c % 5 == 1, True).alias("valid"), outcomes.alias("outcomes"), F.when(c % 3 == 0, " ").otherwise(F.concat(F.lit(" at "), c.cast("string"))).alias("state"),
    )


@query(f"""WITH c AS ({_CARDS}), s AS (SELECT batch, count(*) AS samples, sum(calls)::BIGINT AS api_calls, count_if(settled)::BIGINT AS settled, count_if(settled AND good)::BIGINT AS accepted, count_if(settled AND NOT coalesce(valid, true))::BIGINT AS gate_rejects FROM c WHERE batch <> '5-LOW' GROUP BY batch),
a AS (SELECT batch, string_agg(axis || ':' || n, ',' ORDER BY axis) AS axis_failures FROM (SELECT batch, axis, count(*) AS n FROM (SELECT batch, unnest(outcomes) AS axis FROM c WHERE settled) GROUP BY ALL) GROUP BY batch) SELECT s.*, coalesce(axis_failures, '') AS axis_failures FROM s LEFT JOIN a USING (batch)""")
def batch_digests(spark, sf_dir):
    """Digests of all batches but one that was folded before."""
    cards = _cards(spark, sf_dir)
    found = ledger.batch_digests(cards, cards.where("batch = '5-LOW'"))
    said = F.array_join(F.transform(F.array_sort(F.map_entries("axis_failures")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ",")
    return found.withColumn("axis_failures", said)


@query(f"""WITH h AS (SELECT batch, id, score, unnest(outcomes) AS axis FROM ({_CARDS}) WHERE settled), r AS (SELECT *, row_number() OVER (PARTITION BY axis ORDER BY batch, id) AS k, row_number() OVER (PARTITION BY axis ORDER BY batch DESC, id DESC) AS z FROM h)
SELECT axis, count(*) AS failures, count(DISTINCT batch) AS batches, round_even(avg(score), 2) AS mean_score_when_failing, list(id ORDER BY k) FILTER (k < 3 OR z = 1) AS examples FROM r GROUP BY axis""")
def failure_table(spark, sf_dir):
    return ledger.failure_table(_cards(spark, sf_dir))


@query(f"SELECT batch, id, trim(state) AS state FROM ({_CARDS}) WHERE trim(state) <> '' ORDER BY batch DESC, id DESC LIMIT 200")
def newest_states(spark, sf_dir):
    return ledger.newest_states(_cards(spark, sf_dir))


@query("""SELECT conv_id, turn, CASE WHEN length(text) % 3 = 0 THEN trim(text, chr(32) || chr(10)) WHEN length(text) % 3 = 1 THEN 'x = ' || turn WHEN length(text) % 3 = 2 THEN NULL END AS code,
'Watch the video and answer the multiple-choice question. Return exactly one uppercase letter: A, B, C, or D.' || chr(10) || chr(10) || 'Question: ' || coalesce(text, '') || chr(10) || 'A. ' || role || chr(10) || 'B. none' || chr(10) || chr(10) || 'Answer:' AS prompt FROM conversations WHERE text <> ''""")
def codes_and_prompts(spark, sf_dir):
    """Texts as they are, with a fence, and with one that isn't closed; and prompts of them as questions."""
    size = F.length("text") % 3
    said = F.when(size == 0, F.col("text")).when(size == 1, F.concat("text", F.lit("\n```python\nx = "), F.col("turn").cast("string"), F.lit("\n```\nend"))).otherwise(F.concat(F.lit("```\n"), "text"))
    rows = _t(spark, sf_dir, "conversations").where("text <> ''")
    prompt = answers.choice_prompt(F.coalesce("text", F.lit("")), F.array(F.concat(F.lit("A. "), "role"), F.lit("B. none")))
    return rows.select("conv_id", "turn", answers.first_code(said).alias("code"), prompt.alias("prompt"))
