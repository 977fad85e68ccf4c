"""Queries of profiles, tested hypotheses and gates over columns as the tables have them, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import canonical, datasets
from corpusloom.operators import gates, observations, profiles
from corpusloom.plans.catalog import _t, query
from corpusloom.streaming import hypotheses

_RECORD = """SELECT to_json({event_type: event_type, props: props, value: value, times: {mon: month(ts), part: {half: CASE WHEN hour(ts) < 12 THEN 'am' END, late: hour(ts) > 20, deep: {lost: 1}}, days: [day(ts)]},
note: ' {"kind": "' || event_type || '", "weekend": {"is": ' || (dayofweek(ts) IN (0, 6))::VARCHAR || '}}'}) AS record FROM events"""
_SCALARS = rf"""WITH r AS ({_RECORD}), t AS (SELECT substr(fullkey, 3) AS path, type, atom FROM r, json_tree(r.record) WHERE fullkey <> '$' AND NOT contains(fullkey, '[')),
e AS (SELECT t.path || '.' || substr(x.fullkey, 3) AS path, x.type, x.atom FROM t, json_tree(CASE WHEN t.type = 'VARCHAR' AND json_valid(trim(t.atom ->> '$')) AND trim(t.atom ->> '$') LIKE '{{%}}' THEN trim(t.atom ->> '$') ELSE '1' END) x WHERE x.fullkey <> '$' AND NOT contains(x.fullkey, '[')),
s AS (SELECT path, CASE WHEN type = 'VARCHAR' THEN atom ->> '$' ELSE atom::VARCHAR END AS value FROM (SELECT * FROM t WHERE NOT (type = 'VARCHAR' AND trim(atom ->> '$') LIKE '{{%}}') OR type <> 'VARCHAR' UNION ALL SELECT * FROM e)
WHERE type NOT IN ('OBJECT', 'ARRAY') AND len(string_split(path, '.')) <= 3),
c AS (SELECT path, coalesce(value, 'null') AS value, count(*) AS n FROM s GROUP BY 1, 2), p AS (SELECT path, sum(n)::BIGINT AS present_rows, count(*) AS distinct_values FROM c GROUP BY path HAVING count(*) <= 20)"""


def _records(spark, sf_dir):
    times = F.struct(F.month("ts").alias("mon"), F.struct(F.when(F.hour("ts") < 12, "am").alias("half"), (F.hour("ts") > 20).alias("late"), F.struct(F.lit(1).alias("lost")).alias("deep")).alias("part"), F.array(F.day("ts")).alias("days"))
    note = F.concat(F.lit(' {"kind": "'), "event_type", F.lit('", "weekend": {"is": '), F.dayofweek("ts").isin(1, 7).cast("string"), F.lit("}}"))
    return _t(spark, sf_dir, "events").select(F.to_json(F.struct("event_type", "props", "value", times.alias("times"), note.alias("note")), {"ignoreNullFields": "false"}).alias("record"))


@query(f"""{_SCALARS} SELECT path, present_rows, n_rows - present_rows AS missing_rows, round(present_rows / n_rows, 6) AS coverage_rate, distinct_values, value, n
FROM c JOIN p USING (path), (SELECT count(*) AS n_rows FROM events)""")
def scalar_profile(spark, sf_dir):
    """Records with nested objects, an array, nulls, objects within texts (one of them too varied), and one beyond the depth."""
    return profiles.scalar_profile(_records(spark, sf_dir), "record")


@query(f"{_SCALARS} SELECT path, arg_min(value, (-n, value)) AS value, max(n) AS n, round(max(n) / any_value(present_rows), 6) AS share FROM c JOIN p USING (path) GROUP BY path")
def repeated_shares(spark, sf_dir):
    return profiles.repeated_share(_records(spark, sf_dir), "record")


@query("SELECT unnest(['times', 'event_type', 'note', 'props', 'value']) AS field")
def top_fields(spark, sf_dir):
    return profiles.top_fields(_records(spark, sf_dir), "record")


_OBSERVED = "SELECT event_type AS strategy, 'user ' || user_id AS hypothesis, datediff('day', DATE '2020-01-01', ts::DATE) AS batch, max(CASE WHEN value > 60 THEN 3 WHEN value < 25 THEN 2 ELSE 1 END) AS v FROM events GROUP BY ALL"
_STATES = f"""WITH RECURSIVE o AS ({_OBSERVED}), s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY strategy, hypothesis ORDER BY batch) AS r FROM o),
m AS (SELECT strategy, hypothesis, 0::BIGINT AS r, []::BIGINT[] AS support, []::BIGINT[] AS oppose, 0 AS streak, NULL::BIGINT AS asked, NULL::INT AS asked_support, NULL::BIGINT AS stale, NULL::BIGINT AS last FROM s WHERE r = 1
UNION ALL SELECT strategy, hypothesis, r, support, oppose, streak, CASE WHEN asks THEN last ELSE asked END, CASE WHEN asks THEN len(support)::INT ELSE asked_support END, stale, last FROM
(SELECT *, asked IS NULL AND stale IS NULL AND len(support) >= 2 AND len(oppose) < len(support) AS asks FROM
(SELECT m.strategy, m.hypothesis, s.r, CASE WHEN v = 3 THEN list_append(support, batch) ELSE support END AS support, CASE WHEN v = 2 THEN list_append(oppose, batch) ELSE oppose END AS oppose,
CASE WHEN v = 1 THEN streak + 1 ELSE 0 END AS streak, asked, asked_support, CASE WHEN stale IS NULL AND v = 1 AND streak + 1 >= 2 THEN batch ELSE stale END AS stale, batch AS last
FROM m JOIN s ON m.strategy = s.strategy AND m.hypothesis = s.hypothesis AND s.r = m.r + 1))),
states AS (SELECT * FROM m WHERE r > 0 QUALIFY row_number() OVER (PARTITION BY strategy, hypothesis ORDER BY r DESC) = 1)"""


def _observed(spark, sf_dir):
    batch = F.date_diff(F.to_date("ts"), F.lit("2020-01-01").cast("date")).cast("long")
    verdict = F.when(F.col("value") > 60, "support").when(F.col("value") < 25, "oppose").otherwise("not_tested")
    return _t(spark, sf_dir, "events").select(F.col("event_type").alias("strategy"), F.concat(F.lit("user "), "user_id").alias("hypothesis"), batch.alias("batch"), verdict.alias("verdict"))


@query(f"{_STATES} SELECT strategy, hypothesis, support, oppose, streak, asked, asked_support, stale, last FROM states")
def hypothesis_states(spark, sf_dir):
    """Users stand for hypotheses of a strategy, days for batches; several verdicts a day count once."""
    return hypotheses.fold(_observed(spark, sf_dir))


@query(f"""{_STATES}, p AS (SELECT strategy, hypothesis FROM states WHERE asked IS NOT NULL QUALIFY row_number() OVER (PARTITION BY strategy ORDER BY asked, asked_support DESC, hypothesis) <= 3)
SELECT strategy, hypothesis, len(support)::INT AS n_support, len(oppose)::INT AS n_oppose, streak, CASE WHEN p.strategy IS NOT NULL THEN 'promoted' WHEN stale IS NOT NULL THEN 'retired' ELSE 'open' END AS status,
CASE WHEN p.strategy IS NOT NULL THEN asked ELSE stale END AS since FROM states LEFT JOIN p USING (strategy, hypothesis)""".replace("LEFT JOIN p USING (strategy, hypothesis)", "s LEFT JOIN p ON s.strategy = p.strategy AND s.hypothesis = p.hypothesis").replace("SELECT strategy, hypothesis, len(", "SELECT s.strategy, s.hypothesis, len("))
def hypothesis_statuses(spark, sf_dir):
    return hypotheses.statuses(hypotheses.fold(_observed(spark, sf_dir)))


@query("""SELECT o_orderkey AS id, CASE WHEN coalesce(u, 0) < 2 THEN 'insufficient_evidence_units' WHEN coalesce(h, 0) < 1 THEN 'insufficient_reasoning_hops' END AS reason FROM
(SELECT o_orderkey, count(l_partkey) AS u, max(l_linenumber) - 2 AS h FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'R' GROUP BY o_orderkey)""")
def complexity_reasons(spark, sf_dir):
    """Returned line items as the units of evidence of an order; orders without any have null counts."""
    items = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("u"), (F.max("l_linenumber") - 2).alias("h"))
    rows = _t(spark, sf_dir, "orders").select("o_orderkey").join(items, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("id"), gates.complexity_problem(F.lit("counting"), F.col("u"), F.col("h"), F.lit(2), F.lit(1), F.lit(None).cast("boolean")).alias("reason"))


_FOLD = "lower(trim(regexp_replace(coalesce({}, ''), '\\s+', ' ', 'g')))"
_SAMPLES = """SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer, d.text AS x, nullif(e.text, '') AS y, nullif(a.role, 'system') AS z, b.role AS cited FROM conversations a
LEFT JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn + 1 LEFT JOIN conversations d ON d.conv_id = a.conv_id AND d.turn = a.turn + 2 LEFT JOIN conversations e ON e.conv_id = a.conv_id AND e.turn = a.turn - 1"""


def _samples(spark, sf_dir):
    """Turns as questions, the next as answers; the choices are the answer, the turns around, and a role."""
    turns = _t(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    near = lambda step, *columns: turns.select("conv_id", (F.col("turn") - step).alias("turn"), *columns)
    rows = turns.select("conv_id", "turn", F.col("text").alias("question"), F.nullif("role", F.lit("system")).alias("z"))
    rows = rows.join(near(1, F.col("text").alias("answer"), F.col("role").alias("cited")), ["conv_id", "turn"], "left").join(near(2, F.col("text").alias("x")), ["conv_id", "turn"], "left")
    return rows.join(near(-1, F.nullif("text", F.lit("")).alias("y")), ["conv_id", "turn"], "left")


@query(rf"""WITH s AS ({_SAMPLES}), f AS (SELECT *, [{', '.join(_FOLD.format(c) for c in ('answer', 'x', 'y', 'z'))}] AS c, {_FOLD.format('answer')} AS a FROM s)
SELECT conv_id, turn, CASE WHEN {_FOLD.format('question')} = '' THEN 'missing_question' WHEN a = '' THEN 'missing_answer' WHEN cited NOT IN ('user', 'assistant') THEN 'unknown_citations' WHEN list_contains(c, '') THEN 'blank_choice'
WHEN len(list_filter(c, lambda k: k = a)) <> 1 THEN 'answer_not_unique_choice' END AS reason FROM f""")
def handoff_reasons(spark, sf_dir):
    allowed = F.array(F.lit("user"), F.lit("assistant"))
    reason = gates.handoff_problem(F.col("question"), F.col("answer"), F.array("cited"), allowed, F.array("answer", "x", "y", "z"))
    return _samples(spark, sf_dir).select("conv_id", "turn", reason.alias("reason"))


@query(rf"""WITH s AS ({_SAMPLES}), f AS (SELECT *, [{', '.join(_FOLD.format(c) for c in ('answer', 'x', 'y', 'z'))}] AS c FROM s),
w AS (SELECT *, list_sort(list_transform(c, lambda k: len(list_distinct(list_filter(string_split_regex(k, '[^a-z0-9]+'), lambda t: length(t) > 2))))) AS n FROM f)
SELECT conv_id, turn, CASE WHEN list_contains(c, '') THEN 'must_have_exactly_four_nonempty_choices' WHEN len(list_distinct(c)) <> 4 THEN 'duplicate_choices' WHEN {_FOLD.format('answer')} = {_FOLD.format('question')} AND n[4] >= 4 THEN 'answer_leaked_in_question'
WHEN n[3] > 0 AND n[1] < greatest(1, floor(n[3] * 0.35)) THEN 'option_length_outlier' END AS reason FROM w""")
def distractor_reasons(spark, sf_dir):
    """Questions and answers here are unlike each other or equal, so equality stands for likeness in the SQL."""
    reason = gates.distractor_problem(F.col("question"), F.array("answer", "x", "y", "z"), F.col("answer"))
    return _samples(spark, sf_dir).select("conv_id", "turn", reason.alias("reason"))


def _solutions(spark, sf_dir):
    """Answers as a model writes them and as the truth has them, from the columns of line items; some are null."""
    q, n, s = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber").cast("string"), F.col("l_suppkey").cast("string")
    hundredth = F.round(F.col("l_discount") * 100, 0).cast("int").cast("string")
    predicted = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("\\left( "), q, F.lit(", "), hundredth, F.lit("\\right)."))).when(F.col("l_returnflag") == "A", F.concat(F.lit("\\dfrac"), n, F.lit("{"), s, F.lit("}")))
        .when((F.col("l_linestatus") == "F") | (F.col("l_quantity") <= 40), F.concat(F.lit("x = "), q, F.lit(".00 km")))
    )
    truth = (
        F.when(F.col("l_returnflag") == "R", F.concat(F.lit("["), q, F.lit(".0,"), F.round("l_tax", 2).cast("string"), F.lit("]"))).when(F.col("l_returnflag") == "A", F.concat(n, F.lit("/"), (F.col("l_suppkey") + F.col("l_linenumber") % 2).cast("string"))).otherwise(q)
    )
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", predicted.alias("predicted"), truth.alias("truth"))


_HUNDREDTH = "round(l_discount * 100)::INT"


@query(rf"""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN '(' || l_quantity::INT || ',' || {_HUNDREDTH} || ')' WHEN 'A' THEN '\frac{{' || l_linenumber || '}}{{' || l_suppkey || '}}'
ELSE CASE WHEN l_linestatus = 'F' OR l_quantity <= 40 THEN l_quantity::INT::VARCHAR END END AS answer FROM lineitem""")
def canonical_answers(spark, sf_dir):
    return _solutions(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", canonical.canonical_answer(F.col("predicted")).alias("answer"))


@query(f"""WITH p AS (SELECT *, {_HUNDREDTH}::DOUBLE AS x, round(l_tax, 2) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'R' THEN abs(x - y) <= 1e-4 * greatest(x, y) OR abs(x - y / 100) <= 1e-4 * greatest(x, y / 100) OR abs(x - y * 100) <= 1e-4 * greatest(x, y * 100)
WHEN 'A' THEN l_linenumber % 2 = 0 ELSE l_linestatus = 'F' OR l_quantity <= 40 END AS equal FROM p""")
def equal_answers(spark, sf_dir):
    same = canonical.answers_equal(canonical.canonical_answer(F.col("predicted")), canonical.canonical_answer(F.col("truth")))
    return _solutions(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_partkey", same.alias("equal"))


_SEEN = """SELECT 'u' || user_id AS video, datediff('day', DATE '2020-01-01', ts::DATE)::INT AS seg, event_id, event_type AS who, (epoch_us(ts) - epoch_us(ts::DATE::TIMESTAMP)) / 1e6 AS s, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY event_id) AS i FROM events"""
_UNITS_OF = f"""WITH e AS ({_SEEN}), o AS (SELECT video, seg, seg * 86400.0 AS base, min(who) AS a, max(who) AS z, min(s) AS first, max(s) AS last, count(*) AS n FROM e GROUP BY video, seg),
units AS (SELECT video, format('a_{{:04d}}_entity_{{:02d}}', seg, i) AS evidence_id, 'entity_event' AS source_kind, seg AS segment_index, seg * 86400.0 + s AS start_sec, seg * 86400.0 + least(86400.0, s + value * 600) AS end_sec,
CASE WHEN value > 90 THEN '' WHEN value > 50 THEN who || ' walks' ELSE who || ' rests' END AS text, [who] AS entity_ids, CASE WHEN value > 30 THEN 'before' ELSE '' END AS visible_preconditions, CASE WHEN value < 70 THEN 'after' ELSE '' END AS visible_outcome, 'structured' AS timestamp_quality FROM e
UNION ALL SELECT video, format('a_{{:04d}}_caption_01', seg), 'caption_span', seg, base, base + 86400, 'day of ' || a, CASE WHEN n > 1 THEN [a] ELSE [] END, '', '', 'unanchored_prefix' FROM o
UNION ALL SELECT video, format('a_{{:04d}}_caption_02', seg), 'caption_span', seg, base + 605, base + 86400, z || ' leaves', CASE WHEN n > 1 AND last >= 605 THEN [a] ELSE [] END, '', '', 'anchored' FROM o)"""


def _observations(spark, sf_dir):
    """Days of users as segments of videos: events, a caption with parts that count and parts that don't, and one entity's interval."""
    day, s = F.to_date("ts"), (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_date("ts").cast("timestamp"))) / 1e6
    rows = _t(spark, sf_dir, "events").select(F.concat(F.lit("u"), "user_id").alias("video"), F.date_diff(day, F.lit("2020-01-01").cast("date")).alias("segment_index"), "event_id", "event_type", s.alias("s"), "value")
    text = F.when(F.col("value") > 90, " ").when(F.col("value") > 50, F.concat("event_type", F.lit(" walks "))).otherwise(F.concat("event_type", F.lit(" rests")))
    event = F.struct(
        "event_id", F.col("s").alias("start_sec"), (F.col("s") + F.col("value") * 600).alias("end_sec"), F.array("event_type", "event_type").alias("participants"), text.alias("description"),
        F.when(F.col("value") > 30, "before").alias("visible_preconditions"), F.when(F.col("value") < 70, "after ").alias("visible_outcome"), F.lit(None).cast("string").alias("uncertainty"),
    )
    days = rows.groupBy("video", "segment_index").agg(F.sort_array(F.collect_list(event)).alias("e"), F.min("event_type").alias("a"), F.max("event_type").alias("z"), F.min("s").alias("first"), F.max("s").alias("last"))
    caption = F.concat(F.lit("day of "), "a", F.lit(" [10:05-1440:00] "), "z", F.lit(" leaves[09:00-08:00] lost [00:10-00:20]  "))
    interval = F.when(F.size("e") > 1, F.array(F.struct(F.col("first").alias("start_sec"), F.col("last").alias("end_sec"))))
    update = F.array(F.struct(F.col("a").alias("entity_id"), interval.alias("evidence_intervals"), F.create_map(F.lit("seen"), F.size("e").cast("string")).alias("attributes")))
    return days.select("video", "segment_index", (F.col("segment_index") * 86400.0).alias("start_sec"), F.lit(86400.0).alias("duration_sec"), caption.alias("caption"), update.alias("entity_updates"), F.transform("e", lambda x: x.dropFields("event_id")).alias("observed_events"))


@query(f"{_UNITS_OF} SELECT * FROM units")
def evidence_units(spark, sf_dir):
    return observations.evidence_units(_observations(spark, sf_dir)).drop("uncertainty")


@query(f"""{_UNITS_OF} SELECT video, a AS entity_id, row_number() OVER (PARTITION BY video, a ORDER BY base + CASE WHEN n > 1 THEN first ELSE 0 END)::INT AS number, seg AS segment_index,
base + CASE WHEN n > 1 THEN first ELSE 0 END AS start_sec, base + CASE WHEN n > 1 THEN last ELSE 86400 END AS end_sec, n::INT AS seen FROM o""")
def observed_tracks(spark, sf_dir):
    return observations.entity_tracks(_observations(spark, sf_dir)).withColumn("seen", F.col("attributes")["seen"].cast("int")).drop("attributes")


# Every family by joins of units with units; _RANK puts its candidates in order
_RANK = "ORDER BY greatest(h, len(ids) - 1) + least(3, greatest(0, (hi - lo) / 60)) DESC, hi - lo DESC, k"


@query(f"""{_UNITS_OF}, u AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start_sec, end_sec, evidence_id) AS k FROM units WHERE text <> ''),
x AS (SELECT video, unnest(entity_ids) AS w, k, start_sec, end_sec, evidence_id FROM u), c AS (SELECT video, w, list(evidence_id ORDER BY k) AS ids, list(start_sec ORDER BY k) AS ss, list(end_sec ORDER BY k) AS es, min(k) AS k FROM x GROUP BY video, w),
later AS (SELECT a.video, a.k, min(b.k) AS b FROM x a JOIN x b ON a.video = b.video AND a.w = b.w AND b.start_sec > greatest(a.start_sec, a.end_sec) GROUP BY a.video, a.k),
s AS (SELECT u.*, v.evidence_id AS other, v.start_sec AS os, v.end_sec AS oe FROM u LEFT JOIN later USING (video, k) LEFT JOIN u v ON v.video = u.video AND v.k = later.b),
f AS (SELECT 0 AS t, 1 AS h, video, [ids[1], ids[-1]] AS ids, ss[1] AS lo, greatest(es[1], es[-1]) AS hi, k, false AS alone FROM c WHERE len(ids) >= 2
UNION ALL SELECT 3, 2, video, [ids[1], ids[len(ids) // 2 + 1], ids[-1]], ss[1], greatest(es[1], es[len(ids) // 2 + 1], es[-1]), k, false FROM c WHERE len(ids) >= 3
UNION ALL SELECT 1, 1, video, CASE WHEN other IS NULL THEN [evidence_id] ELSE [evidence_id, other] END, start_sec, greatest(end_sec, coalesce(oe, end_sec)), k, other IS NULL FROM s WHERE visible_preconditions <> '' AND visible_outcome <> ''
UNION ALL SELECT 4, 1, video, CASE WHEN other IS NULL THEN [evidence_id] ELSE [evidence_id, other] END, start_sec, greatest(end_sec, coalesce(oe, end_sec)), k, false FROM s WHERE text LIKE '% walks' OR text LIKE '% leaves'
UNION ALL SELECT 2, 1, a.video, [a.evidence_id, b.evidence_id], a.start_sec, greatest(a.end_sec, b.end_sec), a.k, false FROM u a JOIN u b ON a.video = b.video AND b.k = a.k + 1 WHERE b.start_sec >= a.end_sec),
g AS (SELECT *, row_number() OVER (PARTITION BY video, t {_RANK}) AS r FROM (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY video, t, ids {_RANK}) = 1))
SELECT video, ['entity_tracking', 'state_change', 'temporal_relation', 'conditional_counting', 'dynamic_spatial_trajectory'][t + 1] AS task_type, ids AS evidence_ids, greatest(h, len(ids) - 1)::INT AS hop_count, hi - lo AS temporal_span_sec, alone AS single_observation_fallback FROM g WHERE r <= 2""")
def task_candidates(spark, sf_dir):
    """Five of the eight families, two candidates each; the other three take the same units by like rules."""
    found = observations.task_candidates(observations.evidence_units(_observations(spark, sf_dir)), most=2)
    some = found.where(F.col("task_type").isin("entity_tracking", "state_change", "temporal_relation", "conditional_counting", "dynamic_spatial_trajectory"))
    return some.select("video", "task_type", "evidence_ids", "hop_count", "temporal_span_sec", "single_observation_fallback")


@query("""SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END, abs(hour(ts) - 2), value DESC, event_id) = 1 AS frontier_selected FROM events""")
def marked_frontier(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 3 == 0, "frontier").alias("bucket"), F.hour("ts").alias("correct"), F.col("value").alias("span"), F.col("event_id").alias("ordinal"))
    return observations.marked_frontier(rows, ["event_type"]).select("event_id", "frontier_selected")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_returnflag WHEN 'A' THEN 'step ' || l_linenumber WHEN 'R' THEN 's' ELSE l_linestatus END AS solution,
CASE l_returnflag WHEN 'A' THEN l_suppkey::VARCHAR WHEN 'R' THEN CASE WHEN l_linenumber % 2 = 0 THEN (l_quantity / 100)::VARCHAR ELSE regexp_replace((l_quantity::INT / l_linenumber)::VARCHAR, '\\.0$', '') END ELSE CASE WHEN l_linestatus = 'F' THEN 'yes' END END AS answer,
CASE l_returnflag WHEN 'A' THEN 'how many?' WHEN 'R' THEN 'Read the following table ' || CASE WHEN l_linestatus = 'O' THEN 'regarding "' || l_shipdate::DATE || '" ' ELSE '' END || 'and answer a question:' || chr(10) || 'a|' || l_partkey || chr(10) || 'q'
ELSE 'Body ' || l_partkey || '. is it?' || CASE WHEN l_linestatus = 'F' THEN ' (Yes or No)' ELSE '' END END AS question FROM lineitem""".replace("\\\\", "\\"))
def dataset_records(spark, sf_dir):
    """Line items as records of three datasets; some have no title, some no answer."""
    n, q, key = F.col("l_linenumber"), F.col("l_quantity").cast("int"), F.col("l_partkey").cast("string")
    text = lambda *parts: F.concat(*[p if not isinstance(p, str) else F.lit(p) for p in parts])
    counted = F.to_json(F.struct(text("step ", n.cast("string"), " #### ", F.col("l_suppkey").cast("string"), " ").alias("answer"), F.lit("how many?").alias("question")))
    answer = F.when(n % 2 == 0, text(q.cast("string"), "%")).otherwise(text(q.cast("string"), "/", n.cast("string")))
    title = F.when(F.col("l_linestatus") == "O", F.to_date("l_shipdate").cast("string"))
    tabled = F.to_json(F.struct(F.lit("s").alias("solution"), answer.alias("answer"), F.lit("decimal_number").alias("ans_type"), title.alias("table_title"), text("a|", key).alias("table"), F.lit("q").alias("question")))
    told = F.to_json(F.struct(F.col("l_linestatus").alias("Equation"), F.when(F.col("l_linestatus") == "F", "yes").alias("Answer"), text("Body ", key).alias("Body"), F.lit("is it?").alias("Question")))
    name = F.when(F.col("l_returnflag") == "A", "gsm8k").when(F.col("l_returnflag") == "R", "tabmwp").otherwise("svamp")
    record = F.when(F.col("l_returnflag") == "A", counted).when(F.col("l_returnflag") == "R", tabled).otherwise(told)
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", record.alias("r"), name.alias("d"))
    rows = rows.select("l_orderkey", "l_linenumber", "l_partkey", datasets.record_texts(F.col("r"), F.col("d")).alias("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "t.solution", "t.answer", "t.question")
