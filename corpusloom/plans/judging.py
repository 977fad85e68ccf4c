"""Queries of answers, gates, evidence and summaries over the driver's tables, with SQL that gives the same rows.

As in the catalog, orders, parts and line items stand in for records, candidates and samples; text columns are built where
the tables have none of the form.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import answers
from corpusloom.functions import text as X
from corpusloom.operators import evidence, gates, ledger, scoring, summaries
from corpusloom.plans.catalog import _t, query
from corpusloom.sources import records

_WORD, _NOT_WORD = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"


@query(rf"""WITH t AS (SELECT conv_id, turn, upper(regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')) AS u FROM conversations)
SELECT conv_id, turn, coalesce(nullif(regexp_extract(u, '(?:ANSWER|OPTION|CHOICE|FINAL)\s*[:：]?\s*[*`#\[]?\s*([ABCD])(?:{_NOT_WORD}|$)', 1), ''),
nullif(regexp_extract(u, '^[*`#\[]?\s*([ABCD])[.)：:]', 1), ''), nullif(regexp_extract(u, '(?s)^(?:.*{_NOT_WORD})?([ABCD])(?:{_NOT_WORD}.*)?$', 1), '')) AS letter FROM t""")
def answer_letters(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").select("conv_id", "turn", X.answer_letter(F.col("text")).alias("letter"))


@query("""SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4 WHEN 0 THEN l_partkey::VARCHAR WHEN 1 THEN l_partkey || '000' WHEN 2 THEN l_partkey::VARCHAR END AS answer FROM lineitem""")
def benchmark_answers(spark, sf_dir):
    key = F.col("l_partkey").cast("string")
    raw = F.when(F.col("l_linenumber") % 4 == 0, F.concat(F.lit(" \\boxed{"), key, F.lit("}"))).when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("$"), key, F.lit(",000$."))).when(F.col("l_linenumber") % 4 == 2, F.concat(key, F.lit(".\n")))
    # a dollar sign before the full stop stays, as only signs at the ends go
    raw = F.when(F.col("l_linenumber") % 4 == 1, F.concat(F.lit("$"), key, F.lit(",000.$"))).otherwise(raw)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", X.benchmark_answer(raw).alias("answer"))


@query(r"""SELECT p_partkey, CASE WHEN p_partkey % 3 > 0 THEN '\frac{' || p_partkey || '}{2}' END AS boxed FROM part""")
def boxed_answers(spark, sf_dir):
    key = F.col("p_partkey").cast("string")
    whole = F.concat(F.lit("first \\boxed{1}, then \\boxed{ \\frac{"), key, F.lit("}{2} } at last"))
    text = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("cut off \\boxed{a{"), key, F.lit("}"))).otherwise(whole)
    return _t(spark, sf_dir, "part").select("p_partkey", answers.last_boxed(text).alias("boxed"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 3 THEN NULL ELSE props END AS found FROM events""")
def json_answers(spark, sf_dir):
    kind = F.col("event_id") % 4
    text = F.when(kind == 0, F.concat(F.lit("Result: "), "props", F.lit(" and [more]"))).when(kind == 1, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(kind == 2, F.concat(F.lit(" \n"), "props")).otherwise("no {brackets close")
    return _t(spark, sf_dir, "events").select("event_id", answers.first_json(text).alias("found"))


@query(r"""SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN '' WHEN 5 THEN 'x+' || p_partkey ELSE p_partkey::VARCHAR END AS answer FROM part""")
def final_answers(spark, sf_dir):
    key, kind = F.col("p_partkey").cast("string"), F.col("p_partkey") % 6
    around = lambda head, tail: F.concat(F.lit(head), key, F.lit(tail))
    text = (
        F.when(kind == 0, around("So The answer is ", ".")).when(kind == 1, around("Thus the final answer is:", "/")).when(kind == 2, around("We get 1,200 and then ", ""))
        .when(kind == 3, around("It is \\boxed{", "}, of course, and 7.")).when(kind == 4, "There is none").otherwise(around("The final answer is $x+", "$. I hope it is correct, \\boxed{0}."))
    )
    return _t(spark, sf_dir, "part").select("p_partkey", answers.final_answer(text).alias("answer"))


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 2 = 0 THEN CASE l_partkey % 5 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'C' WHEN 3 THEN 'D' ELSE 'E' END END AS letter FROM lineitem")
def chosen_letters(spark, sf_dir):
    letter = F.substr(F.lit("abcde"), (F.col("l_partkey") % 5 + 1).cast("int"), F.lit(1))
    text = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("The Choice is ("), letter, F.lit(") Problem: the answer is e"))).otherwise("Problem: the answer is (a)")
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", answers.chosen_letter(F.replace(text, F.lit("Choice"), F.lit("choice"))).alias("letter"))


@query(rf"SELECT doc_id, regexp_matches(text, '(?i)(?:^|{_NOT_WORD})(?:{'|'.join(X.MOTION)})') AS motion FROM documents WHERE text IS NOT NULL")
def motion_words(spark, sf_dir):
    return _t(spark, sf_dir, "documents").where("text is not null").select("doc_id", X.has_motion(F.col("text")).alias("motion"))


@query(r"SELECT conv_id, turn, md5(replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), 'ß', 'ss')) AS folded FROM conversations WHERE text IS NOT NULL")
def folded_answers(spark, sf_dir):
    return _t(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.md5(X.folded_answer(F.col("text"))).alias("folded"))


_SAMPLES = "SELECT l_orderkey AS q, l_linenumber::BIGINT * 1000000000000 + l_partkey * 1000000 + l_suppkey AS s, l_returnflag = 'R' AS good, CASE WHEN l_quantity > 45 OR l_suppkey % 5 = 0 THEN 'runaway' WHEN l_returnflag = 'N' THEN 'parse_failure' ELSE 'wrong_answer' END AS kind FROM lineitem"
_FIGURES = """round(avg(good::INT), 6) AS score, sum(good::BIGINT)::BIGINT AS correct_count, count(*) AS total_count, coalesce(sum((NOT good AND kind = 'wrong_answer')::BIGINT), 0)::BIGINT AS wrong_answer_count,
coalesce(sum((NOT good AND kind = 'parse_failure')::BIGINT), 0)::BIGINT AS parse_failure_count, coalesce(sum((NOT good AND kind = 'runaway')::BIGINT), 0)::BIGINT AS runaway_count"""


@query(f"""SELECT 'avg' AS metric, {_FIGURES} FROM ({_SAMPLES}) UNION ALL SELECT 'accuracy', {_FIGURES} FROM (SELECT arg_min(good, s) AS good, arg_min(kind, s) AS kind FROM ({_SAMPLES}) GROUP BY q)
UNION ALL SELECT 'pass', {_FIGURES} FROM (SELECT bool_or(good) AS good, arg_min(kind, s) AS kind FROM ({_SAMPLES}) GROUP BY q)""")
def sampled_summaries(spark, sf_dir):
    reason = F.when(F.col("l_suppkey") % 5 == 0, "length").when(F.col("l_suppkey") % 5 == 1, "stop")
    rows = _t(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("question"), (F.col("l_linenumber").cast("long") * 1_000_000_000_000 + F.col("l_partkey") * 1_000_000 + F.col("l_suppkey")).alias("sample"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("parsed"), (F.col("l_returnflag") == "R").alias("good"),
        reason.alias("finish_reason"), F.col("l_quantity").alias("tokens"),
    )
    one = lambda m: scoring.sampled_summary(rows, m, 47).select(F.lit(m).alias("metric"), "*")
    return one("avg").union(one("accuracy")).union(one("pass"))


@query("SELECT coalesce(event_type, '∅') AS event_type, greatest(0, 2100 - count(*))::BIGINT AS gap, row_number() OVER (ORDER BY greatest(0, 2100 - count(*)) DESC, coalesce(event_type, '∅'))::INT AS rank FROM events GROUP BY event_type")
def ranked_gaps(spark, sf_dir):
    slices = ledger.coverage_slices(_t(spark, sf_dir, "events"), ["event_type"], F.col("value") > 5, F.lit(1), 2100)
    return ledger.ranked_gaps(slices, ["event_type"]).select("event_type", "gap", "rank")


@query("SELECT o_orderpriority AS priority, unnest(CASE WHEN o_orderkey % 2 = 0 THEN [o_orderstatus, 'y' || year(o_orderdate)] ELSE [] END) AS tag, count(*) AS n FROM orders WHERE o_totalprice <= 100000 GROUP BY 1, 2")
def failure_tags(spark, sf_dir):
    tags = F.when(F.col("o_orderkey") % 2 == 0, F.array("o_orderstatus", F.concat(F.lit("y"), F.year("o_orderdate").cast("string"))))
    return ledger.failure_tags(_t(spark, sf_dir, "orders").withColumnRenamed("o_orderpriority", "priority"), ["priority"], F.col("o_totalprice") > 100000, tags)


_CHAINS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS parent FROM orders"
_ROOTS = f"""SELECT id, arg_max(root, depth) AS root FROM (WITH RECURSIVE c AS (SELECT id, coalesce(parent, id) AS root, 0 AS depth FROM ({_CHAINS}) UNION ALL
SELECT c.id, r.parent, c.depth + 1 FROM c JOIN ({_CHAINS}) r ON r.id = c.root WHERE r.parent IS NOT NULL AND r.parent <> c.root) SELECT * FROM c) GROUP BY id"""


def _chains(spark, sf_dir):
    tags = F.when(F.col("o_orderstatus") == "F", F.array(F.lit("late"))).when(F.col("o_orderstatus") == "P", F.array(F.lit("late"), F.lit("target_absent"))).otherwise(F.array().cast("array<string>"))
    parent = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey div 2 END")
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), parent.alias("parent"), (F.col("o_totalprice") > 200000).alias("good"), tags.alias("tags"), F.col("o_orderdate").alias("at"))


@query(_ROOTS)
def rewrite_roots(spark, sf_dir):
    return ledger.rewrite_roots(_chains(spark, sf_dir))


@query(f"""WITH r AS ({_ROOTS}), o AS (SELECT root, o_orderkey AS id, o_totalprice > 200000 AS good, o_orderstatus AS st, o_orderdate AS moment FROM orders JOIN r ON o_orderkey = r.id)
SELECT root, arg_max(id, (moment, -id)) AS id FROM o WHERE NOT good AND st = 'F' AND root NOT IN (SELECT root FROM o WHERE good) GROUP BY root""")
def rewrite_targets(spark, sf_dir):
    rows = _chains(spark, sf_dir)
    return ledger.rewrite_targets(rows, ledger.rewrite_roots(rows), ["already_satisfied", "target_absent", "ambiguous_target", "edit_not_observable"]).select("root", "id")


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 7 AS k FROM customer) SELECT id, CASE k WHEN 0 THEN 'missing_question' WHEN 1 THEN 'choices_not_four' WHEN 2 THEN 'empty_choice' WHEN 3 THEN 'answer_not_unique_choice'
WHEN 4 THEN 'missing_evidence' WHEN 5 THEN 'missing_route' END AS reason FROM c""")
def choice_problems(spark, sf_dir):
    k = F.col("c_custkey") % 7
    four = F.array("c_name", F.lit("b"), F.lit("c"), F.lit("d"))
    choices = F.when(k == 1, F.slice(four, 1, 3)).when(k == 2, F.array("c_name", F.lit(" "), F.lit("c"), F.lit("d"))).when(k == 3, F.array("c_name", F.lower("c_name"), F.lit("c"), F.lit("d"))).otherwise(four)
    reason = evidence.choice_problem(F.when(k != 0, F.col("c_name")), choices, F.concat(F.upper("c_name"), F.lit("  ")), F.when(k != 4, F.array(F.lit("e"))), F.when(k == 5, F.lit(" ")).otherwise("r"))
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), reason.alias("reason"))


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 'reserve' WHEN o_orderkey % 5 = 0 OR o_orderkey % 7 = 0 THEN 'rejected' ELSE 'accepted' END AS pool FROM orders")
def pool_dispositions(spark, sf_dir):
    pool = evidence.pool_disposition(F.when(F.col("o_orderstatus") == "P", "reserve").otherwise(" "), F.col("o_orderkey") % 5 == 0, F.when(F.col("o_orderkey") % 7 == 0, "late"))
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), pool.alias("pool"))


@query("SELECT o_orderkey AS id, round(greatest(o_orderkey % 4, o_custkey % 6 - 1) + least(3, greatest(0, (o_totalprice - 50000) / 1000 / 60)), 6) AS complexity FROM orders")
def complexities(spark, sf_dir):
    score = evidence.complexity(F.col("o_orderkey") % 4, F.col("o_custkey") % 6, (F.col("o_totalprice") - 50000) / 1000)
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.round(score, 6).alias("complexity"))


@query("""SELECT p_partkey AS key, 1000.0 + s AS start_sec, 1000.0 + e AS end_sec, d AS description, q AS quality FROM part, LATERAL (SELECT * FROM (VALUES (0.0, 90.0, 'Intro.', 'unanchored_prefix'),
(5.0, (p_size % 10)::DOUBLE, 'A ' || p_partkey || ' [x]', 'anchored'), (60.0, 90.0, 'Last', 'anchored')) t(s, e, d, q)) WHERE e >= s""")
def caption_spans(spark, sf_dir):
    caption = F.concat(F.lit("Intro. [00:05-00:0"), (F.col("p_size") % 10).cast("string"), F.lit("] A "), F.col("p_partkey").cast("string"), F.lit(" [x] [00:30-00:40]\n[01:00-02:30] Last "))
    rows = _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.lit(1000.0).alias("start_sec"), F.lit(90.0).alias("duration_sec"), caption.alias("caption"))
    return evidence.caption_spans(rows)


_TIMED = "SELECT user_id AS key, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e, event_type AS d FROM events"


@query(f"""WITH u AS (SELECT key, s, e, d, 'observed_event' AS k FROM ({_TIMED}) UNION ALL SELECT key, s - 1, e - 2, d, 'caption_span' FROM ({_TIMED}) WHERE d = 'view')
SELECT key, s AS start_sec, e AS end_sec, d AS description, k AS kind, row_number() OVER (PARTITION BY key ORDER BY s, e, k, d)::INT AS number FROM u WHERE e >= s""")
def atomic_evidence(spark, sf_dir):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    rows = _t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), start.alias("start_sec"), (start + F.col("value")).alias("end_sec"), F.col("event_type").alias("description"))
    spans = rows.where("description = 'view'").withColumn("start_sec", F.col("start_sec") - 1).withColumn("end_sec", F.col("end_sec") - 2)
    return evidence.atomic_evidence(rows, spans)


@query("""WITH u AS (SELECT o_custkey AS key, o_orderstatus AS entity, o_orderkey * 60.0 AS b, 60.0 AS d, CASE WHEN o_orderkey % 4 > 0 THEN (o_orderkey % 50)::DOUBLE - 10 END AS s, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 90)::DOUBLE END AS e FROM orders),
t AS (SELECT key, entity, b + greatest(0, coalesce(s, 0)) AS start_sec, b + least(d, coalesce(e, d)) AS end_sec FROM u WHERE entity <> '')
SELECT *, row_number() OVER (PARTITION BY key, entity ORDER BY start_sec, end_sec)::INT AS observation FROM t WHERE end_sec >= start_sec""")
def entity_tracks(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), F.col("o_orderstatus").alias("entity"), (key * 60.0).alias("base"), F.lit(60.0).alias("duration"),
        F.when(key % 4 > 0, (key % 50).cast("double") - 10).alias("start_sec"), F.when(key % 5 > 0, (key % 90).cast("double")).alias("end_sec"),
    )
    return evidence.entity_tracks(rows)


@query("""WITH c AS (SELECT o_orderpriority AS task, o_orderkey AS id, o_custkey % 40 AS ev, o_orderkey % 6 AS cx, o_totalprice AS sp FROM orders), f AS (SELECT task, ev, arg_min(id, (-cx, -sp, id)) AS id FROM c GROUP BY 1, 2),
r AS (SELECT f.task, f.id, row_number() OVER (PARTITION BY f.task ORDER BY cx DESC, sp DESC, f.id)::INT AS rank FROM f JOIN c ON c.id = f.id) SELECT * FROM r WHERE rank <= 10""")
def ranked_candidates(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("task"), F.col("o_orderkey").alias("id"), F.array(F.col("o_custkey") % 40).alias("evidence"), (F.col("o_orderkey") % 6).alias("complexity"), F.col("o_totalprice").alias("span"))
    return evidence.ranked_candidates(rows, 10).select("task", "id", "rank")


@query("""SELECT o_custkey AS g, arg_min(o_orderkey, (o_orderstatus <> 'F', abs(o_orderkey % 5 - 2), -o_totalprice, o_orderkey)) AS id FROM orders GROUP BY 1""")
def frontier_choices(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("g"), F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", "frontier").otherwise("easy").alias("bucket"), (F.col("o_orderkey") % 5).alias("correct"), F.col("o_totalprice").alias("span"), F.col("o_orderkey").alias("ordinal"))
    return evidence.frontier_choice(rows, ["g"]).select("g", "id")


@query("""WITH o AS (SELECT *, o_orderkey % 5 AS a, o_orderkey % 7 AS b FROM orders) SELECT o_orderkey AS id, a = 0 AND b = 0 OR a IN (1, 2) AND b IN (1, 2, 3) AS ready, a NOT IN (0, 3) AND b NOT IN (0, 4) AS complete FROM o""")
def quality_audits(spark, sf_dir):
    a, b = F.col("o_orderkey") % 5, F.col("o_orderkey") % 7
    value = F.when(a == 1, "High").when(a == 2, " training_ready").when(a == 3, "unknown").when(a == 4, "low").otherwise("")
    grounding = F.when(b.isin(1, 2, 3), "Verified").when(b == 4, "not_assessed").when(b == 5, "ungrounded").when(b == 6, "absent")
    shortcut, strong = F.when(a == 0, "").otherwise("low"), F.when(a == 0, None).otherwise("strong")
    ready = gates.training_ready(value, grounding, shortcut, strong)
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), ready.alias("ready"), gates.complete_audit(value, grounding, shortcut, strong).alias("complete"))


@query("""WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'F' THEN 'state_change' ELSE 'counting' END AS task, o_orderkey % 4 AS u, o_custkey % 4 AS h FROM orders),
r AS (SELECT *, CASE WHEN u < 1 THEN 'insufficient_evidence_units' WHEN h < 2 THEN 'insufficient_reasoning_hops' WHEN task = 'state_change' AND u < 2 AND h <> 3 THEN 'cross_observation_required' END AS reason FROM o)
SELECT 'input' AS name, count(*) AS n FROM r UNION ALL SELECT CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected_' || reason END, count(*) FROM r GROUP BY 1""")
def complexity_gate(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.when(F.col("o_orderstatus") == "F", "state_change").otherwise("counting").alias("task"), (F.col("o_orderkey") % 4).alias("u"), (F.col("o_custkey") % 4).alias("h"))
    return gates.gated(rows, gates.complexity_problem(F.col("task"), F.col("u"), F.col("h"), F.lit(None).cast("int"), F.lit(2), F.col("h") == 3))[1]


@query("""SELECT c_custkey AS id, CASE c_custkey % 6 WHEN 0 THEN 'missing_question' WHEN 1 THEN 'unknown_citations' WHEN 2 THEN 'choices_not_four' WHEN 3 THEN 'answer_not_unique_choice' WHEN 4 THEN NULL ELSE NULL END AS reason FROM customer""")
def handoff_problems(spark, sf_dir):
    k = F.col("c_custkey") % 6
    strings = lambda *x: F.array(*map(F.lit, x))
    cited = F.when(k == 1, strings("e1", "e9")).when(k == 4, strings("e1"))
    choices = F.when(k == 2, strings("a", "b")).when(k == 3, strings("a", "b", "c", "d")).otherwise(F.array(F.lit("a"), "c_name", F.lit("c"), F.lit("d")))
    reason = gates.handoff_problem(F.when(k != 0, F.col("c_name")), F.col("c_name"), cited, strings("e1", "e2"), choices)
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), reason.alias("reason"))


@query("""SELECT c_custkey AS id, CASE c_custkey % 7 WHEN 0 THEN 'must_have_exactly_four_nonempty_choices' WHEN 1 THEN 'duplicate_choices' WHEN 2 THEN 'answer_must_match_one_choice' WHEN 3 THEN 'generic_meta_distractor'
WHEN 4 THEN 'option_length_outlier' WHEN 5 THEN 'answer_leaked_in_question' END AS reason FROM customer""")
def distractor_problems(spark, sf_dir):
    k = F.col("c_custkey") % 7
    strings = lambda *x: F.array(*map(F.lit, x))
    four = ("red car turns left", "red car turns right", "red car goes ahead", "red car stops there")
    choices = F.when(k == 0, strings(*four[:3], " ")).when(k == 1, strings(four[0], four[0].upper(), *four[2:])).when(k == 3, strings(*four[:3], "None of  the above")).when(k == 4, strings("blue boat leaves harbour", "green boat leaves harbour", "white boat leaves harbour", "it")).otherwise(strings(*four))
    answer = F.when(k == 2, F.lit("no such choice")).when(k == 4, F.lit("blue boat leaves harbour")).otherwise(four[0])
    question = F.when(k == 5, F.lit("Red car turns left?")).otherwise("What happens?")
    return _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), gates.distractor_problem(question, choices, answer).alias("reason"))


@query("SELECT o_orderkey AS id, coalesce(o_orderstatus = 'F', false) AS kept, CASE WHEN o_orderstatus = 'F' THEN 'a' ELSE 'a,env' END AS tags FROM orders")
def environment_gate(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.when(F.col("o_orderstatus") == "F", True).when(F.col("o_orderstatus") == "O", False).alias("ok"), F.when(F.col("o_orderstatus") == "F", F.array(F.lit("a"), F.lit("env"))).otherwise(F.array(F.lit("a"))).alias("tags"))
    good, bad = gates.environment_gate(rows, F.col("ok"), "tags", "env")
    out = good.withColumn("kept", F.lit(True)).union(bad.withColumn("kept", F.lit(False)))
    return out.select("id", "kept", F.array_join("tags", ",").alias("tags"))


@query("SELECT 'kept' AS side, n_nationkey::BIGINT AS k FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 'unknown', 99")
def narrowed_pool(spark, sf_dir):
    nation = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"))
    kept, unknown = gates.narrowed(nation, nation.where("k % 3 = 0").union(spark.createDataFrame([(99,)], "k long")), "k")
    return kept.select(F.lit("kept").alias("side"), "k").union(unknown.select(F.lit("unknown"), "k"))


@query("""WITH e AS (SELECT o_custkey AS key, o_orderkey AS id, (o_orderkey % 100)::DOUBLE AS s, (o_orderkey % 100 + o_orderkey % 7)::DOUBLE AS e, o_orderstatus AS ent, CASE WHEN o_orderkey % 11 = 0 THEN 'Z' ELSE o_orderstatus END AS named FROM orders),
v AS (SELECT key, id, s - 0.5 AS s, CASE WHEN id % 5 = 0 THEN e - 2 ELSE e END AS e, ent FROM e WHERE id % 13 > 0), l AS (SELECT *, lag(e) OVER (PARTITION BY key ORDER BY id) AS b, count(*) OVER (PARTITION BY key) AS n FROM e)
SELECT l.key, l.id, CASE WHEN n > 8 THEN 'too_many_events' WHEN l.s < 4.25 OR l.e > 99.75 THEN 'outside_proposal' WHEN l.s < b - 0.75 THEN 'not_chronological' WHEN v.id IS NULL THEN 'unknown_evidence'
WHEN l.s < v.s - 0.75 OR l.e > v.e + 0.75 THEN 'outside_evidence' WHEN named <> v.ent THEN 'unknown_entities' END AS reason FROM l LEFT JOIN v ON l.key = v.key AND l.id = v.id""")
def event_problems(spark, sf_dir):
    key = F.col("o_orderkey")
    rows = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("key"), key.alias("id"), (key % 100).cast("double").alias("start"), (key % 100 + key % 7).cast("double").alias("end"), F.array(key).alias("cited"),
        F.array(F.when(key % 11 == 0, "Z").otherwise(F.col("o_orderstatus"))).alias("entities"), F.lit(5.0).alias("low"), F.lit(99.0).alias("high"), F.array("o_orderstatus").alias("own"),
    )
    those = rows.where("id % 13 > 0").select("key", "id", (F.col("start") - 0.5).alias("start"), F.when(F.col("id") % 5 == 0, F.col("end") - 2).otherwise(F.col("end")).alias("end"), F.col("own").alias("entities"))
    return gates.event_problems(rows.drop("own"), those)


@query("""SELECT o_orderkey AS id, CASE o_orderkey % 6 WHEN 0 THEN 'score_not_finite' WHEN 1 THEN 'categories_do_not_sum' WHEN 2 THEN 'score_is_not_the_ratio' WHEN 3 THEN 'total_does_not_match' END AS reason FROM orders""")
def result_problems(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    score = F.when(k == 0, F.lit(float("nan"))).when(k == 2, F.lit(0.4)).otherwise(0.5)
    total = F.when(k == 3, F.lit(30)).when(k == 4, F.lit(20)).otherwise(40)
    reason = gates.result_problem(score, F.when(k == 2, F.lit(20)).otherwise(total / 2), total, F.lit(20), F.when(k == 1, F.lit(19)).otherwise(20), F.lit(20), F.lit(2))
    return _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), reason.alias("reason"))


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'watch' WHEN 'purchase' THEN 'buy' ELSE 'generic' END AS route FROM events")
def routed_events(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", gates.route(F.col("event_type"), {"view": "watch", "purchase": "buy"}, "generic").alias("route"))


@query("""WITH s AS (SELECT o_orderkey AS id, o_orderstatus <> 'P' AS env, CASE WHEN o_orderkey % 5 > 0 THEN (o_orderkey % 6)::DOUBLE END AS a, (o_custkey % 6)::DOUBLE AS b FROM orders), w AS (SELECT *, CASE WHEN a IS NULL THEN b ELSE (2 * a + b) / 3 END AS m,
list_filter([CASE WHEN a IS NULL THEN 'missing_axis:a' WHEN a < 3 THEN 'below_minimum:a' END, CASE WHEN b < 2 THEN 'below_minimum:b' END], lambda x: x IS NOT NULL) AS f FROM s)
SELECT id, env AND len(f) = 0 AND m >= 3.5 AS good, CASE WHEN env THEN round(m, 6) END AS average, CASE WHEN NOT env THEN 'environment_invalid' WHEN len(f) > 0 THEN array_to_string(f, ',') WHEN m < 3.5 THEN 'below_minimum_average' ELSE '' END AS failures FROM w""")
def rubric_decisions(spark, sf_dir):
    scores = F.map_filter(F.create_map(F.lit("a"), F.when(F.col("o_orderkey") % 5 > 0, (F.col("o_orderkey") % 6).cast("double")), F.lit("b"), (F.col("o_custkey") % 6).cast("double")), lambda k, v: v.isNotNull())
    made = ledger.rubric_decision({"a": (3.0, 2.0), "b": (2.0, 1.0)}, 3.5, F.col("o_orderstatus") != "P", scores)
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), made.alias("r"))
    return rows.select("id", "r.good", F.round("r.average", 6).alias("average"), F.array_join("r.failures", ",").alias("failures"))


@query("""WITH p AS (SELECT l_linenumber % 4 AS k, count(*) AS n FROM lineitem WHERE l_quantity < 40 GROUP BY 1) SELECT sum(n)::BIGINT AS total, count(*) AS coverage, round(max(n) / sum(n), 6) AS largest_share, sum(n) >= 8 AND round(max(n) / sum(n), 6) > 0.45 AS severe_skew FROM p""")
def position_skew(spark, sf_dir):
    names = F.array(*map(F.lit, ("n0", "n1", "n2", "n3")))
    answer = F.when(F.col("l_quantity") < 40, F.concat(F.lit(" N"), (F.col("l_linenumber") % 4).cast("string"))).otherwise("other")
    return summaries.position_skew(_t(spark, sf_dir, "lineitem"), summaries.answer_position(names, answer))


@query("WITH s AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT count(*) AS identified, sum((n > 1)::BIGINT)::BIGINT AS repeated, sum(n - 1)::BIGINT AS correlated, max(n) AS most FROM s")
def repeated_sources(spark, sf_dir):
    return summaries.repeated_sources(_t(spark, sf_dir, "orders"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey").cast("string")).otherwise(""))


@query("""SELECT CASE WHEN o_orderpriority = '5-LOW' THEN 'unrouted' ELSE o_orderpriority END AS route, count(*) AS total, sum((o_totalprice > 50000)::BIGINT)::BIGINT AS hard_valid, sum((o_totalprice > 50000 AND o_orderstatus = 'F')::BIGINT)::BIGINT AS accepted,
sum((o_totalprice > 50000 AND o_orderstatus = 'P')::BIGINT)::BIGINT AS reserve FROM orders GROUP BY 1""")
def route_metrics(spark, sf_dir):
    route = F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise(F.col("o_orderpriority"))
    pool = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "P", "replayable").otherwise("rejected")
    return summaries.route_metrics(_t(spark, sf_dir, "orders"), route, F.when(F.col("o_totalprice") <= 50000, "cheap"), pool)


@query("""SELECT count(*) AS n, sum((o_orderkey % 3 = 0)::BIGINT)::BIGINT AS audited, sum((o_orderkey % 3 = 0 AND o_custkey % 2 = 0)::BIGINT)::BIGINT AS ready, sum((o_orderkey % 3 = 0 AND o_custkey % 2 = 0)::BIGINT)::BIGINT AS promoted,
round(sum((o_orderkey % 3 = 0 AND o_custkey % 2 = 0)::BIGINT) / 100000, 6) AS score FROM orders WHERE o_orderstatus = 'F'""")
def promoted_frontier(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return summaries.promotion(rows, 100_000, F.col("o_orderkey") % 3 == 0, F.col("o_custkey") % 2 == 0, F.lit(True))


@query("""WITH m AS (SELECT l_orderkey AS record, l_linenumber - 1 AS c, l_returnflag = 'R' OR l_quantity > 25 AS met, l_suppkey % 5 = 0 AS crit FROM lineitem), g AS (SELECT record, count(*) = 4 AND count(DISTINCT c) FILTER (c BETWEEN 0 AND 3) = 4 AS complete, round(sum(met::INT) / 4, 6) AS rate, bool_or(crit) AS crit FROM m GROUP BY 1)
SELECT record, complete, rate, complete AND rate >= 0.6 AND NOT crit AS passed FROM g""")
def criteria_rates(spark, sf_dir):
    marks = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), (F.col("l_linenumber") - 1).alias("criterion"), ((F.col("l_returnflag") == "R") | (F.col("l_quantity") > 25)).alias("met"), (F.col("l_suppkey") % 5 == 0).alias("critical"))
    return summaries.criteria_rates(marks, 4)


@query("SELECT name, sum(n)::BIGINT AS n FROM (SELECT o_orderpriority AS name, o_orderkey % 9 AS n FROM orders UNION ALL SELECT o_orderstatus, 1 FROM orders) GROUP BY name")
def merged_counts(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.create_map("o_orderpriority", F.col("o_orderkey") % 9, "o_orderstatus", F.lit(1).cast("long")).alias("m"))
    return summaries.merged_counts(rows, "m")


@query("SELECT o_orderstatus AS namespace, o_orderpriority AS name, sum(o_orderkey % 7)::BIGINT AS calls, sum(coalesce(nullif(o_custkey % 5, 0), 0))::BIGINT AS tokens FROM orders GROUP BY 1, 2")
def merged_usage(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("namespace"), F.col("o_orderpriority").alias("name"), (F.col("o_orderkey") % 7).alias("calls"), F.nullif(F.col("o_custkey") % 5, F.lit(0)).alias("tokens"))
    return summaries.merged_usage(rows)


@query("SELECT sum((o_orderstatus = 'F')::BIGINT)::BIGINT AS accepted, round(avg(CASE WHEN o_orderstatus = 'F' THEN (o_orderpriority = '5-LOW')::INT END), 6) AS too_easy_rate, bool_and(o_orderstatus <> 'F' OR o_totalprice > 0) AS priced, bool_and(o_orderstatus <> 'F' OR o_custkey % 2 = 0) AS even FROM orders")
def run_evaluation(spark, sf_dir):
    easy = F.when(F.col("o_orderpriority") == "5-LOW", "easy").otherwise("hard")
    return summaries.run_evaluation(_t(spark, sf_dir, "orders"), F.col("o_orderstatus") == "F", easy, {"priced": F.col("o_totalprice") > 0, "even": F.col("o_custkey") % 2 == 0})


@query("SELECT sum(o_orderkey % 7)::BIGINT AS calls, sum(CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE 0 END)::BIGINT AS seconds FROM orders")
def overhead_totals(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select((F.col("o_orderkey") % 7).alias("calls"), F.when(F.col("o_orderstatus") == "F", F.col("o_custkey")).alias("seconds"))
    return summaries.overhead(rows, ["calls", "seconds"])


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 0 THEN 'new' ELSE c_mktsegment END AS v, CASE WHEN c_custkey % 10 = 0 THEN 1 END AS round FROM customer UNION ALL SELECT -1, 'new', 1")
def upserted(spark, sf_dir):
    old = _t(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("id"), F.col("c_mktsegment").alias("v"))
    new = old.where("id % 10 = 0").select("id").union(spark.createDataFrame([(-1,)], "id long")).select("id", F.lit("new").alias("v"), F.lit(1).alias("round"))
    return records.union_ragged(records.upsert(old.withColumn("round", F.lit(None).cast("int")), new, ["id"]))


@query("SELECT o_custkey AS key FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 4 > 0) GROUP BY 1")
def dangling_references(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.array(F.col("o_custkey")).alias("refs"))
    return records.dangling(rows, "refs", _t(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("key")), "key")


@query("SELECT l_orderkey AS id, l_linenumber AS line, CASE WHEN l_linenumber > 1 THEN l_quantity END AS quantity FROM lineitem")
def nan_as_null(spark, sf_dir):
    value = F.when(F.col("l_linenumber") > 1, F.col("l_quantity").cast("double")).otherwise(F.lit(float("nan")))
    return records.nan_as_null(_t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("line"), value.alias("quantity")))
