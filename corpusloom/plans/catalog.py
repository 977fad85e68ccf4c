"""All queries of the library over the driver's tables, with SQL that gives the same rows.

Tables without a counterpart stand in by role: events for timed evidence and usage, line items for sampled answers, orders for
campaign rows, customers, nations and regions for registries. Their columns then have the role, not the meaning.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import conversations, decontamination, embeddings, evidence, ledger, review, scoring

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries have the name {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from corpusloom.plans import campaigns, harness, judging, rounds, stores  # noqa: F401  add their own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from corpusloom.plans import campaigns, harness, judging, rounds, stores  # noqa: F401

    return dict(_SQL)


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_GRAMS = r"""
WITH words AS (
  SELECT {id} AS id, text, list_filter(string_split_regex(regexp_replace(regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'),
    '([\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{AC00}}-\x{{D7AF}}])', ' \1 ', 'g'), '\s+'), lambda x: x <> '') AS w FROM {table} WHERE trim(text) <> ''),
grams AS (
  SELECT id, unnest(CASE WHEN len(w) >= 13 THEN list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM words)
"""
_DOC, _REF = _GRAMS.format(id="doc_id", table="documents"), _GRAMS.format(id="item_id", table="benchmark")
_FLAGS = f"""SELECT d.doc_id AS id, h.example IS NOT NULL AS hit, h.example AS example FROM documents d
LEFT JOIN (SELECT id, min(gram) AS example FROM ({_DOC} SELECT id, gram FROM grams) WHERE gram IN ({_REF} SELECT gram FROM grams) GROUP BY id) h ON d.doc_id = h.id WHERE trim(d.text) <> ''"""


@query(_FLAGS)
def contamination_flags(spark, sf_dir):
    return decontamination.contamination_flags(_t(spark, sf_dir, "documents"), _t(spark, sf_dir, "benchmark"), "doc_id")


@query(f"SELECT count(*) AS total, coalesce(sum(hit::BIGINT), 0)::BIGINT AS hits, round(coalesce(sum(hit::BIGINT) / count(*), 0), 6) AS rate, min(example) AS example FROM ({_FLAGS})")
def contamination_report(spark, sf_dir):
    return decontamination.contamination_report(contamination_flags(spark, sf_dir))


@query(f"{_REF} SELECT DISTINCT gram FROM grams")
def reference_grams(spark, sf_dir):
    return decontamination.gram_index(_t(spark, sf_dir, "benchmark"))


@query("""SELECT count(*) AS n_rows, round(1 - count(DISTINCT (text, lang, source)) / count(*), 6) AS record_duplicate_rate,
round(sum((text IS NULL OR trim(text) = '')::INT + (lang IS NULL OR trim(lang) = '')::INT) / (count(*) * 2), 6) AS null_slot_rate FROM documents""")
def hard_metrics(spark, sf_dir):
    return review.hard_metrics(_t(spark, sf_dir, "documents").select("text", "lang", "source"), ["text", "lang"])


@query("SELECT 'text' AS field, quantile_cont(length(text), 0.5) AS median_length, round(1 - count(DISTINCT md5(coalesce(text, ''))) / count(*), 6) AS duplicate_rate FROM documents")
def content_duplicates(spark, sf_dir):
    return review.content_duplicate_rates(_t(spark, sf_dir, "documents"), ["text", "lang", "source"])


@query("""SELECT field, value, n FROM (SELECT *, count(*) OVER (PARTITION BY field) AS kinds FROM (
SELECT 'lang' AS field, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL
SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source UNION ALL
SELECT 'doc_id', doc_id::VARCHAR, count(*) FROM documents GROUP BY doc_id)) WHERE kinds <= 20""")
def value_profile(spark, sf_dir):
    return review.value_profile(_t(spark, sf_dir, "documents"), ["lang", "source", "doc_id"])


@query("""WITH s AS (SELECT 0 AS step, 'all' AS name, count(*) AS n_rows FROM documents UNION ALL SELECT 1, 'long', count(*) FROM documents WHERE n_chars >= 400
UNION ALL SELECT 2, 'distinct', count(DISTINCT text) FROM documents WHERE n_chars >= 400 UNION ALL SELECT 3, 'english', count(DISTINCT text) FROM documents WHERE n_chars >= 400 AND lang = 'en'),
r AS (SELECT *, lag(n_rows) OVER (ORDER BY step) AS b FROM s)
SELECT step, name, n_rows, CASE WHEN b > 0 THEN round(n_rows / b, 6) END AS retention, CASE WHEN n_rows = 0 THEN 'empty' WHEN b > 0 AND round(n_rows / b, 6) < 0.5 THEN 'low_retention' END AS warning FROM r""")
def step_funnel(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    long = docs.where("n_chars >= 400")
    distinct = review.first_of_each(long.where("text is not null"), F.col("text"), ["doc_id"])
    english = review.first_of_each(long.where("text is not null and lang = 'en'"), F.col("text"), ["doc_id"])
    steps = [d.agg(F.count("*").alias("n_rows")).select(F.lit(k).alias("step"), F.lit(n).alias("name"), "n_rows") for k, (n, d) in enumerate((("all", docs), ("long", long), ("distinct", distinct), ("english", english)))]
    out = steps[0]
    for s in steps[1:]:
        out = out.union(s)
    return review.funnel(out)


@query("""SELECT min(n) AS shortest, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95, quantile_cont(n, 0.99) AS p99, max(n) AS longest,
sum((n > 512)::BIGINT)::BIGINT AS over_cutoff, round(sum(least(n, 512)) / sum(n), 6) AS retained FROM (SELECT len(list_filter(string_split_regex(coalesce(text, ''), '\\s+'), lambda x: x <> ''))::INT AS n FROM documents)""".replace("\\\\", "\\"))
def token_lengths(spark, sf_dir):
    return review.token_lengths(_t(spark, sf_dir, "documents"), "text", 512)


@query("SELECT doc_id, lang FROM documents ORDER BY md5('7:' || doc_id::VARCHAR), doc_id LIMIT 50")
def seeded_sample(spark, sf_dir):
    return review.seeded_sample(_t(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id", 50, 7)


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY md5(coalesce(lower(trim(regexp_replace(text, '\\s+', ' ', 'g'))), '')) ORDER BY doc_id) AS r FROM documents) WHERE r = 1".replace("\\\\", "\\"))
def exact_dedup(spark, sf_dir):
    docs = _t(spark, sf_dir, "documents")
    return review.first_of_each(docs, F.md5(F.coalesce(F.lower(X.collapsed(F.col("text"))), F.lit(""))), ["doc_id"]).select("doc_id", "source")


@query("SELECT lang, doc_id, n_chars, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id)::INT AS r FROM documents) WHERE r <= 5")
def top_per_language(spark, sf_dir):
    return review.top_per_group(_t(spark, sf_dir, "documents").select("lang", "doc_id", "n_chars"), ["lang"], [F.desc("n_chars"), "doc_id"], 5)


@query("WITH n AS (SELECT count(*) AS n FROM documents) SELECT r::INT AS shard, n * r // 7 AS start, n * (r + 1) // 7 AS stop FROM n, range(7) t(r)")
def shard_ranges(spark, sf_dir):
    return review.shard_ranges(_t(spark, sf_dir, "documents"), ["doc_id"], 7)


@query("""WITH a AS (SELECT *, min(CASE WHEN turn = f THEN role END) OVER (PARTITION BY conv_id) AS r0 FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS f FROM conversations)),
b AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - CASE WHEN r0 = 'system' THEN 2 ELSE 1 END AS i FROM a),
c AS (SELECT conv_id, count(*) AS n_turns, count(*) FILTER (i >= 0) AS body, bool_and(i < 0 OR role = CASE WHEN i % 2 = 0 THEN 'user' ELSE 'assistant' END) AS ok, bool_or(text IS NULL OR trim(text) = '') AS blank FROM b GROUP BY conv_id)
SELECT conv_id, n_turns, coalesce(body >= 2 AND body % 2 = 0 AND ok AND NOT blank, false) AS valid FROM c""")
def conversation_validity(spark, sf_dir):
    return conversations.conversation_validity(_t(spark, sf_dir, "conversations"))


@query("""SELECT conv_id, turn, text AS instruction, '' AS input, o AS output FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS o FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND r = 'assistant' AND trim(text) <> '' AND trim(o) <> ''""")
def supervised_pairs(spark, sf_dir):
    return conversations.supervised_pairs(_t(spark, sf_dir, "conversations"))


_UNIT = "SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings WHERE embedding IS NOT NULL"


@query(f"""WITH u AS ({_UNIT}), x AS (SELECT v FROM u WHERE label < 5), y AS (SELECT v FROM u WHERE label >= 5),
k AS (SELECT 'xx' AS s, avg(exp(-(2 - 2 * list_dot_product(a.v, b.v)) / 2)) AS m FROM x a, x b UNION ALL SELECT 'yy', avg(exp(-(2 - 2 * list_dot_product(a.v, b.v)) / 2)) FROM y a, y b
UNION ALL SELECT 'xy', avg(exp(-(2 - 2 * list_dot_product(a.v, b.v)) / 2)) FROM x a, y b) SELECT round(sum(CASE s WHEN 'xy' THEN -2 * m ELSE m END), 6) AS mmd FROM k""")
def embedding_mmd(spark, sf_dir):
    """All vectors of the labels below 5 against all others."""
    rows = _t(spark, sf_dir, "embeddings")
    return spark.createDataFrame([(round(embeddings.rbf_mmd(rows.where("label < 5"), rows.where("label >= 5")), 6),)], "mmd double")


@query(f"""WITH u AS ({_UNIT}), n AS (SELECT a.vec_id, max(list_dot_product(a.v, b.v)) AS nearest FROM u a, u b WHERE a.vec_id <> b.vec_id GROUP BY a.vec_id)
SELECT count(*) AS n, round(avg(nearest), 6) AS mean, round(quantile_cont(nearest, 0.5), 6) AS p50, round(quantile_cont(nearest, 0.9), 6) AS p90, round(quantile_cont(nearest, 0.95), 6) AS p95, round(quantile_cont(nearest, 0.99), 6) AS p99 FROM n""")
def embedding_nearest(spark, sf_dir):
    return embeddings.nearest_summary(embeddings.nearest_cosines(_t(spark, sf_dir, "embeddings"), "vec_id"))


@query("""WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings WHERE embedding IS NOT NULL),
s AS (SELECT i, sum(v[i]) AS s FROM u, range(1, 65) t(i) GROUP BY i) SELECT (SELECT count(*) FROM u) AS n, round((sum(s * s) - (SELECT count(*) FROM u)) / ((SELECT count(*) FROM u) * ((SELECT count(*) FROM u) - 1)), 6) AS mean_cosine FROM s""")
def mean_pairwise_cosine(spark, sf_dir):
    return embeddings.mean_pairwise_cosine(_t(spark, sf_dir, "embeddings"), 64)


@query()
def vendi_score(spark, sf_dir):
    score, ratio = embeddings.vendi(_t(spark, sf_dir, "embeddings"))
    return spark.createDataFrame([(round(score, 6), round(ratio, 6))], "vendi double, ratio double")


_UNITS = "SELECT event_id AS id, user_id AS key, epoch_us(ts) / 1e6 AS s, epoch_us(ts) / 1e6 + value AS e FROM events"


def _units(spark, sf_dir, *more):
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return _t(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), start.alias("start"), (start + F.col("value")).alias("end"), *more)


@query(f"WITH u AS ({_UNITS}) SELECT a.key, a.id, arg_min(b.id, (b.s, b.id)) AS next_id FROM u a LEFT JOIN u b ON a.key = b.key AND b.s > a.e GROUP BY a.key, a.id")
def earliest_later(spark, sf_dir):
    return evidence.earliest_later(_units(spark, sf_dir))


@query(f"SELECT key, id, n AS next_id FROM (SELECT *, lead(id) OVER w AS n, lead(s) OVER w AS ns FROM ({_UNITS}) WINDOW w AS (PARTITION BY key ORDER BY s, e, id)) WHERE ns >= e")
def neighbours(spark, sf_dir):
    return evidence.neighbours(_units(spark, sf_dir))


@query(f"SELECT a.key, a.id, b.id AS other_id FROM ({_UNITS}) a JOIN ({_UNITS}) b ON a.key = b.key AND a.e >= b.s AND a.s <= b.e WHERE a.id < b.id")
def overlapping(spark, sf_dir):
    u = _units(spark, sf_dir)
    return evidence.overlapping(u, u, ["key"]).where("id < other_id")


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, id) AS r, count(*) OVER (PARTITION BY key) AS n FROM ({_UNITS}))
SELECT key, max(n) AS n, max(CASE WHEN r = 1 THEN id END) AS first_id, max(CASE WHEN r = n // 2 + 1 THEN id END) AS middle_id, max(CASE WHEN r = n THEN id END) AS last_id FROM r GROUP BY key""")
def anchors(spark, sf_dir):
    return evidence.anchors(_units(spark, sf_dir))


@query("""WITH w AS (SELECT l_orderkey AS candidate, unnest(list_distinct(list(l_partkey))) AS id FROM lineitem GROUP BY l_orderkey), p AS (SELECT p_partkey, p_size::DOUBLE AS s, (p_size + 1)::DOUBLE AS e FROM part WHERE p_size > 5)
SELECT candidate, count(s) AS units, min(s) AS window_start, max(e) AS window_end FROM w LEFT JOIN p ON id = p_partkey GROUP BY candidate HAVING count(*) = count(s)""")
def selected_evidence(spark, sf_dir):
    parts = _t(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").alias("id"), F.col("p_size").cast("double").alias("start"), (F.col("p_size") + 1).cast("double").alias("end"))
    wanted = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("candidate")).agg(F.collect_list("l_partkey").alias("wanted"))
    return evidence.selected_evidence(wanted, parts)


@query()
def fused_events(spark, sf_dir):
    u = _units(spark, sf_dir, "event_type")
    return evidence.fused_events(u.select("key", "id", "start", "end", F.lit(0).alias("segment"), F.array("event_type").alias("entities"), F.col("event_type").alias("text")), max_gap=3600, max_event=86_400)


_ANSWERS = "SELECT l_linestatus AS benchmark, l_orderkey AS question_id, nullif(l_returnflag, 'N') AS predicted, 'R' AS correct, CASE WHEN l_quantity > 45 THEN 'length' ELSE 'stop' END AS finish_reason FROM lineitem"


def _answers(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_linestatus").alias("benchmark"), F.col("l_orderkey").alias("question_id"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("predicted"), F.lit("R").alias("correct"), F.when(F.col("l_quantity") > 45, "length").otherwise("stop").alias("finish_reason"))


_SCORES = f"""SELECT benchmark, count(*) AS questions, min(k) AS least_k, max(k) AS most_k, round(avg(g), 6) AS score, sum(w)::BIGINT AS wrong, sum(u)::BIGINT AS parse_failures, sum(c)::BIGINT AS runaway FROM (
SELECT benchmark, question_id, avg((coalesce(predicted = correct, false) AND finish_reason <> 'length')::INT) AS g, count(*) AS k, sum((predicted <> correct)::INT) FILTER (predicted IS NOT NULL) AS w0, coalesce(sum((predicted <> correct)::INT), 0) AS w,
sum((predicted IS NULL)::INT) AS u, sum((finish_reason = 'length')::INT) AS c FROM ({_ANSWERS}) GROUP BY 1, 2) GROUP BY benchmark"""


@query(_SCORES)
def benchmark_scores(spark, sf_dir):
    return scoring.benchmark_scores(_answers(spark, sf_dir))


@query(f"SELECT round(avg(score), 6) AS \"primary\", 'X,Z' AS missing FROM ({_SCORES})")
def macro_average(spark, sf_dir):
    return scoring.macro_average(benchmark_scores(spark, sf_dir), ["F", "O", "X", "Z"])


@query("""SELECT l_returnflag AS benchmark, round(avg(CASE WHEN l_quantity <= 40 THEN l_quantity END), 6) AS mean, round(avg(CASE WHEN l_quantity <= 40 THEN l_quantity / 40 END), 6) AS normalized, sum((l_quantity > 40)::BIGINT)::BIGINT AS invalid FROM lineitem GROUP BY 1""")
def native_scale_mean(spark, sf_dir):
    return scoring.native_scale_mean(_t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("benchmark"), F.col("l_quantity").alias("score")), {"A": 40.0, "N": 40.0, "R": 40.0})


@query("""WITH r AS (SELECT o_orderstatus AS st, o_orderpriority AS pr, (o_totalprice > 100000)::INT AS g FROM orders)
SELECT 'overall' AS facet, 'all' AS value, count(*) AS n, round(avg(g), 6) AS accuracy FROM r UNION ALL SELECT 'st', coalesce(st, 'unknown'), count(*), round(avg(g), 6) FROM r GROUP BY 2 UNION ALL SELECT 'pr', coalesce(pr, 'unknown'), count(*), round(avg(g), 6) FROM r GROUP BY 2""")
def grouped_accuracy(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("st"), F.col("o_orderpriority").alias("pr"), "o_totalprice")
    return scoring.grouped_accuracy(rows, ["st", "pr"], F.col("o_totalprice") > 100000)


@query("""WITH s AS (SELECT l_orderkey AS question, l_linenumber::BIGINT * 1000000 + l_partkey AS sample, nullif(l_returnflag, 'N') AS answer, l_returnflag = 'R' AS good FROM lineitem), v AS (SELECT question, answer, count(*) AS n, min(sample) AS f FROM s WHERE answer IS NOT NULL GROUP BY 1, 2)
SELECT q.*, m.answer AS majority, coalesce(m.answer = 'R', false) AS majority_good FROM (SELECT question, count(*) AS samples, bool_or(good) AS pass_n, round(avg(good::INT), 6) AS avg_n, round(count(answer) / count(*), 6) AS format_rate FROM s GROUP BY 1) q
LEFT JOIN (SELECT question, arg_min(answer, (-n, f, answer)) AS answer FROM v GROUP BY 1) m USING (question)""")
def majority_votes(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("question"), (F.col("l_linenumber").cast("long") * 1_000_000 + F.col("l_partkey")).alias("sample"), F.nullif(F.col("l_returnflag"), F.lit("N")).alias("answer"), (F.col("l_returnflag") == "R").alias("good"))
    return scoring.majority_votes(rows)


@query("""WITH h AS (SELECT o_orderpriority AS benchmark, year(o_orderdate)::INT AS step, round(avg(o_totalprice), 2) AS score FROM orders GROUP BY 1, 2)
SELECT benchmark, step, score, round(score - lag(score) OVER w, 6) AS from_previous, round(score - first_value(score) OVER w, 6) AS from_first FROM h WINDOW w AS (PARTITION BY benchmark ORDER BY step)""")
def score_deltas(spark, sf_dir):
    history = _t(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("benchmark"), F.year("o_orderdate").alias("step")).agg(F.round(F.avg("o_totalprice"), 2).alias("score"))
    return scoring.score_deltas(history)


@query("SELECT user_id, max_by.event_id AS event_id, max_by.event_type AS event_type FROM (SELECT user_id, arg_max({'event_id': event_id, 'event_type': event_type}, (ts, event_id)) AS max_by FROM events GROUP BY user_id)")
def latest_event(spark, sf_dir):
    return scoring.latest(_t(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT coalesce(event_type, '∅') AS event_type, count(*) AS n, sum((value > 5)::BIGINT)::BIGINT AS good, sum((props->>'k')::BIGINT)::BIGINT AS calls, greatest(0, sum((value <= 5 AND (props->>'k')::BIGINT > 3)::BIGINT) - 1)::BIGINT AS repeated_failure, greatest(0, 2100 - count(*))::BIGINT AS gap FROM events GROUP BY 1")
def coverage_slices(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return ledger.coverage_slices(_t(spark, sf_dir, "events"), ["event_type"], F.col("value") > 5, k, 2100, k > 3)


@query("WITH c AS (SELECT event_type, count(*) AS n FROM events WHERE event_type IS NOT NULL GROUP BY 1) SELECT 'event_type' AS axis, count(*) AS classes, round((ln(sum(n)) - sum(n * ln(n)) / sum(n)) / ln(count(*)), 6) AS entropy FROM c")
def axis_entropy(spark, sf_dir):
    return ledger.axis_entropy(_t(spark, sf_dir, "events"), "event_type")


_LEDGER = "SELECT o_custkey AS pair, o_totalprice > 100000 AS good, (o_orderkey % 7)::BIGINT AS calls FROM orders"


@query(f"""WITH p AS (SELECT pair, count(*) AS n, sum(good::BIGINT) AS g, sum(calls) AS c FROM ({_LEDGER}) GROUP BY pair)
SELECT sum(g)::BIGINT AS good, sum(c)::BIGINT AS calls, round(sum(g) / sum(c), 6) AS good_per_call, count(*) AS pairs, round(sum(n) / count(*), 6) AS episodes_per_pair, list_sort(list(n))[count(*) // 2 + 1] AS redundancy FROM p""")
def ledger_summary(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("pair"), (F.col("o_totalprice") > 100000).alias("good"), (F.col("o_orderkey") % 7).alias("calls"))
    return ledger.ledger_summary(rows)


_RUN = "SELECT o_custkey AS run, o_orderdate AS moment, o_orderkey AS id, o_totalprice > 100000 AS good, (o_orderkey % 7)::BIGINT AS calls FROM orders"


def _runs(spark, sf_dir):
    return _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("run"), F.col("o_orderdate").alias("at"), F.col("o_orderkey").alias("id"), (F.col("o_totalprice") > 100000).alias("good"), (F.col("o_orderkey") % 7).alias("calls"))


@query(f"SELECT run, min(c)::BIGINT AS calls FROM (SELECT run, sum(good::INT) OVER w AS g, sum(calls) OVER w AS c FROM ({_RUN}) WINDOW w AS (PARTITION BY run ORDER BY moment, id ROWS UNBOUNDED PRECEDING)) WHERE g = 3 GROUP BY run")
def time_to_nth_good(spark, sf_dir):
    return ledger.time_to_nth_good(_runs(spark, sf_dir), 3)


@query(f"""WITH b AS (SELECT year(moment)::INT AS batch, count(*) AS n, sum(good::BIGINT)::BIGINT AS good, sum(calls)::BIGINT AS calls FROM ({_RUN}) GROUP BY 1)
SELECT *, (sum(good) OVER w)::BIGINT AS good_so_far, (sum(calls) OVER w)::BIGINT AS calls_so_far FROM b WINDOW w AS (ORDER BY batch)""")
def campaign_curve(spark, sf_dir):
    return ledger.campaign_curve(_runs(spark, sf_dir).withColumn("batch", F.year("at")))


_PARENTS = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS parent, o_totalprice > 100000 AS good FROM orders"


@query(f"WITH o AS ({_PARENTS}) SELECT count(*) AS rewrites, sum(c.good::BIGINT)::BIGINT AS repaired, round(sum(c.good::BIGINT) / count(*), 6) AS rate FROM o c JOIN o p ON c.parent = p.id WHERE NOT p.good")
def repair_rate(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey div 2 END").alias("parent"), (F.col("o_totalprice") > 100000).alias("good"))
    return ledger.repair_rate(rows)


@query("SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def compatible_pairs(spark, sf_dir):
    nation, region = _t(spark, sf_dir, "nation"), _t(spark, sf_dir, "region")
    pairs = _t(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return pairs.select("s_suppkey", "n_name", "r_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 50 = 0)")
def unattempted(spark, sf_dir):
    customers = _t(spark, sf_dir, "customer").select("c_custkey")
    return ledger.unattempted(customers, _t(spark, sf_dir, "orders").where("o_orderkey % 50 = 0").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


@query("""WITH t AS (SELECT c_nationkey AS edit, c_mktsegment AS category, c_custkey AS pair, row_number() OVER (PARTITION BY c_nationkey, c_mktsegment ORDER BY md5('5:' || c_custkey::VARCHAR), c_custkey) AS turn FROM customer)
SELECT edit, category, pair, row_number() OVER (PARTITION BY edit ORDER BY turn, category, pair)::INT AS round FROM t""")
def stratified_schedule(spark, sf_dir):
    return ledger.stratified_schedule(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("edit"), F.col("c_mktsegment").alias("category"), F.col("c_custkey").alias("pair")), 5)


@query("""WITH r AS (SELECT o_orderkey AS case_id, o_orderstatus AS category, o_orderpriority AS priority, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5('5:' || o_orderkey::VARCHAR), o_orderkey) AS r FROM orders)
SELECT case_id, category, priority FROM r WHERE r <= 12 ORDER BY r > 1, priority, r, category LIMIT 12""")
def stratified_cases(spark, sf_dir):
    return ledger.stratified_cases(_t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("case_id"), F.col("o_orderstatus").alias("category"), F.col("o_orderpriority").alias("priority")), 12, 5)


@query("SELECT doc_id, quality FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL OR quality >= 1")
def threshold_filter(spark, sf_dir):
    rows = _t(spark, sf_dir, "documents").select("doc_id").join(_t(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return ledger.threshold_filter(rows, "quality", 1)


@query("""WITH r AS (SELECT o_orderpriority AS g, o_orderkey AS step, o_orderstatus = 'F' AS passed, o_totalprice AS score FROM orders)
SELECT g, step, b.k AS incumbent, b.score AS incumbent_score FROM (SELECT g, step, -(max({'p': passed, 'score': score, 'o': -step}) OVER w).o AS k0, max({'p': passed, 'score': score, 'o': -step}) OVER w AS m FROM r WINDOW w AS (PARTITION BY g ORDER BY step ROWS UNBOUNDED PRECEDING)) t, LATERAL (SELECT {'k': t.k0, 'score': t.m.score} AS b)""")
def incumbents(spark, sf_dir):
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("g"), F.col("o_orderkey").alias("step"), (F.col("o_orderstatus") == "F").alias("passed"), F.col("o_totalprice").alias("score"))
    return ledger.incumbents(rows, ["g"])


@query("""SELECT coalesce(event_type, 'all') AS model, count(*) AS calls, sum((event_type <> 'error')::BIGINT)::BIGINT AS successes, sum(nullif((props->>'k')::BIGINT, 7))::BIGINT AS tokens, sum(((props->>'k')::BIGINT = 7)::BIGINT)::BIGINT AS missing FROM events GROUP BY ROLLUP (event_type)""")
def usage_rollup(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("long")
    return ledger.usage_rollup(_t(spark, sf_dir, "events"), "event_type", F.nullif(k, F.lit(7)), F.col("event_type") != "error")


@query("""SELECT page_id, regexp_replace(regexp_replace(url, '[?#].*$', ''), '://[^/@]*@', '://') AS safe_url, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
CASE WHEN length(url) <= 24 THEN url ELSE left(url, 6) || ' ... ' || right(url, 13) END AS short FROM pages""")
def address_functions(spark, sf_dir):
    url = F.col("url")
    return _t(spark, sf_dir, "pages").select("page_id", X.without_query(url).alias("safe_url"), X.slug(url).alias("slug"), X.bounded(url, 24).alias("short"))


@query("""WITH w AS (SELECT item_id, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z0-9]+'), lambda x: length(x) > 2)) AS w FROM benchmark)
SELECT a.item_id, b.item_id AS other_id, round(CASE WHEN len(a.w) = 0 OR len(b.w) = 0 THEN 0 ELSE len(list_intersect(a.w, b.w)) / len(list_distinct(list_concat(a.w, b.w))) END, 6) AS jaccard FROM w a JOIN w b ON b.item_id = a.item_id + 1""")
def content_similarity(spark, sf_dir):
    rows = _t(spark, sf_dir, "benchmark").select("item_id", X.content_tokens(F.col("text")).alias("w"))
    other = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("item_id").alias("other_id"), F.col("w").alias("v"))
    return rows.join(other, "item_id").select("item_id", "other_id", F.round(X.jaccard(F.col("w"), F.col("v")), 6).alias("jaccard"))


@query("""SELECT vec_id, round(list_dot_product(v, v), 6) AS square, round(v[1], 6) AS first FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]))) AS v FROM embeddings)""")
def unit_vectors(spark, sf_dir):
    v = X.unit(F.col("embedding"))
    rows = _t(spark, sf_dir, "embeddings").select("vec_id", v.alias("v"))
    return rows.select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 6).alias("square"), F.round(F.col("v")[0], 6).alias("first"))
