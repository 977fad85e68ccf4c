"""Queries of campaign operators over the driver's tables, with SQL that gives the same rows; roles as in the catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import campaign
from corpusloom.plans.catalog import _t, query


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'target_absent' WHEN 2 THEN 'ambiguous_target' WHEN 4 THEN 'ambiguous_target' WHEN 6 THEN 'ambiguous_target' ELSE 'compatible' END AS verdict,
CASE WHEN p_partkey % 8 IN (3, 5) THEN [p_name] ELSE [] END AS literals FROM part""")
def seed_verdicts(spark, sf_dir):
    k, name = F.col("p_partkey") % 8, F.col("p_name")
    code = F.when(k <= 1, "t4").when(k <= 3, "T1").when(k <= 6, "T5").otherwise("R1")
    prompt = F.when(k == 1, F.concat(F.lit("A sign that says 你好, "), name)).otherwise(F.concat(F.lit("A sign, "), name))
    quoted = F.concat(F.lit("Change the Target  text to “"), name, F.lit(" ” or 'x'"))
    hint = F.when(k.isin(2, 7), "Change the new wording").when(k == 4, "Repair it").when(k == 6, "改成指定文字").when(k.isin(3, 5), quoted)
    verdict = campaign.seed_verdict(code, prompt, hint, F.when(k == 4, "Text_Misspelled"))
    return _t(spark, sf_dir, "part").select("p_partkey", verdict.alias("verdict"), campaign.quoted_literals(hint).alias("literals"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'invalid' WHEN o_orderstatus IS NULL OR (n > 0 AND o_orderkey % 7 = 0) THEN 'invalid' WHEN c > 0 AND e > 0 THEN 'caption_entity' WHEN c > 0 OR e > 0 THEN 'caption_only' WHEN n > 0 THEN 'event_graph' ELSE 'video_only' END AS route
FROM (SELECT *, o_custkey % 2 AS c, o_custkey % 3 AS e, o_custkey % 2 + o_custkey % 3 + o_custkey % 5 AS n FROM orders)""")
def evidence_routes(spark, sf_dir):
    orders = _t(spark, sf_dir, "orders")
    sourced = F.when(F.col("o_orderkey") % 7 != 0, True)
    k = F.col("o_custkey")
    route = campaign.evidence_route((F.col("o_orderkey") % 11 != 0) & F.col("o_orderstatus").isNotNull(), k % 2, k % 3, F.lit(None).cast("int"), k % 5, sourced)
    return orders.select(F.col("o_orderkey").alias("id"), route.alias("route"))


@query("""SELECT o_orderkey AS sample_id, 's' || o_custkey AS seed_id, CASE WHEN o_orderkey % 4 > 0 THEN 'scene' || o_orderkey % 100 END AS scene_id, CASE WHEN o_orderkey % 3 = 0 THEN 'hint' ELSE o_orderpriority END AS taxonomy,
CASE WHEN o_orderkey % 4 > 0 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'hint' ELSE o_orderpriority END || '::scene' || o_orderkey % 100 END AS pair_id, 'hint' AS category, NULL::VARCHAR AS style, 2 AS api_calls,
CASE o_orderkey % 5 WHEN 0 THEN 'm1' WHEN 1 THEN 'big-Image-2' ELSE 'base' END AS generator, o_totalprice AS verifier_aggregate, CASE o_orderstatus WHEN 'F' THEN 'good' WHEN 'O' THEN 'bad' ELSE 'pending' END AS judgment, o_orderstatus = 'F' AS is_goodcase,
CASE WHEN o_orderkey % 2 = 0 THEN true WHEN o_custkey % 2 = 0 THEN false END AS environment_valid FROM orders""")
def ledger_rows(spark, sf_dir):
    key = F.col("o_orderkey")
    scene = F.when(key % 4 > 0, F.concat(F.lit("scene"), (key % 100).cast("string")))
    pair = F.create_map(F.lit("seed_id"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")), F.lit("scene_id"), scene, F.lit("category_hint"), F.lit("hint"))
    codes = F.when(key % 3 != 0, F.array("o_orderpriority")).otherwise(F.array().cast("array<string>"))
    step = lambda s, m: F.struct(s.cast("string").alias("step"), m.cast("string").alias("model"))
    plain = step(F.lit("plan"), F.lit("text-1"))
    made = F.when(key % 5 == 0, step(F.lit("Image_Gen"), F.lit("m1"))).when(key % 5 == 1, step(F.lit(None), F.lit("big-Image-2"))).otherwise(step(F.lit("verify"), F.lit(None)))
    verdict = F.struct(F.col("o_totalprice").alias("aggregate"), F.when(F.col("o_orderstatus") == "F", "good").alias("judgment"), F.when(F.col("o_custkey") % 2 == 0, False).alias("environment_valid"))
    columns = campaign.ledger_row(pair, codes, F.array(plain, made), [F.lit(None).cast("string"), F.lit("base")], verdict, F.when(F.col("o_orderstatus") == "O", "bad"), F.when(key % 2 == 0, True))
    return _t(spark, sf_dir, "orders").select(key.alias("sample_id"), *columns)


@query("""WITH s AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey // 2 END AS parent, o_custkey % 40 AS scene, CASE WHEN o_orderkey % 5 > 0 THEN 'i' || o_orderkey END AS image FROM orders)
SELECT s.id, coalesce(p.image, CASE WHEN s.scene < 25 THEN 'b' || s.scene END) AS image, CASE WHEN p.image IS NOT NULL THEN 'parent' WHEN s.scene < 25 THEN 'bank' ELSE 'miss' END AS origin FROM s LEFT JOIN s p ON s.parent = p.id""")
def adopted_images(spark, sf_dir):
    key = F.col("o_orderkey")
    parent = F.expr("CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey div 2 END")
    samples = _t(spark, sf_dir, "orders").select(key.alias("id"), parent.alias("parent"), (F.col("o_custkey") % 40).alias("scene_id"), F.when(key % 5 > 0, F.concat(F.lit("i"), key.cast("string"))).alias("image"))
    bank = _t(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("scene_id"), F.concat(F.lit("b"), F.col("n_nationkey").cast("string")).alias("bank_image"))
    return campaign.adopted_images(samples, bank)


@query("""WITH s AS (SELECT l_orderkey AS id, list(l_returnflag = 'R' ORDER BY l_linenumber, l_partkey, l_suppkey) AS s FROM lineitem GROUP BY l_orderkey), r AS (SELECT o_orderpriority AS dataset, s FROM s JOIN orders ON id = o_orderkey),
w AS (SELECT dataset, max(len(s)) AS m FROM r GROUP BY dataset) SELECT dataset, (p - 1)::INT AS position, round_even(avg(CASE WHEN s[least(p, len(s))] THEN 1 ELSE 0 END) * 100, 1) AS accuracy, count(*) AS n FROM r JOIN w USING (dataset), unnest(range(1, m + 1)) t(p) GROUP BY dataset, p""")
def dataset_scores(spark, sf_dir):
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", F.when(F.col("l_returnflag") != "A", F.col("l_returnflag") == "R").alias("good"))
    scores = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    rows = _t(spark, sf_dir, "orders").join(scores, "o_orderkey").select(F.col("o_orderpriority").alias("dataset"), F.transform("lines", lambda x: x["good"]).alias("scores"))
    return campaign.dataset_scores(rows, "dataset", "scores")


@query("""SELECT k AS model, count(*) AS batch_count, count(*) FILTER (hit) AS cache_hit_count, sum(items)::BIGINT AS item_count, sum(items)::BIGINT AS request_count, 0::BIGINT AS success_count, 0::BIGINT AS failure_count, sum(missing)::BIGINT AS missing_usage_count, 0::BIGINT AS exact_usage_count,
count(*) FILTER (gone) AS unavailable_batch_count, CASE WHEN bool_and(hit) THEN 'cache_only' WHEN bool_or(gone) THEN 'unavailable' WHEN sum(missing) > 0 THEN 'partial' ELSE 'exact' END AS usage_status
FROM (SELECT o_custkey AS k, o_orderstatus = 'F' AS hit, o_orderkey % 5 = 0 AS gone, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS missing, o_orderkey % 9 AS items FROM orders) GROUP BY k""")
def embedding_usage(spark, sf_dir):
    key, none = F.col("o_orderkey"), F.lit(None).cast("int")
    batches = _t(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("model"), (F.col("o_orderstatus") == "F").alias("cache_hit"), F.when(key % 5 == 0, "unavailable").alias("usage_status"), (key % 9).alias("item_count"), (key % 9).alias("request_count"),
        none.alias("success_count"), none.alias("failure_count"), F.when(key % 4 == 0, 1).alias("missing_usage_count"), none.alias("exact_usage_count"),
    )
    return campaign.embedding_usage(batches, "model")


@query("""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY md5('7:' || p_partkey), p_partkey) - 1 AS position FROM part), d AS (SELECT i AS draw, ('0x' || substr(md5('7#' || i), 1, 15))::BIGINT % (SELECT count(*) FROM part) AS position FROM range(500) t(i))
SELECT draw, p_partkey FROM d JOIN n USING (position)""")
def drawn_pairs(spark, sf_dir):
    return campaign.drawn(_t(spark, sf_dir, "part").select("p_partkey"), "p_partkey", 500, 7)


@query("SELECT o_orderkey, rank, (rank <= 400)::INT + (rank <= 100)::INT + (rank <= 10)::INT AS level FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank FROM orders WHERE o_totalprice IS NOT NULL) WHERE rank <= 400")
def nested_subsets(spark, sf_dir):
    return campaign.nested_subsets(_t(spark, sf_dir, "orders"), "o_totalprice", "o_orderkey", [400, 100, 10]).select("o_orderkey", "rank", "level")


@query("""SELECT event_id, CASE WHEN event_type IS NULL THEN 'missing field benchmark' WHEN event_id % 13 = 0 THEN 'missing field correct' WHEN event_type NOT IN ('click', 'view') THEN 'unknown benchmark ' || event_type END AS problem FROM events""")
def prediction_problems(spark, sf_dir):
    rows = _t(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("benchmark"), F.when(F.col("event_id") % 13 != 0, F.col("value") > 5).alias("correct"))
    return rows.select("event_id", campaign.prediction_problem(["benchmark", "correct"], "benchmark", ["click", "view"]).alias("problem"))


@query("""SELECT 'high_quality_sample' AS record_type, c_custkey AS sample_id, '{"question":"' || c_name || '","segment":"' || c_mktsegment || '"}' AS content, 'r3' AS rsi_round_id, 'p1' AS evaluation_policy_version,
'base' AS pipeline, 'v' || c_nationkey AS pipeline_version, NULL::VARCHAR AS pipeline_fingerprint FROM customer WHERE c_acctbal > 0""")
def accepted_records(spark, sf_dir):
    producer = F.struct(F.lit("base").alias("pipeline"), F.concat(F.lit("v"), F.col("c_nationkey").cast("string")).alias("pipeline_version"), F.lit(None).cast("string").alias("pipeline_fingerprint"))
    rows = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("sample_id"), F.struct(F.col("c_name").alias("question"), F.col("c_mktsegment").alias("segment")).alias("content"), producer.alias("producer"))
    return campaign.accepted_records(rows, "content", "r3", "p1")
