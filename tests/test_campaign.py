"""Campaign operators on nulls, empty tables and ties, and the ledger's append."""

from pyspark.sql import functions as F

from corpusloom.operators import campaign


def test_edges(spark):
    pairs = spark.range(3)
    assert campaign.drawn(pairs.limit(0), "id", 5, 1).count() == 0
    assert campaign.drawn(pairs, "id", 50, 1).count() == 50
    assert sorted(r.position for r in campaign.numbered(spark.range(2000), "id", 1).collect()) == list(range(2000))
    rows = spark.createDataFrame([(1, 2.0), (2, 2.0), (3, None), (4, 5.0)], "id long, score double")
    assert [(r.id, r.level) for r in campaign.nested_subsets(rows, "score", "id", [3, 1]).orderBy("rank").collect()] == [(4, 2), (1, 1), (2, 1)]
    scores = spark.createDataFrame([(None, [True, None]), (None, [True]), ("a", []), ("b", None)], "d string, s array<boolean>")
    got = campaign.dataset_scores(scores, "d", "s").orderBy("position").collect()
    assert [(r.d, r.position, r.accuracy, r.n) for r in got] == [(None, 0, 100.0, 2), (None, 1, 50.0, 2)]
    none = F.lit(None).cast("string")
    assert spark.range(1).select(campaign.seed_verdict(none, none, none, none).alias("v")).first().v == "compatible"
    zero = F.lit(None).cast("int")
    assert spark.range(1).select(campaign.evidence_route(F.lit(True), zero, zero, zero, zero, F.lit(None).cast("boolean")).alias("r")).first().r == "video_only"


def test_append(spark, tmp_path):
    producer = F.struct(F.lit("p").alias("pipeline"), F.lit("1").alias("pipeline_version"), F.lit("f").alias("pipeline_fingerprint"))
    rows = spark.range(2).select(F.col("id").alias("sample_id"), F.struct(F.col("id").alias("x")).alias("content"), producer.alias("producer"))
    for name in ("r1", "r2"):
        campaign.append_accepted(campaign.accepted_records(rows, "content", name, "p"), str(tmp_path / "ledger"))
    kept = spark.read.parquet(str(tmp_path / "ledger"))
    assert kept.count() == 4 and kept.where("accepted_at is null").count() == 0
    assert kept.select("rsi_round_id").distinct().count() == 2
