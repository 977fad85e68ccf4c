"""Queries against their SQL on tables that the driver's smallest ones are unlike: folders of files, texts by chance, long stretches."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.operators import embeddings, evidence, profiles
from corpusloom.plans import catalog
from corpusloom.sources import scans


def same_as_sql(spark, folder, name):
    """Whether a query gives the rows of its SQL over the tables in ``folder``, single files or folders of them."""
    con = duckdb.connect()
    for f in os.listdir(folder):
        con.execute(f"create view {f[:-8]} as select * from '{folder}/{f}{'/*.parquet' if os.path.isdir(f'{folder}/{f}') else ''}'")
    df = catalog.queries()[name](spark, str(folder))
    columns = ", ".join(df.columns)
    want = con.execute(f"select {columns} from ({catalog.oracle_sql()[name]})").fetchall()
    plain = lambda rows: sorted((tuple(tuple(v) if isinstance(v, list) else v for v in r) for r in rows), key=repr)
    return plain(map(tuple, df.collect())) == plain(want)


def test_footer_counts_of_folders(spark, tmp_path):
    for name, n in (("documents", 7), ("lineitem", 11), ("pages", 1)):
        spark.range(n).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert same_as_sql(spark, tmp_path, "footer_counts")


def test_failure_tags_of_chance_words(spark, tmp_path):
    """Words that other campaigns have rules for, and letters beyond ASCII beside the words of a rule."""
    said = ["x bleeding x", "a seam", "physics", "éhalo", "halo", "too many", "typoß", "text 2 too\u00a0small", "text 2 too\n small", "caption ſmall", "title too ſmall", "pops in", "", None]
    rows = [(k, t, "user", (text or "") + "." * pad if text is not None else None) for k, text in enumerate(said) for t, pad in enumerate((0, 1, 2, 3))]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert same_as_sql(spark, tmp_path, "text_failure_tags")
    assert same_as_sql(spark, tmp_path, "text_failure_counts")


def test_fused_events_fold_streams(spark):
    """Many keys and stretches are folded by the tasks as streams, not as one Python call for each."""
    rows = spark.range(4000).select((F.col("id") % 500).alias("key"), "id", F.lit(0).alias("segment"), (F.floor(F.col("id") / 500) * F.when(F.col("id") % 2 == 0, 4.0).otherwise(100.0)).alias("start"), F.array(F.lit("a")).alias("entities"), F.lit("x").alias("text"))
    found = evidence.fused_events(rows.withColumn("end", F.col("start") + 1.0))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "MapInArrow" in plan
    got = {(r.key, r.event): (r.start, r.end, r.ids) for r in found.collect()}
    even = {(k, 0): (0.0, 29.0, [k + 500 * i for i in range(8)]) for k in range(0, 500, 2)}
    assert got == even | {(k, i): (100.0 * i, 100.0 * i + 1, [k + 500 * i]) for k in range(1, 500, 2) for i in range(8)}
    odd = spark.createDataFrame([(1, 1, 0, 0.0, 1.0, ["a"]), (1, 2, 0, 1.0, None, ["a"]), (1, 3, 0, 2.0, 3.0, ["a"]), (1, 4, 0, None, 3.0, None), (2, 5, 0, 0.0, 1.0, None)], "key long, id long, segment int, start double, end double, entities array<string>")
    assert sorted((r.key, r.ids) for r in evidence.fused_events(odd.withColumn("text", F.lit(None).cast("string"))).collect()) == [(1, [1]), (1, [2]), (1, [3]), (1, [4]), (2, [5])]


def test_numbering_gaps_in_blocks(spark, monkeypatch):
    """Neighbours are found across blocks of all levels, and no window holds all numbers in one task."""
    some = [0, 3, 4, 4, 7, 8, 16, 17, 63, 64, 64, 150, 151, 4100, 4103]
    monkeypatch.setattr(scans, "BLOCK_BITS", 5)
    monkeypatch.setattr(scans, "GAP_ROWS", 16)
    found = scans.numbering_gaps(spark.createDataFrame([(f"part-{n:05d}.jsonl",) for n in some] + [("none",)], "file string"))
    assert sorted(map(tuple, found.collect())) == sorted([(n, "doubled") for n in (4, 64)] + [(n, "missing") for n in range(4103) if n not in some])
    monkeypatch.setattr(scans, "BLOCK_BITS", 18)
    wide = scans.numbering_gaps(spark.createDataFrame([("9223372036854775807",), ("9223372036854000000",), ("9223372036854775800",)], "file string"))
    assert wide.count() == 775807 - 2
    assert "SinglePartition" not in wide._jdf.queryExecution().executedPlan().toString()


def test_blocks_wider_than_their_products(spark):
    """A block has more vectors than are multiplied at once, so few copies of a vector are sent, and all pairs are compared."""
    assert embeddings.BLOCK_ROWS >= 8 * 4096 and embeddings.CHUNK_ROWS * embeddings.BLOCK_ROWS * 8 <= 1 << 27
    v = np.random.default_rng(7).normal(size=(3000, 4))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T
    k = np.exp(near - 1)
    np.fill_diagonal(near, -np.inf)
    assert {r.id: r.nearest for r in embeddings.nearest_cosines(df, "id").collect()} == pytest.approx(dict(enumerate(near.max(axis=1))))
    a, b = slice(0, 1500), slice(1500, 3000)
    assert embeddings.rbf_mmd(df.where("id < 1500"), df.where("id >= 1500")) == pytest.approx(k[a, a].mean() + k[b, b].mean() - 2 * k[a, b].mean(), abs=1e-9)


def test_profiles_parse_records_once(spark):
    """However often the plan asks for what a record holds, its text is parsed once."""
    rows = spark.createDataFrame([('{"a": 1, "b": " {\\"c\\": true}"}',), ("[1]",), ("x",), (None,)], "record string")
    found = profiles.scalar_values(rows, "record")
    assert found._jdf.queryExecution().executedPlan().toString().count("parseJson(record") == 1
    assert sorted(map(tuple, found.collect())) == [("a", "1"), ("b.c", "true")]
