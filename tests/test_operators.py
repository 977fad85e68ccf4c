"""Operators on literal rows with known results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import conversations, embeddings, evidence, ledger, scoring
from corpusloom.plans.pipeline import Contract, Operator, Pipeline, best, review_score, split_failures
from corpusloom.sources import records
from corpusloom.streaming import ingest


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'string' if not isinstance(v, list) else 'array<string>'}" for k, v in values.items())).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "want"), [(r"\boxed{2}", "2"), ("$-3$", "-3"), ("1,200", "1200"), ("7.", "7"), ("  ", None), (None, None)])
def test_benchmark_answer(spark, text, want):
    assert one(spark, X.benchmark_answer(F.col("t")), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("Answer: (b) because", "B"), ("c) yes", "C"), ("it may be A or D", "D"), ("none", None), ("", None), (None, None), ("A man runs, so B", "B"), ("Option C, not A", "C"), ("The final choice is D", "D"), ("C.", "C"), ("no option", None)])
def test_answer_letter(spark, text, want):
    assert one(spark, X.answer_letter(F.col("t")), t=text) == want


def test_text_functions(spark):
    assert one(spark, X.tokens(F.col("t")), t="Ab, 日本 c") == ["ab", "日", "本", "c"]
    assert one(spark, X.tokens(F.col("t")), t=None) == []
    assert one(spark, X.ngrams(F.col("t"), 2), t=["a", "b", "a", "b"]) == ["a b", "b a"]
    assert one(spark, X.ngrams(F.col("t"), 3), t=["a"]) == ["a"]
    assert one(spark, X.folded_answer(F.col("t")), t="  Straße  X ") == "strasse x"
    assert one(spark, X.bounded(F.col("t"), 10), t="abcdefghijklmnop") == "a ... mnop"
    assert one(spark, X.has_motion(F.col("t")), t="She walked") is True
    assert one(spark, X.has_motion(F.col("t")), t="He throws") is False


def test_scores(spark):
    rows = [("a", "1", "2", "2", "stop"), ("a", "2", "2", "2", "length"), ("a", "3", None, "1", "stop"), ("a", "4", "9", "1", "length")]
    df = spark.createDataFrame(rows, "benchmark string, question_id string, predicted string, correct string, finish_reason string")
    r = scoring.benchmark_scores(df).first()
    assert (r.questions, r.score, r.wrong, r.parse_failures, r.runaway) == (4, 0.25, 1, 1, 2)
    assert scoring.benchmark_scores(df, truncated_counts=True).first().score == 0.5
    image = spark.createDataFrame([("g", 8.0), ("g", 10.0), ("g", None), ("g", float("nan")), ("g", 11.0)], "benchmark string, score double")
    r = scoring.native_scale_mean(image, {"g": 10.0}).first()
    assert (r["mean"], r.normalized, r.invalid) == (9.0, 0.9, 3)


def test_conversations(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (2, 0, "user", "q"), (2, 1, "user", "q"), (3, 0, "user", " "), (3, 1, "assistant", "a"), (4, 0, "user", None)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert {r.conv_id: r.valid for r in conversations.conversation_validity(df).collect()} == {1: True, 2: False, 3: False, 4: False}
    assert [(r.conv_id, r.output) for r in conversations.supervised_pairs(df).collect()] == [(1, "a")]


def test_embeddings(spark):
    x = np.random.default_rng(0).normal(size=(40, 6))
    df = spark.createDataFrame([(i, v.tolist(), int(i % 2)) for i, v in enumerate(x)], "id long, embedding array<double>, side int")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    k = np.exp(-((u[:, None] - u[None]) ** 2).sum(-1) / 2)
    a, b = u[::2], u[1::2]
    assert embeddings.rbf_mmd(df.where("side = 0"), df.where("side = 1")) == pytest.approx(k[::2, ::2].mean() + k[1::2, 1::2].mean() - 2 * k[::2, 1::2].mean(), abs=1e-9)
    w = np.linalg.eigvalsh(u @ u.T / 40)
    w = w[w > 1e-12]
    assert embeddings.vendi(df)[0] == pytest.approx(np.exp(-(w * np.log(w)).sum()), abs=1e-6)
    assert len(a) == len(b) and embeddings.quality_composite(0.0, None, 0.5) == pytest.approx((0.4 + 0.3 * 0.25) / 0.7)


def test_embedding_blocks(spark, monkeypatch):
    monkeypatch.setattr(embeddings, "BLOCK_ROWS", 3)
    v = np.random.default_rng(5).normal(size=(30, 4))
    v[10:20] = v[0]  # a third are copies
    odd = [(90, None), (91, [0.0] * 4), (92, [1.0, None, 0.0, 0.0]), (93, [float("nan")] * 4), (94, [float("inf")] + [1.0] * 3)]
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)] + odd, "id long, embedding array<double>")
    u = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = u @ u.T
    np.fill_diagonal(near, -np.inf)
    assert {r.id: r.nearest for r in embeddings.nearest_cosines(df, "id").collect()} == pytest.approx(dict(enumerate(near.max(axis=1))))
    k = np.exp(u @ u.T - 1)
    a, b = slice(0, 20), slice(20, 30)
    want = k[a, a].mean() + k[b, b].mean() - 2 * k[a, b].mean()
    assert embeddings.rbf_mmd(df.where("id < 20"), df.where("id >= 20")) == pytest.approx(want, abs=1e-9)
    assert embeddings.rbf_mmd(df.where("id < 20"), df.where("id >= 90")) is None
    assert embeddings.nearest_cosines(df.where("id = 1 or id > 89"), "id").count() == 0


def test_evidence(spark):
    rows = [(1, 1, 0, 0.0, 10.0, ["a"], "red car turns"), (1, 2, 0, 12.0, 20.0, ["a"], "other"), (1, 3, 0, 40.0, 50.0, ["a"], "far"), (1, 4, 0, 51.0, 60.0, ["b"], "unlike words here"), (2, 5, 0, 0.0, 1.0, [], "x")]
    rows += [(3, 6, 0, 0.0, 10.0, [], "aaa"), (3, 7, 0, 10.0, 12.0, [], "bbb"), (3, 8, 1, 11.0, 13.0, [], "ccc")]
    df = spark.createDataFrame(rows, "key long, id long, segment int, start double, end double, entities array<string>, text string")
    got = {(r.event, *r.ids) for r in evidence.fused_events(df).collect()}
    assert got == {(0, 1, 2), (1, 3), (2, 4), (0, 5), (0, 6, 7), (1, 8)}  # units overlap only within a segment
    captions = spark.createDataFrame([(1, 60.0, 30.0, "[00:05-00:09] A man. [01:00] Next"), (2, 0.0, 30.0, None)], "key long, start_sec double, duration_sec double, caption string")
    assert [tuple(r)[1:] for r in evidence.caption_spans(captions).collect()] == [(65.0, 69.0, "A man. [01:00] Next", "anchored")]
    items = [("q", ["a", "b", "c", "d"], "A", ["e"], "r"), ("q", ["a", "b"], "a", ["e"], "r"), (" ", None, None, None, None), ("q", ["a", "a", "c", "d"], "a", ["e"], "r"), ("q", ["a", "b", "c", "d"], "a", [], "r")]
    df = spark.createDataFrame(items, "q string, c array<string>, a string, e array<string>, r string")
    want = [None, "choices_not_four", "missing_question", "answer_not_unique_choice", "missing_evidence"]
    assert [r.x for r in df.select(evidence.choice_problem(*[F.col(c) for c in "qcaer"]).alias("x")).collect()] == want


def test_rubric_and_selection(spark):
    df = spark.createDataFrame([(True, {"if": 4.0, "vc": 3.0}), (None, {"if": 5.0}), (True, {"if": 4.0, "vc": 2.0}), (True, {"if": 4.0}), (True, {"if": 4.0, "vc": 3.0})], "ok boolean, s map<string,double>")
    got = [tuple(r.x) for r in df.select(ledger.rubric_decision({"if": (4, 1), "vc": (3, 1)}, 3.5, F.col("ok"), F.col("s")).alias("x")).collect()]
    assert got == [(True, 3.5, []), (False, None, ["environment_invalid"]), (False, 3.0, ["below_minimum:vc"]), (False, 4.0, ["missing_axis:vc"]), (True, 3.5, [])]
    chain = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 9), (5, 6), (6, 7), (7, 6), (8, None)], "id long, parent long")
    assert {r.id: r.root for r in ledger.rewrite_roots(chain).collect()} == {1: 1, 2: 1, 3: 1, 4: 9, 5: 6, 6: 6, 7: 6, 8: 8}  # 6 and 7 run in a circle
    assert best([(False, 0.9), (True, 0.5), (True, 0.5)]) == 1 and best([(True, 0.5), (True, 0.5)], strict=False) == 1
    assert review_score({"a": 0.5}, {"a": 1, "b": 1}, 0.5) == 0.5 and review_score({"a": 0.5}, {"a": 1}, 0.5, "penalty") == 0.25


def test_pipeline(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (2, "")], "id long, t string")
    assert [r.id for r in Contract(("id",), ("t",)).violations(rows).collect()] == [2]
    up = Operator("up", lambda d: d.withColumn("u", F.upper("t")), ("t",), ("u",))
    keep = Operator("keep", lambda d: d.where("u <> ''"), ("u",))
    with pytest.raises(KeyError, match="reads v.*writes t"):
        Pipeline(Operator("x", lambda d: d, ("v",)), Operator("y", lambda d: d, (), ("t",))).compile(["id", "t"])
    out, steps = Pipeline(up, keep).run(spark, rows, str(tmp_path), "src")
    assert out.count() == 1 and [r.reused for r in steps.orderBy("step").collect()] == [False, False]
    changed = Operator("keep", keep.apply, ("u",), version="2")
    _, steps = Pipeline(up, changed).run(spark, rows, str(tmp_path), "src")
    assert [r.reused for r in steps.orderBy("step").collect()] == [True, False]
    good, bad = split_failures(spark.createDataFrame([(1, "v", None), (2, None, "e" * 2000)], "id long, v string, e string"), "v", "e")
    assert (good.count(), len(bad.first().e)) == (1, 1000)


def test_records(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n[1]\n{"a": \n')
    from pyspark.sql import types as T

    rows, bad = records.read_objects(spark, str(tmp_path / "a.jsonl"), T.StructType([T.StructField("a", T.LongType())]))
    assert [r.a for r in rows.collect()] == [1] and bad.count() == 2
    (tmp_path / "r.txt").write_text('﻿plain\n{"x": "b", "y": ""}\n\n')
    assert [r.text for r in records.read_texts(spark, str(tmp_path / "r.txt")).collect()] == ["plain", "b"]
    views = records.permuted_choices(spark.createDataFrame([(1, ["a", "b", "c"])], "id long, choices array<string>"), 3, "s").collect()
    assert len(views) == 3 and all(sorted(v.choices) == ["a", "b", "c"] for v in views)


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/1.json").write_text('{"k": "a", "n": 1}\n{"k": "a", "n": 2}\n')
    for _ in range(2):
        ingest.fold_stream(spark, str(tmp_path / "in"), "k string, n long", str(tmp_path / "state"), str(tmp_path / "c"), ["k"], ["n"])
    state = spark.read.parquet(str(tmp_path / "state"))
    assert [tuple(r) for r in ingest.totals(state, ["k"], ["n"]).collect()] == [("a", 3)]
    again = ingest.fold(state, spark.createDataFrame([(0, "a", 5), (9, "b", 1)], "batch_id int, k string, n long"), ["k"], ["n"])
    assert sorted(tuple(r) for r in ingest.totals(again, ["k"], ["n"]).collect()) == [("a", 3), ("b", 1)]
