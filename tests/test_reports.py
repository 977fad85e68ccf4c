"""Reports on literals: metrics of lines, texts of records, exports, ledgers, failed rows, last steps, result tables."""

import json

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import reports


def test_file_metrics(spark):
    long = "x" * 50
    lines = ['{"q": "%s", "a": 1}' % long, '{"a": 1, "q": "%s"}' % long, '{"q": "%s", "a": []}' % long, '{"q": " ", "a": null}', "{broken", "[1]", "", None, "  "]
    rows = spark.createDataFrame([(x,) for x in lines], "value string")
    got = reports.file_metrics(rows, ["q", "a"]).first()
    # the first two are one record; three long questions are the same, so of four objects two texts
    assert got.asDict() == {"total": 6, "parse_valid_rate": round(4 / 6, 6), "null_rate": round(3 / 8, 6), "record_dup_rate": round(1 / 6, 6), "field_dup_rate": 0.5, "dup_field": "q", "dup_rate": 0.5}
    assert reports.file_metrics(rows, ["q", "a"], ["a"]).first().dup_field == ""
    assert reports.file_metrics(rows.limit(0), ["q"]).first().asDict() == {"total": 0, "parse_valid_rate": 0.0, "null_rate": 0.0, "record_dup_rate": 0.0, "field_dup_rate": 0.0, "dup_field": "", "dup_rate": 0.0}


@pytest.mark.parametrize(
    ("record", "want"),
    [({"a": "x", "b": {"c": ["y", {"d": "z"}], "e": ""}, "f": 1, "g": None}, "x y z"), ({}, ""), ({"k:": 'quote " and \\ : end:'}, 'quote " and \\ : end:'), ({"a": "é\n日本"}, "é\n日本"), ({"a": "x" * 100_000}, "x" * 100_000)],
)
def test_record_text(spark, record, want):
    assert spark.createDataFrame([(json.dumps(record),)], "j string").select(reports.record_text(F.col("j"))).first()[0] == want


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([("q", "a"), (" ", "a"), ("q", None), (None, None)], "u string, v string")
    pairs, counts = reports.instruction_export(rows, "u", "v")
    assert (pairs.collect(), counts.collect()) == ([("q", "", "a")], [(1, 3)])
    reports.write_export(pairs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1
    with pytest.raises(ValueError):
        reports.write_export(pairs.limit(0), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_ledger_totals(spark):
    schema = "pair string, good boolean, calls long, tokens long, tags array<string>"
    rows = spark.createDataFrame([("p", True, 2, 10, ["b", "a"]), ("p", None, None, 5, None), (None, False, 1, None, ["b"])], schema)
    got = reports.ledger_totals(rows).first()
    assert got[:-1] == (3, 1, 3, 15, 0.333333, 1, 2, 2.0) and [tuple(t) for t in got.top_failure_tags] == [("b", 2), ("a", 1)]
    none = reports.ledger_totals(rows.limit(0)).first()
    assert none[:-1] == (0, 0, 0, 0, None, 0, 0, None) and none.top_failure_tags == []


def test_failed_rows(spark):
    rows = spark.createDataFrame([(1, "ValueError: " + "m" * 2000), (2, "no class"), (3, None), (4, "")], "id long, error string")
    letters = reports.dead_letters(rows, "id", "judge", "error")
    assert {r.id: (r.error_class, r.message[:8], len(r.message)) for r in letters.collect()} == {1: ("ValueError", "mmmmmmmm", 1000), 2: ("Error", "no class", 8), 4: ("Error", "", 0)}
    assert [r.id for r in reports.to_run(rows, letters, "id", "judge").collect()] == [3]
    assert reports.to_run(rows, letters, "id", "other").count() == 4


def test_last_step(spark):
    files = lambda *names: reports.final_step(spark.createDataFrame(list(names), "file string, n_rows long"))
    assert files(("a_step2.jsonl", 5), ("a_step10.jsonl", 3), ("usage_step11.jsonl", 9), ("notes.jsonl", 1)).collect() == [("a_step10.jsonl", 10, 3, None)]
    assert files(("a_step1.jsonl", 5), ("a_step2.jsonl", 0)).first().problem == "empty"
    assert files(("a_step1.jsonl", 5), ("b_step1.jsonl", 1)).first().problem == "doubled"
    assert files(("notes.jsonl", 1)).count() == 0


def test_result_table(spark):
    rows = spark.createDataFrame([("m", "x", 1.0), ("m", "x", 3.0), ("m", "y", 1.0), ("n", "x", 2.0), ("n", "y", 2.0), ("o", "x", 9.0), ("o", "z", 9.0)], "method string, benchmark string, score double")
    got = {r.method: (r.x, r.y, r.present, r.mean, r["rank"]) for r in reports.result_table(rows, ["x", "y"]).collect()}
    assert got == {"m": (3.0, 1.0, 2, 2.0, 1), "n": (2.0, 2.0, 2, 2.0, 1), "o": (9.0, None, 1, None, None)}
