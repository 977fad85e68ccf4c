"""Line dedup and the fill-in-middle transformation against plain versions, and on odd rows."""

import hashlib
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusloom.llm import fill_in_middle, line_dedup

SCHEMA = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "one"), (4, "one"), (5, "x" * 70_000), (None, "no id at all"), (6, "é日本 😀 ▁ a\tb"), (7, "　 wide  \r\n\x0b\x0c"), (8, "<P> here"), (9, "a <S"), (10, " " * 5_000 + "end" + "\t" * 5_000)]


def plain_lines(rows, least):
    strip = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    docs = [(i, (t or "").split("\n")) for i, t in rows]
    often = {k for k, n in Counter(k for _, lines in docs for k in {strip(x) for x in lines}).items() if n >= least and k}
    kept = [(i, len(lines), [x for x in lines if strip(x) not in often]) for i, lines in docs]
    return sorted(((i, n, n - len(k), "\n".join(k)) for i, n, k in kept), key=repr)


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (4, 2), (7, 3)])
def test_lines(spark, batches, fanout):
    pick = random.Random(5)
    pool = [f"Line {k}" + " \t" * (k % 2) for k in range(40)] + ["", "  ", "É", "É ", "é", "Ünder", "ünder"]
    rows = [(k, "\n".join(pick.choices(pool, [1 / (j + 1) for j in range(len(pool))], k=pick.randint(0, 6)))) for k in range(150)]
    rows += [*ODD, *[(1000, "same\nHOT line")] * 60]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA), 10, 1, batches, fanout)
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=repr) == plain_lines(rows, 10)


def test_lines_keep_short_keys(spark):
    rows = [(k, "日本\nab\nabc") for k in range(3)]
    out = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, SCHEMA), 3, 3, 2)
    assert {r.text for r in out.collect()} == {"日本\nab"}


def test_settled_keys_take_no_further_part(spark, tmp_path):
    runs = line_dedup.LineRuns(spark, str(tmp_path), least=3)
    batch = lambda *keys: spark.createDataFrame([(k, 0) for k in keys], "k1 long, k2 long")
    runs.add(batch(1, 1, 1, 2))
    runs.add(batch(1, 2, 3))
    runs.add(batch(2, 3))
    assert {r.k1 for r in runs.frequent().collect()} == {1, 2}
    left = {r.k1: r.n for r in runs._read([p for level in runs.levels for p in level], False).collect()}
    assert left == {3: 2}


def test_lines_with_other_columns(spark):
    docs = spark.createDataFrame([(1, "a\nb", 5, "r", "x"), (2, "a", 6, "s", "y")], "doc_id long, text string, n_dropped int, route string, `k1.x` string")
    out = line_dedup.drop_repeated_lines(docs, least=2)
    assert out.columns == ["doc_id", "text", "route", "k1.x", "n_lines", "n_dropped"]
    assert sorted(map(tuple, out.collect())) == [(1, "b", "r", "x", 2, 1), (2, "", "s", "y", 1, 1)]
    assert line_dedup.report(docs.limit(0)).count() == 0


def plain_middle(doc_id, text, plain_at=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[k : k + 8], 16) for k in range(0, 32, 8)]
    low, high = sorted(x % (len(units) + 1) for x in h[:2])
    p, m, s = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= plain_at:
        return doc_id, len(units), "plain", None, None, text
    return (doc_id, len(units), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")))


@pytest.mark.parametrize(("fim", "spm"), [(50, 80), (100, 0), (100, 100)])
def test_middles(spark, fim, spm):
    pick = random.Random(9)
    rows = ODD + [(k, "".join(pick.choices(["a", "Bc", " ", "\n", "日", "<", "S", ">", "\x85", " "], k=pick.randint(0, 40)))) for k in range(20, 220)]
    out = fill_in_middle.transform(spark.createDataFrame(rows, SCHEMA).withColumn("form", F.lit("old")).withColumn("extra", F.lit(1)), 42, fim, spm)
    assert out.columns == ["doc_id", "text", "extra", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("again", fill_in_middle.restored("output", "form")).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=repr) == sorted((plain_middle(i, t, fim, spm) for i, t in rows), key=repr)
    assert all(r.again == (r.text or "") for r in got)
    assert fill_in_middle.report(out.limit(0)).count() == 0
