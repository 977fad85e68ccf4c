"""Scans, sinks, blobs, versions, hypotheses, tags, streams and references on small literals."""

import json
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from corpusloom.functions import answers, rehoming
from corpusloom.operators import diagnosis, gates, profiles, streams
from corpusloom.sources import blobs, records, scans, sinks
from corpusloom.streaming import hypotheses, versions


def lines(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(r + "\n" for r in rows))


# --- scans


def test_rows_by_number(spark, tmp_path):
    want = []
    for k in range(5):
        own = [{"a": 100 * k + i, "b": "x" * i} for i in range(k * 7)]
        want += own
        lines(tmp_path / f"part-{k}.jsonl", map(json.dumps, own))
    rows = spark.read.schema("a long, b string").json(str(tmp_path)).select("a")
    got = sorted((r.row, r.a) for r in scans.numbered(rows).collect())
    assert got == list(enumerate(x["a"] for x in want))
    assert [[r.a for r in b.orderBy("row").collect()] for b in scans.batches(rows, 20)] == [[x["a"] for x in want[k : k + 20]] for k in range(0, 70, 20)]
    assert [r.row for r in scans.batch(rows, 30, 2).orderBy("row").collect()] == list(range(10))
    assert scans.batch(rows, 30, 3).count() == 0
    plain = records.read_records(spark, str(tmp_path), "a long, b string", "jsonl")
    assert sorted(r.a for r in plain.collect()) == sorted(a for _, a in got)
    with pytest.raises(ValueError):
        scans.batch(rows, 0, 0)


def test_numbered_scan_reads_only_the_wanted_columns(spark, tmp_path):
    spark.range(1000).selectExpr("id as a", "cast(id as string) as b", "id as c").repartition(3).write.parquet(str(tmp_path / "t"))
    rows = scans.batch(spark.read.parquet(str(tmp_path / "t")).select("a"), 10, 5)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<a:bigint>" in plan and "b:string" not in plan
    assert rows.count() == 10


def test_footers(spark, tmp_path):
    spark.range(0, 1000, 1, 2).selectExpr("id", "repeat('x', 1000) as pad").write.parquet(str(tmp_path / "t"))
    found = scans.parquet_counts(spark, str(tmp_path / "t"))
    assert sorted(r.n_rows for r in found.collect()) == [500, 500]
    assert "ReadSchema: struct<>" in found._jdf.queryExecution().executedPlan().toString()
    lines(tmp_path / "x" / "a.jsonl", ["{}", "", "{}"])
    assert [(r.file, r.n_rows) for r in scans.line_counts(spark, str(tmp_path / "x")).collect()] == [("a.jsonl", 2)]


def test_gaps(spark):
    names = spark.createDataFrame([(f"seg_{k:03d}.json",) for k in (2, 3, 5, 5, 9)] + [("readme.md",), (None,)], "file string")
    assert sorted(map(tuple, scans.numbering_gaps(names).collect())) == [(4, "missing"), (5, "doubled"), (6, "missing"), (7, "missing"), (8, "missing")]
    assert scans.numbering_gaps(names.limit(0)).count() == 0


def test_evaluation_sets(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.json").write_text(json.dumps([{"problem": "p", "answer": 7, "other": [1]}]))
    (tmp_path / "a" / "y.json").write_text(json.dumps({"data": [{"problem": "q", "id": "i"}, {"problem": None}]}))
    lines(tmp_path / "a" / "z.jsonl", ['{"problem": "r", "solution": "s"}', ""])
    rows = scans.read_evaluation(spark, str(tmp_path / "a"))
    assert rows.columns == list(scans.EVALUATED)
    assert sorted(((r.problem, r.answer, r.solution, r.id) for r in rows.collect()), key=repr) == [("p", "7", None, None), ("q", None, None, "i"), ("r", None, "s", None), (None, None, None, None)]
    spark.createDataFrame([("p", 1, b"big")], "problem string, problem_idx int, image binary").write.parquet(str(tmp_path / "b"))
    table = scans.read_evaluation(spark, str(tmp_path / "b"))
    assert table.columns == ["problem", "problem_idx"] and "image" not in table._jdf.queryExecution().executedPlan().toString()
    lines(tmp_path / "b" / "more.jsonl", ["{}"])
    with pytest.raises(ValueError, match="mixed"):
        scans.read_evaluation(spark, str(tmp_path / "b"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "note.txt").write_text("x")
    with pytest.raises(FileNotFoundError):
        scans.read_evaluation(spark, str(tmp_path / "c"))


def test_corpus_texts(spark, tmp_path):
    lines(tmp_path / "a.jsonl", ['{"text": "one"}', '{"text": " "}', '{"no": 1}'])
    lines(tmp_path / "sub" / "b.ndjson", ['{"text": "two"}'])
    assert sorted(r.text for r in scans.corpus_texts(spark, str(tmp_path)).collect()) == ["one", "two"]
    assert [r.text for r in scans.corpus_texts(spark, str(tmp_path / "a.jsonl"), most=1).collect()] == ["one"]


# --- sinks


def test_batches_of_records(spark, tmp_path):
    folder = str(tmp_path / "sink")
    rows = spark.createDataFrame([(2, "é", {"b": 1, "a": 2}, [Row(z=1.5, y=None)]), (1, None, None, None)], "n long, a string, m map<string,int>, s array<struct<z double, y string>>").repartition(2)
    for _ in range(2):
        sinks.append(rows, folder, "one")
    sinks.append(rows.limit(0), folder, "none")
    schema = "n long, a string, m map<string,int>, s array<struct<y string, z double>>"
    assert sorted(r.n for r in sinks.read_batches(spark, folder, schema).collect()) == [1, 2]
    assert [(m["batch"], m["rows"]) for m in sinks.manifests(folder)] == [("none", 0), ("one", 2)]
    text = sorted(line for m in sinks.manifests(folder) for f in m["files"] for line in open(f"{folder}/{f}", encoding="utf-8"))
    assert text == ['{"a":"é","m":{"a":2,"b":1},"n":2,"s":[{"y":null,"z":1.5}]}\n', '{"a":null,"m":null,"n":1,"s":null}\n']
    sinks.append(rows.where("n = 1"), folder, "two", overwrite=True)
    assert [m["batch"] for m in sinks.manifests(folder)] == ["two"]
    with pytest.raises(Exception, match="unsafe batch"):
        sinks.append(rows, folder, "../x")


def test_failed_batch_leaves_nothing(spark, tmp_path):
    folder = str(tmp_path / "sink")
    sinks.append(spark.range(3), folder, "good")
    broken = spark.range(0, 1000, 1, 4).select(F.when(F.col("id") == 900, F.raise_error(F.lit("half-way"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="half-way"):
        sinks.append(broken, folder, "bad")
    assert [m["batch"] for m in sinks.manifests(folder)] == ["good"]
    assert len(list((tmp_path / "sink" / "parts").iterdir())) == 1
    sinks.append(spark.range(5), folder, "bad")
    assert sinks.read_batches(spark, folder, "id long").count() == 8


# --- blobs


def test_blobs(spark, tmp_path):
    store = blobs.BlobTable(spark, str(tmp_path / "blobs"))
    rows = spark.createDataFrame([("a/1.png", b"same", "image/png"), ("b", b"same", "image/png"), ("c", b"", "text/plain"), ("d", b"other", "x/y")], "key string, content binary, media_type string")
    assert store.rows().count() == 0
    refs = store.put(rows)
    store.put(rows)
    assert store.rows().count() == 3
    got = {r.key: (r.content, r.problem) for r in store.get(refs).collect()}
    assert got == {"a/1.png": (b"same", None), "b": (b"same", None), "c": (b"", None), "d": (b"other", None)}
    store.rows().where(F.col("content") == b"other").withColumn("content", F.lit(b"othex")).write.partitionBy("head").parquet(str(tmp_path / "changed"))
    changed = blobs.BlobTable(spark, str(tmp_path / "changed"))
    assert {r.key: (r.content, r.problem) for r in changed.get(refs).collect()} == {"a/1.png": (None, "missing"), "b": (None, "missing"), "c": (None, "missing"), "d": (None, "changed")}


@pytest.mark.parametrize("key", ["../x", "a/../x", "/x", "c:/x", "a\\..\\x", "a//b", "./a", "", None])
def test_unsafe_keys(spark, tmp_path, key):
    rows = spark.createDataFrame([("ok", b"1", "x/y"), (key, b"2", "x/y")], "key string, content binary, media_type string")
    assert [r.s for r in rows.select(blobs.safe_key(F.col("key")).alias("s")).collect()] == [True, False]
    with pytest.raises(Exception, match="unsafe storage key"):
        blobs.BlobTable(spark, str(tmp_path / "blobs")).put(rows)
    assert not (tmp_path / "blobs").exists()


def test_artifacts(spark):
    schema = "name string, kind string, uri string, media_type string, sha256 string"
    old = spark.createDataFrame([("a", "image", "blobs/1", "image/png", "1"), ("b", "blob", "blobs/2", "x/y", "2")], schema)
    new = spark.createDataFrame([("b", "video_reference", "https://v", "video/mp4", None), ("c", "binary", "blobs/3", "x/y", "3")], schema)
    assert sorted(r.uri for r in blobs.registered(old, new).collect()) == ["blobs/1", "blobs/3", "https://v"]
    bad = {("image", "u", "text/x"): "image_needs_image_type", ("video_reference", " ", "video/x"): "uri_is_required", ("video_reference", "u", None): "video_needs_video_type", (None, "u", "x"): "unknown_kind"}
    rows = spark.createDataFrame(list(bad), "k string, u string, m string").select("k", "u", "m", blobs.reference_problem(F.col("k"), F.col("u"), F.col("m")).alias("p")).collect()
    assert {tuple(r)[:3]: r.p for r in rows} == bad
    with pytest.raises(Exception, match="x: uri_is_required"):
        blobs.registered(old, new.limit(1).withColumn("uri", F.lit("")).withColumn("name", F.lit("x"))).collect()


# --- versions


def test_versions(spark, tmp_path):
    table, other = (versions.VersionedTable(spark, str(tmp_path)) for _ in range(2))
    with pytest.raises(KeyError):
        table.read()
    assert table.commit(spark.range(1), 0, "first") == 1
    base = other.head()
    assert table.commit(spark.range(2), base) == 2
    with pytest.raises(versions.BaseMoved):
        other.commit(spark.range(9), base)
    with pytest.raises(versions.BaseMoved):  # both saw the same head, one was first
        other._append(base, kind="commit", version=9, parent=1, data="none", reason="")
    assert table.activate(1, 2) == 3 and table.active() == 1 and table.active(2) == 2
    assert (table.read().count(), table.read(entry=2).count(), table.read(version=2).count()) == (1, 2, 2)
    assert other.commit(spark.range(7), other.head()) == 4
    assert [(r.entry, r.kind, r.version, r.parent) for r in table.log().orderBy("entry").collect()] == [(1, "commit", 1, None), (2, "commit", 2, 1), (3, "activate", 1, 2), (4, "commit", 4, 1)]
    with pytest.raises(KeyError):
        table.activate(3, 4)


# --- hypotheses


def test_hypotheses_as_fold_and_as_stream(spark, tmp_path):
    pick = random.Random(1)
    rows = [("s", f"h{h}", b, pick.choice(["support", "support", "oppose", "not_tested", "not_tested"])) for b in range(1, 9) for h in range(12) if pick.random() < 0.8]
    rows += [("s", "h0", 4, "oppose"), ("t", "h0", 1, "support"), ("t", "h0", 2, "support")]
    names = ("strategy", "hypothesis", "batch", "verdict")
    for b in range(1, 5):
        lines(tmp_path / "in" / f"{b}.json", [json.dumps(dict(zip(names, r, strict=True))) for r in rows if r[2] in (2 * b - 1, 2 * b)])
    state = {"in": str(tmp_path / "in"), "out": str(tmp_path / "out"), "at": str(tmp_path / "at")}
    fold = lambda some: sorted((tuple(r) for r in hypotheses.fold(spark.createDataFrame(some, hypotheses.OBSERVED)).collect()), key=repr)
    stream = lambda: sorted((tuple(r) for r in hypotheses.run_stream(spark, state["in"], state["out"], state["at"]).collect()), key=repr)
    assert stream() == fold(rows)
    lines(tmp_path / "in" / "again.json", [json.dumps(dict(zip(names, r, strict=True))) for r in rows if r[2] <= 8])
    assert stream() == fold(rows)  # batches that were seen change nothing
    lines(tmp_path / "in" / "new.json", [json.dumps(dict(zip(names, ("s", "h0", 9, "support"), strict=True)))])
    assert stream() == fold([*rows, ("s", "h0", 9, "support")])


def test_promotion_is_capped_and_retirement_is_for_good(spark):
    s, o, n = "support", "oppose", "not_tested"
    seen = {"a": [s, s], "b": [s, o, s, s], "c": [s, s, n, n], "d": [n, n, s, s], "e": [n, s, s], "f": [n, s, s], "g": [s, o, o]}
    rows = [("x", h, b, v) for h, vs in seen.items() for b, v in enumerate(vs, 1)]
    got = {r.hypothesis: (r.status, r.since) for r in hypotheses.statuses(hypotheses.fold(spark.createDataFrame(rows, hypotheses.OBSERVED))).collect()}
    assert got == {"a": ("promoted", 2), "c": ("promoted", 2), "b": ("promoted", 3), "e": ("open", None), "f": ("open", None), "d": ("retired", 2), "g": ("open", None)}


# --- tags, streams, references, gates, profiles

SAID = {
    "The caption is far too small. Fine": ["text_too_small"],
    "illegible": ["text_too_small"],
    "Target text differs, a TYPO": ["OCR_mismatch", "text_misspelled"],
    "misspelled": ["OCR_mismatch"],
    "colour shift and the person looks different": ["identity_swap", "color_drift"],
    "too many elements": ["count_wrong", "background_too_busy"],
    "shadows don't match": ["lighting_inconsistent"],
    "frame-to-frame drift; identity drift": ["identity_swap", "temporal_inconsistency"],
    "All is well.": [],
    "": [],
}


def test_failure_tags(spark):
    rows = spark.createDataFrame(list(SAID), "string").select("value", diagnosis.text_hits(F.col("value")).alias("h"))
    assert {r.value: [h.tag for h in r.h] for r in rows.collect()} == SAID
    reviews = [(1, [("a1", 4.5, "halo"), ("a2", 1.0, "a halo; duplicate"), ("a3", 2.0, "duplicate typo")]), (2, None), (3, [("a1", None, "halo"), ("a2", 1.0, None)])]
    tagged = diagnosis.failure_tags(spark.createDataFrame(reviews, "id long, axes array<struct<axis string, score double, reason string>>"))
    assert {r.id: r.tags for r in tagged.collect()} == {1: ["count_wrong", "artifact_visible", "text_misspelled"], 2: [], 3: []}
    assert len({tag for tag, _, _ in diagnosis.RULES}) == len(diagnosis.RULES) == 36


def test_chat_streams(spark):
    words = [f"w{k} " for k in range(500)]
    chunk = lambda k: json.dumps({"id": "i", "model": f"m{k // 400}", "choices": [{"delta": {"content": words[k], "reasoning": "r" if k == 3 else None}, "finish_reason": "stop" if k == 499 else None}, *([{"index": 7, "delta": {"role": "tool", "content": "t"}}] if k % 100 == 0 else [])]})
    rows = [("a", k, chunk(k)) for k in range(500)] + [("b", 1, "{broken"), ("b", 2, '{"choices": []}'), ("c", 1, '{"choices": [{"message": {"role": "user", "content": "whole"}}], "usage": {"n": 3}}')]
    random.Random(2).shuffle(rows)
    chunks = spark.createDataFrame(rows, "stream string, seq long, chunk string").repartition(6)
    got = {(r.stream, r["index"]): (r.role, r.finish_reason, r.reasoning, r.content) for r in streams.chat_messages(chunks, piece=32).collect()}
    assert got == {("a", 0): ("assistant", "stop", "r", "".join(words)), ("a", 7): ("tool", None, "", "ttttt"), ("c", 0): ("user", None, "", "whole")}
    heads = {r.stream: (r.id, r.model, r.usage) for r in streams.chat_heads(chunks).collect()}
    assert heads["a"] == ("i", "m1", None) and json.loads(heads["c"][2]) == {"n": 3}
    body = 'data: {"a": 1}\r\n\r\n: ping\ndata:{"b":2}\n data: [DONE]\nevent: x\ndata:\n'
    assert [r.chunk for r in streams.stream_chunks(spark.createDataFrame([("s", body)], "stream string, body string")).orderBy("seq").collect()] == ['{"a": 1}', '{"b":2}']


def test_chat_policy(spark):
    rows = [(1, "r", None, "c"), (2, None, "s", None), (3, None, None, None), (4, "r", None, "<think>a</think> <answer>b</answer>"), (5, "", "", "c")]
    m = spark.createDataFrame(rows, "k int, reasoning_content string, reasoning string, content string").withColumn("m", F.struct("reasoning_content", "reasoning", "content"))
    got = {r.k: (r.a, r.b) for r in m.select("k", streams.chat_text(F.col("m"), True).alias("a"), streams.chat_text(F.col("m"), " OMIT ").alias("b")).collect()}
    wrapped = "<think>{}</think>\n<answer>{}</answer>".format
    assert got == {1: (wrapped("r", "c"), "c"), 2: (wrapped("s", ""), None), 3: (None, None), 4: (rows[3][3], rows[3][3]), 5: (wrapped("", "c"), "c")}
    with pytest.raises(TypeError):
        streams.chat_text(F.col("m"), "yes")


def test_code(spark):
    said = {"a\n```python\nx = 1\n```\n```\ny\n```": "x = 1", "```\nz\n```": "z", " plain ": "plain", "```\nopen": None, " ": None, "": None}
    rows = spark.createDataFrame([(t,) for t in [*said, None]], "t string").select("t", answers.first_code(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == said | {None: None}


TEXTS = {
    "plain": [("rationale", "plain")],
    "a\n```python\nx = 1\nprint(x)\n```\n```output\n1\n```\nso b": [("rationale", "a\n"), ("program", "x = 1\nprint(x)\n"), ("output", "1\n"), ("rationale", "so b")],
    "```python\nopen": [("program", "open")],
    "```python\nx\n```\n```output\nNameError": [("program", "x\n"), ("output", "NameError")],
    "```python\n```": None,
    "```python\nx\n```python\n": None,
    "": [],
}


def test_trajectories(spark):
    rows = spark.createDataFrame(list(TEXTS), "string").select("value", streams.trajectory(F.col("value")).alias("b")).withColumn("again", streams.trajectory_text(F.col("b")))
    for r in rows.collect():
        assert (None if r.b is None else [tuple(x) for x in r.b]) == TEXTS[r.value]
    whole = "a\n```python\nx\n```\n```output\n1\n```\nend\n"
    back = spark.createDataFrame([whole], "string").select(streams.trajectory_text(streams.trajectory(F.col("value"))).alias("t"), streams.program_outputs(F.col("value")).alias("o"))
    assert tuple(back.first()) == (whole, ["1"])
    two = "```python\nimport a\nbad\n```\n```output\nNameError: x\n```\n```python\nprint(1)\ny\n```\n```output\n1\n```\n```python\nprint(2)\n```\n```output\n2\n```\n"
    assert spark.createDataFrame([(two,), ("```python\n```",)], "value string").select(streams.last_program(F.col("value")).alias("p")).collect() == [("import a\ny\n\nprint(2)\n",), ("raise ValueError('Invalid trajectory')",)]


def test_rehoming(spark):
    ref = "struct<kind string, uri string, media_type string, sha256 string>"
    schema = f"id long, top {ref}, deep struct<a array<struct<m map<string, struct<r array<{ref}>, n int>>>>, uri string>, other array<int>"
    r = lambda uri: Row(kind="image", uri=uri, media_type="image/png", sha256="s")
    data = [
        (1, r("old/x"), Row(a=[Row(m={"k": Row(r=[r("old/y"), None, r("older/z")], n=1), "none": None}), None, Row(m=None)], uri="old/stays"), [1]),
        (2, None, None, None),
        (3, r(None), Row(a=None, uri=None), []),
    ]
    rows = spark.createDataFrame(data, schema)
    out = rehoming.rewrite_references(rows, rehoming.moved("old", "new/home"))
    assert out.schema.simpleString() == rows.schema.simpleString()
    got = {x.id: x for x in out.collect()}
    assert got[1].top.uri == "new/home/x" and got[1].deep.uri == "old/stays" and got[1].other == [1]
    assert [x and x.uri for x in got[1].deep.a[0].m["k"].r] == ["new/home/y", None, "older/z"] and got[1].deep.a[0].m["none"] is None
    assert got[1].deep.a[1:] == [None, Row(m=None)] and tuple(got[2]) == (2, None, None, None) and got[3].deep.a is None
    assert sorted((x.id, x.uri) for x in rehoming.references(out, "id").where("uri is not null").collect()) == [(1, "new/home/x"), (1, "new/home/y"), (1, "older/z")]


@pytest.mark.parametrize(
    ("choices", "want"),
    [(["a", " ", "c", "d"], "blank_choice"), (["a", None, "c", "d"], "blank_choice"), (["A ", "b", "c", "d"], None), (["a", "a", "c", "d"], "answer_not_unique_choice"), (None, "choices_not_four")],
)
def test_handoff(spark, choices, want):
    row = spark.createDataFrame([("q", "a", [None], ["e"], choices)], "q string, a string, cited array<string>, allowed array<string>, c array<string>")
    assert row.select(gates.handoff_problem(*[F.col(c) for c in row.columns])).first()[0] == want


def test_gates_count_nulls_as_none_and_words_once(spark):
    none = F.lit(None).cast("int")
    row = spark.range(1)
    assert row.select(gates.complexity_problem(F.lit("x"), none, none, none, none, F.lit(False)), gates.complexity_problem(F.lit("x"), F.lit(1), none, none, none, F.lit(False))).first()[:] == ("insufficient_evidence_units", "insufficient_reasoning_hops")
    said = lambda q, a, *more: row.select(gates.distractor_problem(F.lit(q), F.array(*map(F.lit, (a, *more))), F.lit(a))).first()[0]
    assert said("what is it", "the dog the dog the dog the dog", "the cat the cat the cat the cat", "the hat the hat the hat the hat", "red") is None
    assert said("the red dog sits on the old mat", "the red dog sits on the mat", "b", "c", "d") == "answer_leaked_in_question"
    assert said("the red dog", "the red dog", "b", "c", "d") is None


def test_scalar_profile(spark):
    texts = ['{"a": {"b": {"c": 1, "d": {"e": 2}}}, "x": "1", "l": [1], "n": null}', '{"a": "{\\"b\\": {\\"c\\": 1}}", "x": 1.5, "o": {}}', "", "[1]", "broken {", None, json.dumps({"x": "y" * 161, "t": True})]
    rows = spark.createDataFrame([(t,) for t in texts], "j string")
    got = sorted((r.path, r.value, r.n, r.present_rows, r.missing_rows) for r in profiles.scalar_profile(rows, "j").collect())
    assert got == [("a.b.c", "1", 2, 2, 3), ("n", "null", 1, 1, 4), ("t", "true", 1, 1, 4), ("x", "1", 1, 2, 3), ("x", "1.5", 1, 2, 3)]
    many = spark.range(100).selectExpr("""concat('{"id": ', id, ', "few": ', id % 20, '}') as j""")
    assert {r.path for r in profiles.scalar_profile(many, "j").collect()} == {"few"}
    assert profiles.scalar_profile(rows.limit(0), "j").count() == 0
