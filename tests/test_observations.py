"""The evidence chain against a plain version that looks at all pairs."""

import random
import re

from pyspark.sql import functions as F

from corpusloom.operators import observations as O

MOTION = re.compile(r"\b(walk|turn|leave)\w*\b", re.I)


def made_up(seed):
    pick = random.Random(seed)
    span = lambda: {"start_sec": pick.choice([None, -3.0, 0.0, 5.0, 20.0, 61.0]), "end_sec": pick.choice([None, 4.0, 20.0, 59.0, 80.0])}
    rows = []
    for video in "uvw":
        for k in range(pick.randint(1, 4)):
            events = [span() | {"participants": pick.choice([None, ["a", "b", "a"], ["c"], []]), "description": pick.choice(["he walks", " sits ", "", None, "Turned"]), "visible_preconditions": pick.choice(["x", " ", None]), "visible_outcome": pick.choice(["y", ""]), "uncertainty": None} for _ in range(pick.randint(0, 4))]
            updates = [{"entity_id": pick.choice(["a", "b", "", None]), "evidence_intervals": pick.choice([None, [], [span(), span()]]), "attributes": {"k": "v"}} for _ in range(pick.randint(0, 3))]
            caption = pick.choice([None, "", "all day", "pre [00:05-00:10] one [00:50-02:00] leaves[00:09-00:03] lost [00:01-00:02] "])
            rows.append({"video": video, "segment_index": k, "start_sec": 60.0 * k, "duration_sec": 60.0, "caption": caption, "entity_updates": pick.choice([None, updates]), "observed_events": events})
    return rows


def plain_units(rows):
    out = []
    text = lambda x: (x or "").strip()
    for o in rows:
        base, d = o["start_sec"], o["duration_sec"]
        for k, e in enumerate(o["observed_events"] or [], 1):
            s, t = max(0.0, e["start_sec"] or 0.0), min(d, d if e["end_sec"] is None else e["end_sec"])
            out.append((o["video"], f"a_{o['segment_index']:04d}_entity_{k:02d}", base + s, base + t, text(e["description"]), sorted(set(e["participants"] or [])), text(e["visible_preconditions"]), text(e["visible_outcome"])))
        spans, caption = [], o["caption"] or ""
        for part in re.split(r"(?=\[\d+:[0-5]\d-\d+:[0-5]\d\])", caption):
            m = re.match(r"\[(\d+):(\d+)-(\d+):(\d+)\]", part)
            s, t = (min(d, 60.0 * int(m[1]) + int(m[2])), min(d, 60.0 * int(m[3]) + int(m[4]))) if m else (0.0, d)
            said = part[m.end() if m else 0 :].strip()
            if said and t >= s:
                spans.append((s, t, said))
        for k, (s, t, said) in enumerate(spans, 1):
            meets = lambda i: (-1.0 if i["end_sec"] is None else i["end_sec"]) >= s and (1e18 if i["start_sec"] is None else i["start_sec"]) <= t  # noqa: E731, B023
            who = {u["entity_id"] for u in o["entity_updates"] or [] if u["entity_id"] is not None and any(map(meets, u["evidence_intervals"] or []))}
            out.append((o["video"], f"a_{o['segment_index']:04d}_caption_{k:02d}", base + s, base + t, said, sorted(who), "", ""))
    return out


def plain_candidates(units, most):
    out = []
    for video in sorted({u[0] for u in units}):
        line = sorted((u for u in units if u[0] == video and u[4]), key=lambda u: (u[2], u[3], u[1]))
        found = {t: [] for t, _ in O.TASKS}
        put = lambda task, evidence, who, alone=False: found[task].append((evidence, sorted(set(who)), alone))  # noqa: E731, B023
        firsts = sorted({e for u in line for e in u[5]}, key=lambda e: (min(k for k, u in enumerate(line) if e in u[5]), e))
        for e in firsts:
            own = [u for u in line if e in u[5]]
            if len(own) >= 2:
                put("entity_tracking", [own[0], own[-1]], [e])
                put("cross_event_comparison", [own[0], own[-1]], [e])
            if len(own) >= 3:
                put("conditional_counting", [own[0], own[len(own) // 2], own[-1]], [e])
                put("multi_hop_reasoning", [own[0], own[len(own) // 2], own[-1]], [e])
        for u in line:
            later = [v for v in line if v[2] > max(u[2], u[3]) and set(u[5]) & set(v[5])]
            chain = [u, min(later, key=lambda v: v[2])] if later else [u]
            who = [e for v in chain for e in v[5]]
            if u[6] and u[7]:
                put("state_change", chain, who, not later)
            if MOTION.search(u[4]):
                put("dynamic_spatial_trajectory", chain, who)
        for a, b in zip(line, line[1:]):
            if b[2] >= a[3]:
                put("temporal_relation", [a, b], [*a[5], *b[5]])
            if set(a[5]) & set(b[5]) and a[7] and b[6]:
                put("causal_event_dependency", [a, b], set(a[5]) & set(b[5]))
        number = 0
        for task, least in O.TASKS:
            scored = []
            for evidence, who, alone in found[task]:
                hops, span = max(least, len(evidence) - 1), max(u[3] for u in evidence) - min(u[2] for u in evidence)
                scored.append((-(hops + min(3.0, max(0.0, span / 60))), -span, [u[1] for u in evidence], who, hops, alone))
            seen = []
            for score, span, ids, who, hops, alone in sorted(scored, key=lambda x: x[:2]):
                if ids not in seen and len(seen) < most:
                    seen.append(ids)
                    number += 1
                    out.append((video, f"tc_{number:05d}", task, ids, who, hops, -span, -score, alone))
    return out


def test_chain(spark):
    for seed, most in ((1, 1), (2, 2), (3, 50), (4, 50)):
        rows = made_up(seed)
        observed = spark.createDataFrame(rows, O.OBSERVATION)
        units = O.evidence_units(observed)
        got = sorted((r.video, r.evidence_id, r.start_sec, r.end_sec, r.text, r.entity_ids, r.visible_preconditions, r.visible_outcome) for r in units.collect())
        want = plain_units(rows)
        assert got == sorted(want)
        assert sorted(map(tuple, O.task_candidates(units, most).collect())) == sorted(plain_candidates(want, most))


def test_tracks(spark):
    i = lambda s, e: {"start_sec": s, "end_sec": e}
    u = lambda name, *more, **a: {"entity_id": name, "evidence_intervals": list(more) or None, "attributes": a}
    row = lambda k, *updates: {"video": "v", "segment_index": k, "start_sec": 60.0 * k, "duration_sec": 60.0, "caption": "", "entity_updates": list(updates), "observed_events": []}
    rows = [row(1, u("a", c="red"), u("", i(0.0, 1.0))), row(0, u("a", i(-5.0, 10.0), i(50.0, 99.0), i(30.0, 20.0), i(None, None)), u(None), u("b", i(70.0, 80.0)))]
    got = [(r.entity_id, r.number, r.segment_index, r.start_sec, r.end_sec, r.attributes) for r in O.entity_tracks(spark.createDataFrame(rows, O.OBSERVATION)).orderBy("entity_id", "number").collect()]
    assert got == [("a", 1, 0, 0.0, 10.0, {}), ("a", 2, 0, 0.0, 60.0, {}), ("a", 3, 0, 50.0, 60.0, {}), ("a", 4, 1, 60.0, 120.0, {"c": "red"})]


def test_frontier_keeps_all_rows(spark):
    rows = spark.createDataFrame([("t", "easy", 4, 9.0, 1), ("t", "frontier", 1, None, 2), ("t", "frontier", 2, 1.0, 3), ("t", "frontier", 2, 5.0, 4), ("u", None, None, None, 5)], "task string, bucket string, correct int, span double, ordinal int")
    assert {r.ordinal: r.frontier_selected for r in O.marked_frontier(rows, ["task"]).collect()} == {1: False, 2: False, 3: False, 4: True, 5: True}
    assert O.marked_frontier(rows.withColumn("x", F.lit(1)).limit(0), ["task"]).count() == 0


def test_task_candidates_by_tasks_of_units(spark, monkeypatch):
    """Tasks grow in number with the units, whatever the session's number of partitions; results are those of few tasks."""
    units = spark.range(3000).select(
        F.concat(F.lit("v"), F.col("id") % 50).alias("video"), F.concat(F.lit("u"), "id").alias("evidence_id"), F.col("id").cast("double").alias("start_sec"), (F.col("id") + 7.0).alias("end_sec"), F.lit("walks").alias("text"),
        F.array(F.concat(F.lit("e"), F.col("id") % 3)).alias("entity_ids"), F.lit("b").alias("visible_preconditions"), F.lit("a").alias("visible_outcome"),
    )
    few = O.task_candidates(units, 2)
    monkeypatch.setattr(O, "TASK_UNITS", 60)
    many = O.task_candidates(units, 2)
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(video" in plan and ", 50)" in plan and ", 4)" not in plan.replace("floor", "")
    assert sorted(map(repr, few.collect())) == sorted(map(repr, many.collect())) and few.count() > 50 * 8
