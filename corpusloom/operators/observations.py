"""From observed segments to units of evidence, tracks of entities, and candidates of every family of tasks.

Observations are (video, segment_index, start_sec, duration_sec, caption, entity_updates, observed_events). Nested lists are
taken apart row by row; what compares units works within a video, by windows in order of time, without pairing them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import has_motion, stripped
from corpusloom.operators.evidence import TIMESTAMP
from corpusloom.sources.shared import scratch

# Families of tasks and the least number of steps of each, in the order in which candidates are numbered.
TASKS = (("entity_tracking", 1), ("state_change", 1), ("temporal_relation", 1), ("conditional_counting", 2), ("dynamic_spatial_trajectory", 1), ("cross_event_comparison", 2), ("causal_event_dependency", 2), ("multi_hop_reasoning", 2))
# Fixed value: units of a task where they are compared.
TASK_UNITS = 100_000
UPDATES = "entity_updates array<struct<entity_id: string, evidence_intervals: array<struct<start_sec: double, end_sec: double>>, attributes: map<string,string>>>"
EVENTS = "observed_events array<struct<start_sec: double, end_sec: double, participants: array<string>, description: string, visible_preconditions: string, visible_outcome: string, uncertainty: string>>"
OBSERVATION = f"video string, segment_index int, start_sec double, duration_sec double, caption string, {UPDATES}, {EVENTS}"


def _text(value: Column) -> Column:
    return stripped(F.coalesce(value, F.lit("")))


def _spans(caption: Column, duration: Column) -> Column:
    """array of (start, end, text, quality) of a caption's parts, times from its start."""
    mark = f"\\A{TIMESTAMP}"
    minute = lambda part, group: F.regexp_extract(part, mark, group).cast("long") * 60 + F.regexp_extract(part, mark, group + 1).cast("long")

    def span(part: Column) -> Column:
        marked = part.rlike(mark)
        start = F.when(marked, F.least(duration, minute(part, 1).cast("double"))).otherwise(0.0)
        end = F.when(marked, F.least(duration, minute(part, 3).cast("double"))).otherwise(duration)
        return F.struct(start.alias("start"), end.alias("end"), stripped(F.regexp_replace(part, mark, "")).alias("text"), F.when(marked, "anchored").otherwise("unanchored_prefix").alias("quality"))

    parts = F.transform(F.split(F.coalesce(caption, F.lit("")), f"(?={TIMESTAMP})"), span)
    return F.filter(parts, lambda p: (p["text"] != "") & ((p["quality"] != "anchored") | (p["end"] >= p["start"])))


def _present(updates: Column, start: Column, end: Column) -> Column:
    """Entities with an interval that meets [start, end]; without a start or an end an interval meets nothing."""
    meets = lambda i: (F.coalesce(i["end_sec"], F.lit(-1.0)) >= start) & (F.coalesce(i["start_sec"], F.lit(1e18)) <= end)
    found = F.filter(updates, lambda u: u["entity_id"].isNotNull() & F.coalesce(F.exists(u["evidence_intervals"], meets), F.lit(False)))
    return F.coalesce(F.array_sort(F.array_distinct(F.transform(found, lambda u: u["entity_id"]))), F.array().cast("array<string>"))


def evidence_units(observations: DataFrame) -> DataFrame:
    """Units (video, evidence_id, source_kind, segment_index, start_sec, end_sec, text, entity_ids, visible_preconditions, visible_outcome, uncertainty, timestamp_quality).

    Observed events are clipped to their segment; one that ends before it starts stays. Caption parts get the entities that are present.
    """
    key = ["video", "segment_index", F.col("start_sec").alias("base"), "duration_sec"]
    name = lambda kind: F.format_string(f"a_%04d_{kind}_%02d", "segment_index", F.col("at") + 1)
    events = observations.select(*key, F.posexplode("observed_events").alias("at", "e"))
    start = F.greatest(F.lit(0.0), F.coalesce("e.start_sec", F.lit(0.0)))
    end = F.least("duration_sec", F.coalesce("e.end_sec", "duration_sec"))
    who = F.coalesce(F.array_sort(F.array_distinct("e.participants")), F.array().cast("array<string>"))
    one = events.select(
        "video", name("entity").alias("evidence_id"), F.lit("entity_event").alias("source_kind"), "segment_index", (F.col("base") + start).alias("start_sec"), (F.col("base") + end).alias("end_sec"), _text(F.col("e.description")).alias("text"), who.alias("entity_ids"),
        *[_text(F.col(f"e.{c}")).alias(c) for c in ("visible_preconditions", "visible_outcome", "uncertainty")], F.lit("structured").alias("timestamp_quality"),
    )
    spans = observations.select(*key, "entity_updates", F.posexplode(_spans(F.col("caption"), F.col("duration_sec"))).alias("at", "s"))
    two = spans.select(
        "video", name("caption").alias("evidence_id"), F.lit("caption_span").alias("source_kind"), "segment_index", (F.col("base") + F.col("s.start")).alias("start_sec"), (F.col("base") + F.col("s.end")).alias("end_sec"), F.col("s.text").alias("text"),
        _present(F.col("entity_updates"), F.col("s.start"), F.col("s.end")).alias("entity_ids"), *[F.lit("").alias(c) for c in ("visible_preconditions", "visible_outcome", "uncertainty")], F.col("s.quality").alias("timestamp_quality"),
    )
    return one.unionByName(two)


def entity_tracks(observations: DataFrame) -> DataFrame:
    """(video, entity_id, number, segment_index, start_sec, end_sec, attributes): where each entity is seen, by time.

    Intervals are clipped to their segment; an update without any stands for the whole segment. Blank entities and intervals
    that end before they start are left out.
    """
    updates = observations.select("video", "segment_index", "start_sec", "duration_sec", F.explode("entity_updates").alias("u")).where("u.entity_id <> ''")
    kind = "array<struct<start_sec: double, end_sec: double>>"
    whole = F.array(F.struct(F.lit(0.0).alias("start_sec"), F.col("duration_sec").alias("end_sec"))).cast(kind)
    some = F.when(F.coalesce(F.size("u.evidence_intervals"), F.lit(0)) > 0, F.col("u.evidence_intervals")).otherwise(whole)
    rows = updates.select("*", F.explode(some).alias("i")).where("i is not null")
    start, end = F.greatest(F.lit(0.0), F.coalesce("i.start_sec", F.lit(0.0))), F.least("duration_sec", F.coalesce("i.end_sec", "duration_sec"))
    rows = rows.where(end >= start).select("video", F.col("u.entity_id").alias("entity_id"), "segment_index", (F.col("start_sec") + start).alias("start_sec"), (F.col("start_sec") + end).alias("end_sec"), F.col("u.attributes").alias("attributes"))
    by = Window.partitionBy("video", "entity_id").orderBy("start_sec", "end_sec", "segment_index")
    return rows.withColumn("number", F.row_number().over(by))


def _with_later(numbered: DataFrame, tasks: int) -> DataFrame:
    """Each unit with later: the first unit that starts beyond the end of this one and shares an entity with it."""
    marks = numbered.select("video", F.explode("entity_ids").alias("entity"), "n", F.struct("n", "unit", "entity_ids").alias("u"))
    nothing = F.lit(None).cast(marks.schema["u"].dataType)
    line = marks.select("video", "entity", F.col("u.unit.start_sec").alias("at"), F.lit(1).alias("kind"), "n", "u").unionByName(
        marks.select("video", "entity", F.greatest("u.unit.end_sec", "u.unit.start_sec").alias("at"), F.lit(0).alias("kind"), "n", nothing.alias("u"))
    )
    line = line.repartition(tasks, "video")
    after = Window.partitionBy("video", "entity").orderBy(F.desc("at"), "kind", F.desc("n")).rowsBetween(Window.unboundedPreceding, 0)
    line = line.withColumn("later", F.last("u", ignorenulls=True).over(after)).where("kind = 0 and later is not null")
    own = F.struct("unit", "entity_ids", "acts", "moves")
    every = numbered.select("video", "n", own.alias("own"), nothing.alias("later")).unionByName(line.select("video", "n", "later"), allowMissingColumns=True)
    found = every.repartition(tasks, "video").groupBy("video", "n").agg(F.first("own", ignorenulls=True).alias("own"), F.min("later").alias("later"))
    return found.select("video", "n", "own.*", "later")


def task_candidates(units: DataFrame, most: int = 1) -> DataFrame:
    """(video, candidate_id, task_type, evidence_ids, entity_ids, hop_count, temporal_span_sec, complexity_score, single_observation_fallback).

    Of each family of tasks a video keeps its ``most`` most complex candidates with different evidence, then those of the
    widest span, then the earliest. Units without text take no part. An event that ends before it starts counts as ending
    with its start when what comes later is sought.

    What the families need of the units is written once; from then on there is a task for every ``TASK_UNITS`` of them, so
    that the memory of a task does not grow with the table. A video stays within one task.
    """
    slim = units.where("text <> ''").select("video", F.struct("start_sec", "end_sec", "evidence_id").alias("unit"), "entity_ids", (F.col("visible_preconditions") != "").alias("pre"), (F.col("visible_outcome") != "").alias("outcome"), has_motion(F.col("text")).alias("moves"))
    folder = scratch(units.sparkSession, "units")
    slim.write.parquet(folder)
    kept = units.sparkSession.read.schema(slim.schema).parquet(folder)
    tasks = max(units.sparkSession.sparkContext.defaultParallelism, -(-kept.count() // TASK_UNITS))
    line = Window.partitionBy("video").orderBy("unit.start_sec", "unit.end_sec", "unit.evidence_id")
    numbered = kept.repartition(tasks, "video").withColumn("n", F.row_number().over(line)).withColumn("acts", F.col("pre") & F.col("outcome"))

    def family(task: str, where: Column, evidence: Column, entities: Column, second: Column | None = None, alone: Column | None = None) -> Column:
        one = F.struct(F.lit(task).alias("task_type"), evidence.alias("evidence"), F.array_sort(F.array_distinct(entities)).alias("entity_ids"), F.col("n").cast("long").alias("first"), (F.lit("") if second is None else second).alias("second"), (F.lit(False) if alone is None else alone).alias("alone"))
        return F.when(where, one)

    def families(rows: DataFrame, *some: Column) -> DataFrame:
        return rows.select("video", F.explode(F.array_compact(F.array(*some))).alias("f")).select("video", "f.*")

    by = Window.partitionBy("video", "entity").orderBy("n")
    seen = numbered.select("video", "n", "unit", F.explode("entity_ids").alias("entity")).withColumn("r", F.row_number().over(by)).withColumn("count", F.count("*").over(Window.partitionBy("video", "entity")))
    chains = seen.groupBy("video", "entity").agg(F.max("count").alias("count"), F.min("n").alias("n"), F.min_by("unit", "n").alias("a"), F.max(F.when(F.col("r") == F.floor(F.col("count") / 2) + 1, F.col("unit"))).alias("m"), F.max_by("unit", "n").alias("z"))
    who, pair, triple, named = F.array("entity"), F.array("a", "z"), F.array("a", "m", "z"), F.col("entity")
    twice = [family(t, F.col("count") >= 2, pair, who, named) for t in ("entity_tracking", "cross_event_comparison")]
    found = [families(chains, *twice, *[family(t, F.col("count") >= 3, triple, who, named) for t in ("conditional_counting", "multi_hop_reasoning")])]

    evidence = F.when(F.col("later").isNull(), F.array("unit")).otherwise(F.array("unit", F.col("later.unit")))
    both, alone = F.concat("entity_ids", F.coalesce("later.entity_ids", F.array().cast("array<string>"))), F.col("later").isNull()
    found.append(families(_with_later(numbered, tasks), family("state_change", F.col("acts"), evidence, both, alone=alone), family("dynamic_spatial_trajectory", F.col("moves"), evidence, both)))

    ahead = lambda c: F.lead(c).over(Window.partitionBy("video").orderBy("n"))
    next_to = numbered.select("video", "n", "unit", "entity_ids", "outcome", ahead("unit").alias("right"), ahead("entity_ids").alias("right_entities"), ahead("pre").alias("right_pre")).where("right is not null")
    shared, sides = F.array_intersect("entity_ids", "right_entities"), F.array("unit", "right")
    after = family("temporal_relation", F.col("right.start_sec") >= F.col("unit.end_sec"), sides, F.concat("entity_ids", "right_entities"))
    found.append(families(next_to, after, family("causal_event_dependency", (F.size(shared) > 0) & F.col("outcome") & F.col("right_pre"), sides, shared)))

    order = F.create_map(*[F.lit(x) for k, (t, _) in enumerate(TASKS) for x in (t, k)])[F.col("task_type")]
    hops = F.create_map(*[F.lit(x) for t in TASKS for x in t])[F.col("task_type")]
    rows = reduce(DataFrame.unionByName, found).repartition(tasks, "video")
    rows = rows.withColumn("evidence_ids", F.col("evidence.evidence_id")).withColumn("hop_count", F.greatest(hops, F.size("evidence") - 1))
    rows = rows.withColumn("temporal_span_sec", F.array_max("evidence.end_sec") - F.array_min("evidence.start_sec"))
    rows = rows.withColumn("complexity_score", F.col("hop_count") + F.least(F.lit(3.0), F.greatest(F.lit(0.0), F.col("temporal_span_sec") / 60)))
    best = [F.desc("complexity_score"), F.desc("temporal_span_sec"), "first", "second"]
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("video", "task_type", "evidence_ids").orderBy(*best))).where("r = 1")
    rows = rows.withColumn("r", F.row_number().over(Window.partitionBy("video", "task_type").orderBy(*best))).where(F.col("r") <= most)
    rows = rows.withColumn("candidate_id", F.format_string("tc_%05d", F.row_number().over(Window.partitionBy("video").orderBy(order, "r"))))
    return rows.select("video", "candidate_id", "task_type", "evidence_ids", "entity_ids", "hop_count", "temporal_span_sec", "complexity_score", F.col("alone").alias("single_observation_fallback"))


def marked_frontier(rows: DataFrame, group: list[str]) -> DataFrame:
    """All rows (bucket, correct, span, ordinal, ...) with frontier_selected: the best of each group by bucket, nearness to two correct, span, and order."""
    by = Window.partitionBy(*group).orderBy(F.when(F.col("bucket") == "frontier", 0).otherwise(1), F.abs(F.coalesce("correct", F.lit(0)) - 2), F.desc(F.coalesce("span", F.lit(0.0))), "ordinal")
    return rows.withColumn("frontier_selected", F.row_number().over(by) == 1)
