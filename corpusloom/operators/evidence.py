"""Evidence on a time axis: overlaps, later and neighbouring units, event fusion, task candidates, selection."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import content_tokens, stripped

# Fixed value: the mark before a part of a caption.
TIMESTAMP = r"\[(\d+):([0-5]\d)-(\d+):([0-5]\d)\]"


def overlapping(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of rows of one key whose closed intervals [start, end] meet; open ends are unbounded."""
    right = b.select(*keys, F.col("id").alias("other_id"), F.coalesce("start", F.lit(-1.0)).alias("other_start"), F.coalesce("end", F.lit(1e18)).alias("other_end"))
    left = a.select(*keys, "id", F.coalesce("start", F.lit(-1.0)).alias("start"), F.coalesce("end", F.lit(1e18)).alias("end"))
    return left.join(right, keys).where("end >= other_start and start <= other_end").select(*keys, "id", "other_id")


def earliest_later(units: DataFrame, key: str = "key") -> DataFrame:
    """For every unit (id, key, start, end) the unit of its key that starts first after its end; ties go to the smaller id.

    Per key the units are put in order of time, so no pairs are made: the answer is the least start beyond the end.
    """
    marks = units.select(key, F.col("start").alias("at"), F.lit(1).alias("kind"), F.struct("start", "id").alias("u"), F.lit(None).cast("long").alias("asks"))
    asks = units.select(key, F.col("end").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast(marks.schema["u"].dataType).alias("u"), F.col("id").alias("asks"))
    after = Window.partitionBy(key).orderBy(F.col("at").desc(), F.col("kind").asc(), F.col("u.id").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = marks.unionByName(asks).withColumn("next", F.last("u", ignorenulls=True).over(after))
    return line.where("kind = 0").select(key, F.col("asks").alias("id"), F.col("next.id").alias("next_id"))


def neighbours(units: DataFrame, key: str = "key") -> DataFrame:
    """Units of a key next to each other in time that do not overlap."""
    by = Window.partitionBy(key).orderBy("start", "end", "id")
    line = units.select(key, "id", "end", F.lead("id").over(by).alias("next_id"), F.lead("start").over(by).alias("next_start"))
    return line.where("next_start >= end").select(key, "id", "next_id")


def anchors(units: DataFrame, key: str = "key") -> DataFrame:
    """First, middle (n // 2) and last unit of every key with the number of units."""
    by = Window.partitionBy(key).orderBy("start", "id")
    line = units.select(key, "id", F.row_number().over(by).alias("r"), F.count("*").over(Window.partitionBy(key)).alias("n"))
    pick = lambda at: F.max(F.when(F.col("r") == at, F.col("id")))
    return line.groupBy(key).agg(F.max("n").alias("n"), pick(1).alias("first_id"), pick(F.floor(F.col("n") / 2) + 1).alias("middle_id"), pick(F.col("n")).alias("last_id"))


def selected_evidence(candidates: DataFrame, evidence: DataFrame) -> DataFrame:
    """Candidates (candidate, wanted ids) all of whose distinct evidence exists, with their time window."""
    asked = candidates.select("candidate", F.explode(F.array_distinct("wanted")).alias("id"))
    joined = asked.join(evidence.select("id", "start", "end"), "id", "left")
    got = joined.groupBy("candidate").agg(F.count("*").alias("asked"), F.count("start").alias("found"), F.min("start").alias("window_start"), F.max("end").alias("window_end"))
    return got.where("asked = found").select("candidate", F.col("found").alias("units"), "window_start", "window_end")


def fused_events(evidence: DataFrame, max_gap: float = 5.0, max_event: float = 180.0, similarity: float = 0.32) -> DataFrame:
    """Evidence (key, id, segment, start, end, entities, text) fused in time order into events.

    A unit joins the open event if the whole stays within ``max_event``, the gap is at most ``max_gap``, and they share an
    entity, have texts whose content words are alike, or overlap and the event has the unit's segment. What may join
    depends on the event so far, so units are folded in order; but no event crosses a gap of more than ``max_gap``, so
    a key is first cut there. Stretches without such gaps are dealt to tasks, and a task folds its many stretches as one
    stream that holds the open event only. A stretch of one unit is its own event and needs no fold.
    """

    nan = float("nan")  # a unit without a time joins nothing

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line, open_ = None, None
        for batch in batches:
            out = []
            for r in zip(*[c.to_pylist() for c in batch.columns]):
                key, stretch, id_, segment, start, end, entities, words = r
                start, end, entities, words = nan if start is None else start, nan if end is None else end, set(entities or ()), set(words or ())
                if open_ is not None and line == (key, stretch):
                    gap, both = start - open_["end"], open_["words"] | words
                    alike = len(open_["words"] & words) / len(both) if open_["words"] and words else 0.0
                    near = bool(open_["entities"] & entities) or alike >= similarity or gap <= 0 and segment in open_["segments"]
                    if max(end, open_["end"]) - open_["start"] <= max_event and gap <= max_gap and near:
                        open_["end"], open_["words"] = max(open_["end"], end), both
                        open_["entities"] |= entities
                        open_["segments"].add(segment)
                        open_["ids"].append(id_)
                        continue
                out += [open_] if open_ else []
                line, open_ = (key, stretch), {"key": key, "start": start, "end": end, "entities": entities, "words": words, "segments": {segment}, "ids": [id_]}
            yield written(out)
        yield written([open_] if open_ else [])

    def written(events: list[dict]) -> pa.RecordBatch:
        known = lambda x: x if x == x else None
        rows = [{"key": e["key"], "start": known(e["start"]), "end": known(e["end"]), "ids": e["ids"], "entities": sorted(e["entities"])} for e in events]
        return pa.RecordBatch.from_pylist(rows, pa.schema([("key", pa.int64()), ("start", pa.float64()), ("end", pa.float64()), ("ids", pa.list_(pa.int64())), ("entities", pa.list_(pa.string()))]))

    whole = F.col("start").cast("double").alias("start"), F.col("end").cast("double").alias("end")
    rows = evidence.select(F.col("key").cast("long").alias("key"), F.col("id").cast("long").alias("id"), F.coalesce("segment", F.lit(-1)).cast("long").alias("segment"), *whole, "entities", "text")
    line = Window.partitionBy("key").orderBy("start", "end", "id")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    far = lambda start, end: F.coalesce((start - end > max_gap).cast("long"), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("next", F.lead("start").over(line)).withColumn("first", F.row_number().over(line) == 1)
    rows = rows.withColumn("cut", far(F.col("start"), F.col("before")))
    rows = rows.withColumn("stretch", F.sum("cut").over(line.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    last = F.col("next").isNull() | (far(F.col("next"), F.greatest("before", "end")) == 1)
    rows = rows.withColumn("single", (F.col("first") | (F.col("cut") == 1)) & last)
    entities = F.array_sort(F.array_distinct(F.coalesce("entities", F.array().cast("array<string>"))))
    single = rows.where("single").select("key", "start", "end", F.array("id").alias("ids"), entities.alias("entities"))
    many = rows.where("not single").select("key", "stretch", "id", "segment", "start", "end", "entities", content_tokens(F.col("text")).alias("words"))
    many = many.repartition("key", "stretch").sortWithinPartitions("key", "stretch", F.asc_nulls_last("start"), F.asc_nulls_last("end"), "id")
    found = single.unionByName(many.mapInArrow(fold, "key long, start double, end double, ids array<long>, entities array<string>"))
    return found.withColumn("event", F.row_number().over(Window.partitionBy("key").orderBy("start", "end", "ids")) - 1)


def caption_spans(captions: DataFrame) -> DataFrame:
    """(key, start_sec, end_sec, description, quality) of captions (key, start_sec, duration_sec, caption).

    A part begins at its mark [mm:ss-mm:ss] and ends at the next; marked times count from the caption's start and are
    clipped to its duration. Text before the first mark is a part over the whole caption. Empty parts and those that
    would end before their start are left out.
    """
    part = F.posexplode(F.split("caption", f"(?={TIMESTAMP})")).alias("at", "part")
    rows = captions.where(F.col("caption").isNotNull()).select("key", "start_sec", "duration_sec", part)
    marked = F.col("part").rlike(f"\\A{TIMESTAMP}")
    time = lambda m: F.least("duration_sec", (F.regexp_extract("part", f"\\A{TIMESTAMP}", m).cast("long") * 60 + F.regexp_extract("part", f"\\A{TIMESTAMP}", m + 1).cast("long")).cast("double"))
    rows = rows.select(
        "key", "at", "start_sec", F.when(marked, time(1)).otherwise(F.lit(0.0)).alias("a"), F.when(marked, time(3)).otherwise(F.col("duration_sec")).alias("b"),
        stripped(F.regexp_replace("part", f"\\A{TIMESTAMP}", "")).alias("description"), F.when(marked, "anchored").otherwise("unanchored_prefix").alias("quality"),
    )
    return rows.where("description <> '' and b >= a").select("key", (F.col("start_sec") + F.col("a")).alias("start_sec"), (F.col("start_sec") + F.col("b")).alias("end_sec"), "description", "quality")


def atomic_evidence(events: DataFrame, spans: DataFrame) -> DataFrame:
    """Events (key, start_sec, end_sec, description) and caption spans in one line of time, with their number within the key."""
    both = events.select("key", "start_sec", "end_sec", "description", F.lit("observed_event").alias("kind")).unionByName(spans.select("key", "start_sec", "end_sec", "description", F.lit("caption_span").alias("kind")))
    by = Window.partitionBy("key").orderBy("start_sec", "end_sec", "kind", "description")
    return both.where("end_sec >= start_sec").withColumn("number", F.row_number().over(by))


def entity_tracks(updates: DataFrame) -> DataFrame:
    """(key, entity, observation, start_sec, end_sec) of updates (key, entity, base, duration, start_sec, end_sec).

    Intervals count from the base of their segment and are clipped to it; without an interval the whole segment counts.
    Blank entities and intervals that end before they start are left out; observations are numbered in order of time.
    """
    start = F.greatest(F.lit(0.0), F.coalesce("start_sec", F.lit(0.0)))
    end = F.least("duration", F.coalesce("end_sec", "duration"))
    rows = updates.where("entity <> ''").select("key", "entity", (F.col("base") + start).alias("start_sec"), (F.col("base") + end).alias("end_sec")).where("end_sec >= start_sec")
    return rows.withColumn("observation", F.row_number().over(Window.partitionBy("key", "entity").orderBy("start_sec", "end_sec")))


def ranked_candidates(candidates: DataFrame, most: int) -> DataFrame:
    """The ``most`` candidates (task, id, evidence, complexity, span) of each task, each set of evidence once, most complex first, then longest, then by id."""
    order = [F.desc("complexity"), F.desc("span"), F.asc("id")]
    first = candidates.groupBy("task", "evidence").agg(F.min_by(F.struct("id", "complexity", "span"), F.struct(-F.col("complexity"), -F.col("span"), "id")).alias("r")).select("task", "evidence", "r.*")
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("task").orderBy(*order))).where(F.col("rank") <= most)


def complexity(min_hops: Column, units: Column, span: Column) -> Column:
    return F.greatest(min_hops, units - 1) + F.least(F.lit(3.0), F.greatest(F.lit(0.0), span / 60))


def choice_problem(question: Column, choices: Column, answer: Column, evidence: Column, route: Column) -> Column:
    """First reason why a multiple-choice item is invalid, null if it is valid."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")))
    folded = F.transform(choices, fold)
    same = F.size(F.filter(folded, lambda c: c == fold(answer)))
    return (
        F.when(fold(question) == "", "missing_question").when(F.coalesce(F.size(choices), F.lit(-1)) != 4, "choices_not_four").when(F.exists(folded, lambda c: c == ""), "empty_choice")
        .when(same != 1, "answer_not_unique_choice").when(F.coalesce(F.size(evidence), F.lit(0)) <= 0, "missing_evidence").when(fold(route) == "", "missing_route")
    )


def pool_disposition(status: Column, duplicate: Column, reason: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(status), F.lit("")), F.when(F.coalesce(duplicate, F.lit(False)) | (F.coalesce(reason, F.lit("")) != ""), "rejected").otherwise("accepted"))


def frontier_choice(rows: DataFrame, group: list[str]) -> DataFrame:
    """The best row of each group: frontier bucket first, then nearest to two correct, then the longest window, then order."""
    order = F.struct((F.col("bucket") != "frontier").alias("b"), F.abs(F.col("correct") - 2), -F.coalesce("span", F.lit(0.0)), "ordinal")
    return rows.groupBy(*group).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in group]), order).alias("r")).select(*group, "r.*")
