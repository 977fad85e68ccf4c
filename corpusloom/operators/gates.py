"""Gates: first reason against a record, predicates of audits, and checks of results. A null reason means that it passes."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from corpusloom.functions.text import collapsed, content_tokens

# Labels that count as good, and those that say an audit did not happen.
READY = "high medium training_ready ready".split()
GROUNDED = "grounded verified visible".split()
LOW_SHORTCUT = "low none minimal".split()
STRONG = "strong good valid discriminative".split()
UNAVAILABLE = ["", "unknown", "unavailable", "not_assessed"]
GENERIC = ["none of the above", "all of the above", "cannot determine", "not enough information"]
CROSS_OBSERVATION = "state_change temporal_relation cross_event_comparison entity_tracking".split()


def folded(text: Column) -> Column:
    return F.lower(collapsed(F.coalesce(text.cast("string"), F.lit(""))))


def training_ready(value: Column, grounding: Column, shortcut: Column, distractor: Column) -> Column:
    """Whether all four labels are good; without any label there is nothing against the record."""
    labels = [folded(c) for c in (value, grounding, shortcut, distractor)]
    unlabelled = F.concat(*labels) == ""
    return unlabelled | (labels[0].isin(READY) & labels[1].isin(GROUNDED) & labels[2].isin(LOW_SHORTCUT) & labels[3].isin(STRONG))


def complete_audit(*labels: Column) -> Column:
    done = F.lit(True)
    for c in labels:
        done = done & ~folded(c).isin(UNAVAILABLE)
    return done


def complexity_problem(task: Column, units: Column, hops: Column, least_units: Column, least_hops: Column, fallback: Column) -> Column:
    """Too few units of evidence, too few hops, or one observation where the task relates several and no fallback is marked. Null counts are 0."""
    units, hops = F.coalesce(units, F.lit(0)), F.coalesce(hops, F.lit(0))
    return (
        F.when(units < F.coalesce(least_units, F.lit(1)), "insufficient_evidence_units").when(hops < F.coalesce(least_hops, F.lit(1)), "insufficient_reasoning_hops")
        .when(task.isin(CROSS_OBSERVATION) & (units < 2) & ~F.coalesce(fallback, F.lit(False)), "cross_observation_required")
    )


def handoff_problem(question: Column, answer: Column, cited: Column, allowed: Column, choices: Column) -> Column:
    """Why a generated sample is not handed on: blank parts or choices, citations beyond its evidence (none cited: all of it), or choices without exactly one answer."""
    strings = F.array().cast("array<string>")
    cited = F.filter(F.coalesce(cited, strings), lambda c: F.coalesce(c, F.lit("")) != "")
    used = F.when(F.size(cited) > 0, cited).otherwise(F.coalesce(allowed, strings))
    same = F.size(F.filter(choices, lambda c: folded(c) == folded(answer)))
    return (
        F.when(folded(question) == "", "missing_question").when(folded(answer) == "", "missing_answer").when(F.size(used) == 0, "missing_citations")
        .when(F.size(F.array_except(used, F.coalesce(allowed, strings))) > 0, "unknown_citations").when(F.coalesce(F.size(choices), F.lit(-1)) != 4, "choices_not_four")
        .when(F.exists(choices, lambda c: folded(c) == ""), "blank_choice").when(same != 1, "answer_not_unique_choice")
    )


@F.pandas_udf(DoubleType())
def alike(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of matching characters by longest common blocks, which no built-in function gives."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def distractor_problem(question: Column, choices: Column, answer: Column) -> Column:
    """Why the choices of an item are malformed or give the answer away."""
    words = lambda c: F.size(content_tokens(c))  # noqa: E731  different ones
    named = F.transform(choices, folded)
    sizes = F.array_sort(F.transform(named, words))
    median = F.element_at(sizes, F.floor(F.size(sizes) / 2).cast("int") + 1)
    short = F.greatest(F.lit(1), F.floor(median * 0.35))
    long = words(folded(answer)) >= 4  # short answers are not compared, which takes Python
    leaked = alike(F.when(long, folded(answer)), F.when(long, folded(question))) >= 0.78
    return (
        F.when((F.coalesce(F.size(choices), F.lit(-1)) != 4) | F.exists(named, lambda c: c == ""), "must_have_exactly_four_nonempty_choices").when(F.size(F.array_distinct(named)) != 4, "duplicate_choices")
        .when((folded(answer) == "") | ~F.array_contains(named, folded(answer)), "answer_must_match_one_choice")
        .when(leaked, "answer_leaked_in_question")
        .when(F.arrays_overlap(named, F.array(*map(F.lit, GENERIC))), "generic_meta_distractor").when((median > 0) & F.exists(sizes, lambda n: n < short), "option_length_outlier")
    )


def gated(rows: DataFrame, reason: Column) -> tuple[DataFrame, DataFrame]:
    """(rows without a reason, counts): the counts have input, accepted and rejected_<reason> in name and n."""
    judged = rows.withColumn("reason", reason)
    names = F.array(F.lit("input"), F.when(F.col("reason").isNull(), "accepted").otherwise(F.concat(F.lit("rejected_"), "reason")))
    return judged.where("reason is null").drop("reason"), judged.select(F.explode(names).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


def environment_gate(rows: DataFrame, valid: Column, tags: str, tag: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a true environment, freed of the tag; the others, tagged)."""
    ok = F.coalesce(valid, F.lit(False))
    own = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    return rows.where(ok).withColumn(tags, F.array_except(own, F.array(F.lit(tag)))), rows.where(~ok).withColumn(tags, F.array_union(own, F.array(F.lit(tag))))


def narrowed(pairs: DataFrame, wanted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(pairs that are wanted, wanted keys that no pair has); an empty result is an error."""
    kept = pairs.join(wanted.select(key), key, "left_semi")
    if kept.isEmpty():
        raise ValueError(f"no pair has a wanted {key}")
    return kept, wanted.select(key).distinct().join(pairs.select(key), key, "left_anti")


def event_problems(events: DataFrame, evidence: DataFrame, slack: float = 0.75, most: int = 8) -> DataFrame:
    """Events (key, id, start, end, cited, entities, low, high) with a reason against each, null for none.

    An event must lie within its bounds low and high and not run back before the one ahead of it by id, both but for ``slack``
    seconds; cite evidence (key, id, start, end, entities) of its key that exists, within whose times it lies; and name
    none but its entities. A key has ``most`` events at most.
    """
    asked = events.select("key", F.col("id").alias("event"), F.explode("cited").alias("id")).distinct()
    known = evidence.select("key", "id", F.col("start").alias("s"), F.col("end").alias("e"), F.col("entities").alias("those"))
    held = asked.join(known, ["key", "id"], "left").groupBy("key", F.col("event").alias("id")).agg(F.count("*").alias("asked"), F.count("s").alias("found"), F.min("s").alias("s"), F.max("e").alias("e"), F.array_distinct(F.flatten(F.collect_list("those"))).alias("those"))
    rows = events.join(held, ["key", "id"], "left").withColumn("before", F.lag("end").over(Window.partitionBy("key").orderBy("id"))).withColumn("count", F.count("*").over(Window.partitionBy("key")))
    reason = (
        F.when(F.col("count") > most, "too_many_events").when((F.col("start") < F.col("low") - slack) | (F.col("end") > F.col("high") + slack) | (F.col("end") < F.col("start")), "outside_proposal")
        .when(F.col("start") < F.col("before") - slack, "not_chronological").when(F.coalesce(F.col("asked") != F.col("found"), F.lit(True)), "unknown_evidence")
        .when((F.col("start") < F.col("s") - slack) | (F.col("end") > F.col("e") + slack), "outside_evidence").when(F.size(F.array_except("entities", "those")) > 0, "unknown_entities")
    )
    return rows.select("key", "id", reason.alias("reason"))


def result_problem(score: Column, correct: Column, total: Column, incorrect: Column, categories: Column, questions: Column, samples: Column) -> Column:
    """Why a benchmark result does not add up. ``categories``: the sum of the counts of failures by kind."""
    finite = score.isNotNull() & ~F.isnan(score) & (F.abs(score) != float("inf"))
    return (
        F.when(~finite, "score_not_finite").when(categories != incorrect, "categories_do_not_sum").when((total <= 0) | (F.abs(score - correct / total) > 1e-9), "score_is_not_the_ratio")
        .when(~total.isin(questions) & (total != questions * samples), "total_does_not_match")
    )


def route(task: Column, routes: dict[str, str], default: str) -> Column:
    named = F.create_map(*[F.lit(x) for kv in routes.items() for x in kv])
    return F.coalesce(named[task], F.lit(default))
