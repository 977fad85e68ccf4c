"""Summaries of runs: histograms, skew, criteria, merged counters, usage and overhead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.gates import folded


def distribution(rows: DataFrame, label: Column, expected: list[str] | None = None) -> DataFrame:
    """One row: total, coverage (labels that occur, of the expected ones if given) and the largest share; null labels don't count."""
    counts = rows.select(label.alias("label")).where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    seen = F.lit(True) if expected is None else F.col("label").isin(expected)
    out = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), F.coalesce(F.sum(seen.cast("long")), F.lit(0)).alias("coverage"), F.max("n").alias("top"))
    return out.select("total", "coverage", F.round(F.coalesce(F.col("top") / F.col("total"), F.lit(0.0)), 6).alias("largest_share"))


def answer_position(choices: Column, answer: Column) -> Column:
    """A to D of the one choice of four that is the answer, else null."""
    named = F.transform(choices, folded)
    one = (F.size(choices) == 4) & (F.size(F.filter(named, lambda c: c == folded(answer))) == 1)
    return F.when(one, F.substr(F.lit("ABCD"), F.array_position(named, folded(answer)).cast("int"), F.lit(1)))


def position_skew(rows: DataFrame, position: Column) -> DataFrame:
    """The distribution of answer positions, and whether it is severely skewed: 8 answers or more, over 0.45 of them in one place."""
    return distribution(rows, position, list("ABCD")).withColumn("severe_skew", (F.col("total") >= 8) & (F.col("largest_share") > 0.45))


def repeated_sources(rows: DataFrame, source: Column) -> DataFrame:
    """How many sources there are, how many repeat, rows beyond the first of each, and the most of one."""
    per = rows.select(source.alias("s")).where("s is not null and s <> ''").groupBy("s").agg(F.count("*").alias("n"))
    none = lambda c: F.coalesce(c, F.lit(0))
    return per.agg(F.count("*").alias("identified"), none(F.sum((F.col("n") > 1).cast("long"))).alias("repeated"), none(F.sum(F.col("n") - 1)).alias("correlated"), none(F.max("n")).alias("most"))


def route_metrics(rows: DataFrame, route: Column, invalid: Column, disposition: Column) -> DataFrame:
    """Per route: rows, those without a reason against them, and of these the accepted and the reserved ones."""
    count = lambda c: F.sum(F.coalesce(c, F.lit(False)).cast("long"))
    flat = rows.select(F.coalesce(F.nullif(route, F.lit("")), F.lit("unrouted")).alias("route"), invalid.isNull().alias("ok"), disposition.alias("d"))
    return flat.groupBy("route").agg(F.count("*").alias("total"), count(F.col("ok")).alias("hard_valid"), count(F.col("ok") & (F.col("d") == "accepted")).alias("accepted"), count(F.col("ok") & F.col("d").isin("reserve", "replayable")).alias("reserve"))


def promotion(frontier: DataFrame, total: int, complete: Column, ready: Column, claimed: Column) -> DataFrame:
    """Rows that count for promotion and their share of ``total``: ready and audited ones if any is audited, none if quality is only claimed, else all."""
    count = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(False)).cast("long")), F.lit(0))
    sums = frontier.agg(F.count("*").alias("n"), count(complete).alias("audited"), count(ready & complete).alias("ready"), count(claimed).alias("claims"))
    promoted = F.when(F.col("audited") > 0, F.col("ready")).when(F.col("claims") > 0, F.lit(0)).otherwise(F.col("n"))
    return sums.select("n", "audited", "ready", promoted.alias("promoted"), F.round(promoted / max(1, total), 6).alias("score"))


def criteria_rates(marks: DataFrame, criteria: int, least: float = 0.6) -> DataFrame:
    """Per record (record, criterion, met, critical): the share of criteria met, and whether it passes.

    Each of the ``criteria`` must be marked exactly once; records where that is not so have complete = false and don't pass.
    """
    per = marks.groupBy("record").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("criterion").between(0, criteria - 1), F.col("criterion"))).alias("k"), F.sum(F.col("met").cast("long")).alias("met"), F.max(F.coalesce("critical", F.lit(False))).alias("critical"))
    complete = (F.col("n") == criteria) & (F.col("k") == criteria)
    rate = F.round(F.col("met") / criteria, 6)
    return per.select("record", complete.alias("complete"), rate.alias("rate"), (complete & (rate >= least) & ~F.col("critical")).alias("passed"))


def merged_counts(rows: DataFrame, counts: str) -> DataFrame:
    """Sums of the values of a map column by key."""
    return rows.select(F.explode(counts).alias("name", "n")).groupBy("name").agg(F.sum("n").alias("n"))


def merged_usage(parts: DataFrame) -> DataFrame:
    """Sums of usage by namespace and name (namespace, name, calls, tokens); there is no total over namespaces, as their units differ."""
    return parts.groupBy("namespace", "name").agg(F.sum(F.coalesce("calls", F.lit(0))).alias("calls"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


def overhead(rows: DataFrame, figures: list[str]) -> DataFrame:
    """Totals of the figures, nulls as 0."""
    return rows.agg(*[F.coalesce(F.sum(F.coalesce(F.col(c), F.lit(0))), F.lit(0)).alias(c) for c in figures])


def run_evaluation(rows: DataFrame, accepted: Column, difficulty: Column, gates: dict[str, Column]) -> DataFrame:
    """One row: accepted records, share of easy ones among them, and whether every gate holds for all accepted ones."""
    good = F.coalesce(accepted, F.lit(False))
    holds = [F.coalesce(F.min(F.when(good, F.coalesce(g, F.lit(False)))), F.lit(True)).alias(name) for name, g in gates.items()]
    return rows.agg(F.sum(good.cast("long")).alias("accepted"), F.round(F.avg(F.when(good, (difficulty == "easy").cast("double"))), 6).alias("too_easy_rate"), *holds)


def is_better(challenger: DataFrame, incumbent: DataFrame, gates: list[str]) -> bool:
    """Whether a run's evaluation passes all gates and accepts more than the incumbent's."""
    new, old = challenger.first(), incumbent.first()
    return all(new[g] for g in gates) and new["accepted"] > old["accepted"]


def merged_shards(shards: DataFrame, rank: str, place: str) -> DataFrame:
    """Rows of all shards in order of rank, then place."""
    return shards.orderBy(rank, place)


def rolled_back(accuracy_change: float, format_change: float, *, accuracy_least: float = -0.03, format_least: float = -0.05) -> bool:
    """Whether a phase is undone: accuracy or format rate fell by more than it may."""
    return accuracy_change < accuracy_least or format_change < format_least
