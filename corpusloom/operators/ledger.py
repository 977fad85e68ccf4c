"""Run ledgers: coverage, entropy, curves, repairs, plans and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def coverage_slices(rows: DataFrame, axes: list[str], good: Column, calls: Column, target: int, tagged: Column | None = None) -> DataFrame:
    """Per slice of the axes: rows, good ones, calls, repeats of failure, and how many rows the slice lacks of the target.

    ``tagged`` tells whether a row has failure tags; failures without any are no repeats.
    """
    named = [F.coalesce(F.col(a).cast("string"), F.lit("∅")).alias(a) for a in axes]
    failed = ~good & (F.lit(False) if tagged is None else F.coalesce(tagged, F.lit(False)))
    flat = rows.select(*named, good.cast("long").alias("g"), calls.alias("c"), failed.cast("long").alias("f"))
    least = lambda x: F.greatest(F.lit(0), x).cast("long")
    return flat.groupBy(*axes).agg(F.count("*").alias("n"), F.sum("g").alias("good"), F.sum("c").alias("calls"), least(F.sum("f") - 1).alias("repeated_failure"), least(F.lit(target) - F.count("*")).alias("gap"))


def ranked_gaps(slices: DataFrame, axes: list[str]) -> DataFrame:
    """Slices by gap, widest first; ties by their axes."""
    return slices.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("gap"), *axes)))  # a row a slice


def failure_tags(rows: DataFrame, axes: list[str], good: Column, tags: Column) -> DataFrame:
    """How often each tag stands at failures of each slice."""
    named = [F.coalesce(F.col(a).cast("string"), F.lit("∅")).alias(a) for a in axes]
    return rows.where(~good).select(*named, F.explode(tags).alias("tag")).groupBy(*axes, "tag").agg(F.count("*").alias("n"))


def rewrite_roots(rows: DataFrame, id_col: str = "id", parent_col: str = "parent") -> DataFrame:
    """(id, root): the first row of each chain of rewrites, by doubling the steps of all chains at once.

    A parent that is no row ends its chain, as its root. A chain that runs into a circle takes the smallest id of it.
    """
    up = rows.select(F.col(id_col).alias("id"), F.coalesce(parent_col, id_col).alias("root"), F.least(F.col(id_col), F.coalesce(parent_col, id_col)).alias("least"))
    ids = rows.select(F.col(id_col).alias("root"))
    ends = rows.where(F.col(parent_col).isNull() | (F.col(parent_col) == F.col(id_col))).select(F.col(id_col).alias("root")).union(rows.select(F.col(parent_col).alias("root")).join(ids, "root", "left_anti")).distinct()
    steps = 1
    while True:
        above = up.select(F.col("id").alias("a"), F.col("root").alias("r"), F.col("least").alias("l"))
        up = up.join(above, up["root"] == above["a"], "left").select("id", F.coalesce("r", "root").alias("root"), F.least("least", F.coalesce("l", "least")).alias("least"))
        up = up.checkpoint() if rows.sparkSession.sparkContext.getCheckpointDir() else up.persist()
        steps *= 2
        open_ = up.join(ends, "root", "left_anti")
        if steps >= open_.count():  # none, or all that is left points into a circle and has gone round it
            break
    named = up.select(F.col("id").alias("root"), F.col("least").alias("first"))
    circles = open_.join(named, "root").select("id", "first")
    return up.join(circles, "id", "left").select("id", F.coalesce("first", "root").alias("root"))


def rewrite_targets(rows: DataFrame, roots: DataFrame, structural: list[str]) -> DataFrame:
    """The latest failure (id, good, tags, at) of each root without a good row; failures without tags or with a structural one don't count."""
    placed = rows.join(roots, "id")
    solved = placed.where("good").select("root").distinct()
    open_ = placed.where(~F.col("good") & (F.size("tags") > 0) & ~F.arrays_overlap("tags", F.array(*map(F.lit, structural)))).join(solved, "root", "left_anti")
    return open_.groupBy("root").agg(F.max_by(F.struct("id", "at"), F.struct("at", -F.col("id"))).alias("r")).select("root", "r.*")


def axis_entropy(rows: DataFrame, axis: str) -> DataFrame:
    """Shannon entropy of an axis over the logarithm of its classes; 0 for at most one class, nulls ignored."""
    counts = rows.where(F.col(axis).isNotNull()).groupBy(axis).agg(F.count("*").alias("n"))
    sums = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("nl"), F.count("*").alias("k"))
    h = F.ln("t") - F.col("nl") / F.col("t")
    return sums.select(F.lit(axis).alias("axis"), F.col("k").alias("classes"), F.round(F.when(F.col("k") > 1, h / F.ln("k")).otherwise(0.0), 6).alias("entropy"))


def ledger_summary(rows: DataFrame) -> DataFrame:
    """Good count, calls, good per call, distinct pairs, episodes per pair, and the upper median of rows per pair (pair, good, calls)."""
    per = rows.groupBy("pair").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("g"), F.sum("calls").alias("c"))
    # n // 2-th of the sorted counts: exact from the counts of counts, so no array of all pairs is made
    line = per.groupBy("n").agg(F.count("*").alias("m"))
    below = F.sum("m").over(Window.orderBy("n"))  # a row for each different count
    ranked = line.select("n", below.alias("upto"), F.sum("m").over(Window.partitionBy()).alias("all"))
    median = ranked.where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("n").alias("redundancy"))
    total = per.agg(F.sum("g").alias("good"), F.sum("c").alias("calls"), F.count("*").alias("pairs"), F.sum("n").alias("episodes"))
    ratio = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)), 6)
    return total.join(F.broadcast(median)).select("good", "calls", ratio("good", "calls").alias("good_per_call"), "pairs", ratio("episodes", "pairs").alias("episodes_per_pair"), "redundancy")


def time_to_nth_good(rows: DataFrame, n: int) -> DataFrame:
    """Per run (run, at, id, good, calls): calls spent when the n-th good row came; runs that never got there are left out."""
    by = Window.partitionBy("run").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    line = rows.select("run", "at", "id", F.sum(F.col("good").cast("long")).over(by).alias("g"), F.sum("calls").over(by).alias("c"))
    return line.where(F.col("g") == n).groupBy("run").agg(F.min("c").alias("calls"))


def campaign_curve(rows: DataFrame) -> DataFrame:
    """Rows, good ones and calls per batch and cumulated."""
    per = rows.groupBy("batch").agg(F.count("*").alias("n"), F.sum(F.col("good").cast("long")).alias("good"), F.sum("calls").alias("calls"))
    by = Window.orderBy("batch").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # a row a batch
    return per.select("batch", "n", "good", "calls", F.sum("good").over(by).alias("good_so_far"), F.sum("calls").over(by).alias("calls_so_far"))


def repair_rate(rows: DataFrame) -> DataFrame:
    """Share of rewrites (id, parent, good) of failed parents that are good; parents that are missing or good do not count."""
    child, parent = rows.where("parent is not null").alias("c"), rows.alias("p")
    joined = child.join(parent, F.col("c.parent") == F.col("p.id")).where("not p.good")
    n, good = F.count("*"), F.sum(F.col("c.good").cast("long"))
    return joined.agg(n.alias("rewrites"), F.coalesce(good, F.lit(0)).alias("repaired"), F.round(F.when(n > 0, good / n), 6).alias("rate"))


def unattempted(pairs: DataFrame, attempts: DataFrame, key: list[str], n: int | None = None) -> DataFrame:
    """The pairs without an attempt; the first ``n`` by key if so many only are asked for."""
    left = pairs.join(attempts.select(*key).distinct(), key, "left_anti")
    return left if n is None else left.orderBy(*key).limit(n)


def stratified_schedule(pairs: DataFrame, seed: int) -> DataFrame:
    """Each pair (edit, category, pair) once: round-robin over edits, categories in turn within an edit."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("pair").cast("string")))
    within = F.row_number().over(Window.partitionBy("edit", "category").orderBy(key, "pair"))
    rows = pairs.withColumn("turn", within)
    return rows.select("edit", "category", "pair", F.row_number().over(Window.partitionBy("edit").orderBy("turn", "category", "pair")).alias("round"))


def stratified_cases(cases: DataFrame, k: int, seed: int) -> DataFrame:
    """k bad cases (case_id, category, priority): one per category by priority, then filled by priority; order by hash."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("case_id").cast("string")))
    ranked = cases.withColumn("h", key).withColumn("rank", F.row_number().over(Window.partitionBy("category").orderBy("h", "case_id"))).where(F.col("rank") <= k)
    return ranked.orderBy(F.col("rank") > 1, "priority", "rank", "category").limit(k).select("case_id", "category", "priority")


def threshold_filter(rows: DataFrame, score: str, least: float) -> DataFrame:
    """Rows that reach the score; rows without one stay."""
    return rows.where(F.col(score).isNull() | (F.col(score) >= least))


def rubric_decision(axes: dict[str, tuple[float, float]], average_least: float, environment: Column, scores: Column) -> Column:
    """struct(good, average, failures). ``axes``: minimum and weight of each; ``scores``: a map of what was given.

    Unless the environment is true nothing else counts. Missing axes and those below their minimum are failures; the
    weighted average over the axes at hand is looked at only if there are none.
    """
    checks = [F.when(scores[a].isNull(), f"missing_axis:{a}").when(scores[a] < least, f"below_minimum:{a}") for a, (least, _) in axes.items()]
    of_axes = F.filter(F.array(*checks), lambda x: x.isNotNull())
    total = sum((F.when(scores[a].isNotNull(), F.lit(float(w))).otherwise(0.0) for a, (_, w) in axes.items()), F.lit(0.0))
    average = sum((F.coalesce(scores[a], F.lit(0.0)) * float(w) for a, (_, w) in axes.items()), F.lit(0.0)) / F.nullif(total, F.lit(0.0))
    none = F.array().cast("array<string>")
    failures = F.when(F.size(of_axes) > 0, of_axes).when(average < average_least, F.array(F.lit("below_minimum_average"))).otherwise(none)
    valid = F.coalesce(environment, F.lit(False))
    failures = F.when(valid, failures).otherwise(F.array(F.lit("environment_invalid")))
    return F.struct((valid & (F.size(failures) == 0) & (total > 0)).alias("good"), F.when(valid, average).alias("average"), failures.alias("failures"))


def incumbents(rounds: DataFrame, group: list[str], strict: bool = True) -> DataFrame:
    """Per round (step, passed, score) the best so far by (passed, score); with ``strict`` the earlier one wins ties."""
    by = Window.partitionBy(*group).orderBy("step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    order = -F.col("step") if strict else F.col("step")
    best = F.max(F.struct("passed", "score", order.alias("o"))).over(by)
    at = F.when(F.lit(strict), -best["o"]).otherwise(best["o"])
    return rounds.select(*group, "step", at.alias("incumbent"), best["score"].alias("incumbent_score"))


def usage_rollup(events: DataFrame, model: str, tokens: Column, ok: Column) -> DataFrame:
    """Calls, successes, tokens and calls without usage, by model and over all."""
    flat = events.select(F.col(model).alias("model"), tokens.alias("t"), ok.cast("long").alias("ok"))
    out = flat.rollup("model").agg(F.count("*").alias("calls"), F.sum("ok").alias("successes"), F.sum("t").alias("tokens"), F.sum(F.col("t").isNull().cast("long")).alias("missing"))
    return out.withColumn("model", F.coalesce("model", F.lit("all")))


def batch_digests(cards: DataFrame, folded: DataFrame | None = None) -> DataFrame:
    """(batch, samples, api_calls, settled, accepted, gate_rejects, axis_failures) of cards (batch, calls, settled, good, valid, outcomes).

    Batches that ``folded`` has already are left out, so folding one again changes nothing. Only settled cards are judged;
    axis_failures maps the axes of their outcomes to how often each is named.
    """
    fresh = cards if folded is None else cards.join(folded.select("batch").distinct(), "batch", "left_anti")
    done = F.coalesce("settled", F.lit(False))
    yes = lambda c: F.count_if(done & F.coalesce(F.col(c), F.lit(False)))
    sums = fresh.groupBy("batch").agg(F.count("*").alias("samples"), F.coalesce(F.sum("calls"), F.lit(0)).alias("api_calls"), F.count_if(done).alias("settled"), yes("good").alias("accepted"), F.count_if(done & ~F.coalesce("valid", F.lit(True))).alias("gate_rejects"))
    axes = fresh.where(done).select("batch", F.explode("outcomes").alias("axis")).groupBy("batch", "axis").agg(F.count("*").alias("n"))
    named = axes.groupBy("batch").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("axis", "n")))).alias("axis_failures"))  # a handful of axes
    return sums.join(named, "batch", "left").withColumn("axis_failures", F.coalesce("axis_failures", F.create_map().cast("map<string,bigint>")))


def failure_table(cards: DataFrame, examples: int = 3) -> DataFrame:
    """(axis, failures, batches, mean_score_when_failing, examples) of settled cards (batch, id, score, settled, outcomes).

    Examples are the first cards by batch and id, and in the last place the newest.
    """
    hits = cards.where(F.coalesce("settled", F.lit(False))).select("batch", "id", "score", F.explode("outcomes").alias("axis"))
    first = F.row_number().over(Window.partitionBy("axis").orderBy("batch", "id"))
    last = F.row_number().over(Window.partitionBy("axis").orderBy(F.desc("batch"), F.desc("id")))
    shown = hits.withColumn("k", first).withColumn("z", last).where((F.col("k") < examples) | (F.col("z") == 1))
    named = shown.groupBy("axis").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "id"))), lambda x: x["id"]).alias("examples"))
    sums = hits.groupBy("axis").agg(F.count("*").alias("failures"), F.count_distinct("batch").alias("batches"), F.bround(F.avg("score"), 2).alias("mean_score_when_failing"))
    return sums.join(named, "axis").select("axis", "failures", "batches", "mean_score_when_failing", "examples")


def newest_states(cards: DataFrame, most: int = 200) -> DataFrame:
    """(batch, id, state) of the last ``most`` cards (batch, id, state) that name a state, by batch and id."""
    rows = cards.where(F.trim("state") != "").select("batch", "id", F.trim("state").alias("state"))
    return rows.orderBy(F.desc("batch"), F.desc("id")).limit(most)
