"""Whole-table quality figures: duplicates, empty slots, lengths, value profiles, step funnels, samples."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def empty_slot(column: Column) -> Column:
    """Null or blank."""
    return column.isNull() | (F.trim(column.cast("string")) == "")


def hard_metrics(rows: DataFrame, required: list[str]) -> DataFrame:
    """Rows, share of records that repeat another, and share of required slots that are empty; 0 for an empty table."""
    canonical = F.md5(F.to_json(F.struct(*[F.col(c) for c in sorted(rows.columns)]), {"ignoreNullFields": "false"}))
    empty = reduce(lambda a, b: a + b, [empty_slot(F.col(c)).cast("long") for c in required])
    n = F.count("*")
    share = lambda x: F.round(F.when(n > 0, x).otherwise(0.0), 6)
    return rows.select(canonical.alias("k"), empty.alias("e")).agg(n.alias("n_rows"), share(1 - F.count_distinct("k") / n).alias("record_duplicate_rate"), share(F.sum("e") / (n * len(required))).alias("null_slot_rate"))


def content_duplicate_rates(rows: DataFrame, fields: list[str], least_median: float = 40) -> DataFrame:
    """Per field with a median length of ``least_median`` or more, the share of values that repeat another."""
    n = F.count("*")
    figures = [F.struct(F.lit(c).alias("field"), F.percentile(F.length(F.col(c).cast("string")), F.lit(0.5)).alias("median_length"), F.round(1 - F.count_distinct(F.md5(F.coalesce(F.col(c).cast("string"), F.lit("")))) / n, 6).alias("duplicate_rate")) for c in fields]
    return rows.agg(F.array(*figures).alias("f")).select(F.explode("f").alias("x")).select("x.*").where(F.col("median_length") >= least_median)


def value_profile(rows: DataFrame, fields: list[str], most: int = 20) -> DataFrame:
    """Counts of the values of every field that has at most ``most`` different ones."""
    pairs = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields])).alias("x")).select("x.*")
    counts = pairs.where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("field").agg(F.count("*").alias("kinds")).where(F.col("kinds") <= most)
    return counts.join(F.broadcast(few), "field").select("field", "value", "n")  # a row a field


def funnel(steps: DataFrame) -> DataFrame:
    """Retention between steps (step, name, n_rows): share of the rows of the step before, and a warning under a half."""
    before = F.lag("n_rows").over(Window.orderBy("step"))  # one row a step
    kept = F.round(F.when(before > 0, F.col("n_rows") / before), 6)
    return steps.withColumn("retention", kept).withColumn("warning", F.when(F.col("n_rows") == 0, "empty").when(kept < 0.5, "low_retention"))


def token_lengths(rows: DataFrame, text_col: str, cutoff: int) -> DataFrame:
    """Percentiles of white-space token counts, rows beyond the cutoff, and the share of tokens within it."""
    size = F.size(F.filter(F.split(F.coalesce(F.col(text_col), F.lit("")), r"\s+"), lambda t: t != ""))
    figures = [F.percentile("n", F.lit(p / 100)).alias(f"p{p}") for p in (50, 90, 95, 99)]
    kept = F.round(F.sum(F.least("n", F.lit(cutoff))) / F.sum("n"), 6)
    return rows.select(size.alias("n")).agg(F.min("n").alias("shortest"), *figures, F.max("n").alias("longest"), F.sum((F.col("n") > cutoff).cast("long")).alias("over_cutoff"), kept.alias("retained"))


def seeded_sample(rows: DataFrame, id_col: str, k: int, seed: int) -> DataFrame:
    """k rows, uniform for a seed and whatever the order of the input: those with the smallest hash of seed and id."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return rows.orderBy(key, id_col).limit(k)


def first_of_each(rows: DataFrame, key: Column, order: list) -> DataFrame:
    """The first row of each key; a partial aggregate, so a hot key is not gathered."""
    place = F.struct(*[F.col(c) for c in order])
    whole = F.struct(*rows.columns)
    return rows.groupBy(key.alias("__key")).agg(F.min_by(whole, place).alias("r")).select("r.*")


def top_per_group(rows: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group with their rank."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def shard_ranges(rows: DataFrame, order: list[str], shards: int) -> DataFrame:
    """Contiguous shards: shard r of k holds positions n*r//k up to n*(r+1)//k."""
    n = rows.count()
    ranges = [(r, n * r // shards, n * (r + 1) // shards) for r in range(shards)]
    return rows.sparkSession.createDataFrame(ranges, "shard int, start long, stop long")
