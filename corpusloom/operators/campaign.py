"""Operators of generation campaigns: lint of seeds, routes by evidence, flat ledger rows, draws, subsets, score tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import collapsed

# What counts as a quoted literal, as Chinese text, and as a target that is named by its role alone.
QUOTED = "[\"'“”‘’]([^\"'“”‘’]{1,120})[\"'“”‘’]"
CHINESE = r"[\x{3400}-\x{9FFF}]"
GENERIC_TARGET = r"(?iU)\b(?:specified|requested|indicated|target|new)\s+(?:text|phrase|content|wording|segment)\b|指定(?:文字|文本|短语|内容|字段)|某段文字|另一段"
IMAGE_STEPS = "b_generations c_edits image_gen edit_apply".split()
COUNTS = "item_count request_count success_count failure_count missing_usage_count exact_usage_count".split()


def quoted_literals(text: Column) -> Column:
    """Distinct quoted strings of two characters or more, white space collapsed, in the order of the text."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(QUOTED), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, collapsed), lambda t: F.length(t) >= 2))


def seed_verdict(code: Column, prompt: Column, hint: Column, group: Column) -> Column:
    """Whether an edit can be planned from the texts alone; null texts count as empty."""
    kind = F.upper(F.coalesce(code, F.lit("")))
    unnamed = F.size(quoted_literals(hint)) == 0
    generic = F.coalesce(hint, F.lit("")).rlike(GENERIC_TARGET)
    misspelled = F.lower(F.coalesce(group, F.lit(""))) == "text_misspelled"
    return (
        F.when((kind == "T4") & ~F.coalesce(prompt, F.lit("")).rlike(CHINESE), "target_absent")
        .when(kind.isin("T1", "T3", "T5") & generic & unnamed, "ambiguous_target")
        .when((kind == "T5") & misspelled & unnamed, "ambiguous_target").otherwise("compatible")
    )


def evidence_route(video: Column, captions: Column, entities: Column, observations: Column, events: Column, sourced: Column) -> Column:
    """Route of a record by the evidence that it has: counts of each kind, and whether every part names its source.

    Without a video, or with parts whose source is missing, a record is invalid, not dropped. Entities alone go the way of
    observations alone. Null counts are none.
    """
    some = lambda c: F.coalesce(c, F.lit(0)) > 0
    parts = some(captions) | some(entities) | some(observations) | some(events)
    return (
        F.when(~F.coalesce(video, F.lit(False)) | (parts & ~F.coalesce(sourced, F.lit(False))), "invalid")
        .when(some(captions) & (some(entities) | some(observations)), "caption_entity").when(some(captions) | some(entities) | some(observations), "caption_only")
        .when(some(events), "event_graph").otherwise("video_only")
    )


def ledger_row(pair: Column, codes: Column, steps: Column, models: list[Column], verdict: Column, judgment: Column, first_valid: Column) -> list[Column]:
    """Flat columns of a nested sample: the pair's names, cost, generator, verdict and whether it is a good case.

    pair is a map of strings, steps an array of (step, model), verdict a struct of (aggregate, judgment, environment_valid). The generator is the
    model of the first step that makes images, else the first of the models that is given.
    """
    taxonomy = F.coalesce(F.try_element_at(codes, F.lit(1)), pair["category_hint"])
    scene = pair["scene_id"]
    named = F.when((taxonomy != "") & (scene != ""), F.concat_ws("::", taxonomy, scene))
    makes = F.filter(steps, lambda s: F.coalesce(F.lower(s["step"]).isin(IMAGE_STEPS), F.lit(False)) | F.coalesce(F.lower(s["model"]).contains("image"), F.lit(False)))
    final = F.coalesce(verdict["judgment"], judgment, F.lit("pending"))
    return [
        pair["seed_id"].alias("seed_id"), scene.alias("scene_id"), taxonomy.alias("taxonomy"), F.coalesce(pair["pair_id"], named).alias("pair_id"),
        F.coalesce(pair["category"], pair["category_hint"]).alias("category"), F.coalesce(pair["style"], pair["style_hint"]).alias("style"),
        F.coalesce(F.size(steps), F.lit(0)).alias("api_calls"), F.coalesce(F.try_element_at(makes, F.lit(1))["model"], *models).alias("generator"), verdict["aggregate"].alias("verifier_aggregate"),
        final.alias("judgment"), (final == "good").alias("is_goodcase"), F.coalesce(first_valid, verdict["environment_valid"]).alias("environment_valid"),
    ]


def adopted_images(samples: DataFrame, bank: DataFrame) -> DataFrame:
    """Source image of every sample (id, parent, scene_id, image): that of its parent if it has one, else the bank's for its scene (scene_id, bank_image).

    The origin is parent, bank or miss. Repeated rows of the bank count once; repeated parents must not differ.
    """
    parents = samples.where("image is not null").groupBy(F.col("id").alias("parent")).agg(F.min("image").alias("parent_image"))
    banked = bank.where("bank_image is not null").groupBy("scene_id").agg(F.min("bank_image").alias("bank_image"))
    both = samples.select("id", "parent", "scene_id").join(parents, "parent", "left").join(banked, "scene_id", "left")
    origin = F.when(F.col("parent_image").isNotNull(), "parent").when(F.col("bank_image").isNotNull(), "bank").otherwise("miss")
    return both.select("id", F.coalesce("parent_image", "bank_image").alias("image"), origin.alias("origin"))


def dataset_scores(rows: DataFrame, dataset: str, scores: str) -> DataFrame:
    """Mean of each column of scores in per cent, per dataset; shorter rows repeat their last score.

    scores is an array of booleans; null (timed out) is false. Rows without scores take no part.
    """
    marked = rows.where(F.size(scores) > 0).select(dataset, F.transform(scores, lambda s: F.coalesce(s, F.lit(False)).cast("int")).alias("s"))
    widest = marked.groupBy(F.col(dataset).alias("__dataset")).agg(F.max(F.size("s")).alias("widest"))
    padded = F.concat("s", F.array_repeat(F.element_at("s", -1), F.col("widest") - F.size("s")))
    cells = marked.join(widest, F.col(dataset).eqNullSafe(F.col("__dataset"))).select(dataset, F.posexplode(padded).alias("position", "score"))
    return cells.groupBy(dataset, "position").agg(F.bround(F.avg("score") * 100, 1).alias("accuracy"), F.count("*").alias("n"))


def embedding_usage(batches: DataFrame, model: str) -> DataFrame:
    """Sums over the batches of each model (cache_hit, usage_status, the counts) and how exact they are; null counts are 0."""
    status = (
        F.when(F.bool_and(F.coalesce("cache_hit", F.lit(False))), "cache_only").when(F.count_if(F.col("usage_status") == "unavailable") > 0, "unavailable")
        .when(F.sum(F.coalesce("missing_usage_count", F.lit(0))) > 0, "partial").otherwise("exact")
    )
    return batches.groupBy(model).agg(
        F.count("*").alias("batch_count"), F.count_if("cache_hit").alias("cache_hit_count"), *[F.sum(F.coalesce(c, F.lit(0)).cast("long")).alias(c) for c in COUNTS],
        F.count_if(F.col("usage_status") == "unavailable").alias("unavailable_batch_count"), status.alias("usage_status"),
    )


def numbered(rows: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows with a position from 0 in the order of the hash of seed and key, without sorting them in one task: buckets of the hash are numbered apart."""
    marked = rows.withColumn("__hash", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))).withColumn("__bucket", F.substr("__hash", F.lit(1), F.lit(3)))
    sizes = marked.groupBy("__bucket").agg(F.count("*").alias("n"))  # 4,096 rows at most
    before = sizes.select("__bucket", F.coalesce(F.sum("n").over(Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("__bucket").orderBy("__hash", key))
    return marked.withColumn("inside", inside).join(before, "__bucket").withColumn("position", F.col("before") + F.col("inside") - 1).drop("__hash", "__bucket", "inside", "before")


def drawn(pairs: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n draws with replacement, uniform for a seed and whatever the order of the input; none from an empty table."""
    size = pairs.count()
    spark = pairs.sparkSession
    if not size:
        return spark.range(0).withColumnRenamed("id", "draw").join(pairs, F.lit(False))
    point = F.conv(F.substr(F.md5(F.concat(F.lit(f"{seed}#"), F.col("id").cast("string"))), F.lit(1), F.lit(15)), 16, 10).cast("long")
    draws = spark.range(n).select(F.col("id").alias("draw"), (point % size).alias("position"))
    return draws.join(numbered(pairs, key, seed), "position").drop("position")


def nested_subsets(rows: DataFrame, score: str, key: str, sizes: list[int]) -> DataFrame:
    """Rows of the largest subset by score (ties to the smaller key) with the number of subsets that hold each; rows without a score are in none."""
    top = rows.where(F.col(score).isNotNull()).orderBy(F.desc(score), key).limit(max(sizes))
    rank = F.row_number().over(Window.orderBy(F.desc(score), key))  # over the chosen rows alone
    return top.withColumn("rank", rank).withColumn("level", sum((F.col("rank") <= s).cast("int") for s in sizes))


def prediction_problem(required: list[str], benchmark: str, known: list[str]) -> Column:
    """The first required field that is null, or a benchmark that isn't known; null where the row is sound."""
    missing = [F.when(F.col(c).isNull(), f"missing field {c}") for c in required]
    return F.coalesce(*missing, F.when(~F.col(benchmark).isin(known), F.concat(F.lit("unknown benchmark "), F.col(benchmark))))


def accepted_records(samples: DataFrame, content: str, round_id: str, policy: str) -> DataFrame:
    """Ledger records of accepted samples (sample_id, producer struct and all): the content as JSON, with the lineage of its producer."""
    producer = F.col("producer")
    return samples.select(
        F.lit("high_quality_sample").alias("record_type"), "sample_id", F.to_json(content).alias("content"), F.lit(round_id).alias("rsi_round_id"), F.lit(policy).alias("evaluation_policy_version"),
        *[producer[c].alias(c) for c in ("pipeline", "pipeline_version", "pipeline_fingerprint")],
    )


def append_accepted(records: DataFrame, path: str) -> None:
    """Add the records to the ledger, stamped with the time; earlier rounds are never rewritten."""
    records.withColumn("accepted_at", F.current_timestamp()).write.mode("append").partitionBy("rsi_round_id").parquet(path)
