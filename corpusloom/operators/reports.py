"""Reports over whole files of records: quality of JSON lines, texts of records, exports, ledgers, failed rows, steps, results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import ngrams, tokens

# The least median length of a field that counts as content, and lengths of messages and lists.
CONTENT_LENGTH, MESSAGE_CHARS, EXAMPLES, TOP_TAGS = 40, 1000, 3, 5


def _field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f'$["{name}"]', "variant")


def _as_text(value: Column) -> Column:
    return F.coalesce(F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string")).when(~F.is_variant_null(value), F.to_json(value)), F.lit(""))


def _is_empty(value: Column) -> Column:
    return value.isNull() | F.is_variant_null(value) | (F.trim(_as_text(value)) == "") | F.to_json(value).isin("[]", "{}")


def file_metrics(lines: DataFrame, required: list[str], content: list[str] | None = None) -> DataFrame:
    """One row over JSON lines (value): total, parse_valid_rate, null_rate, record_dup_rate, field_dup_rate, dup_field, dup_rate.

    Blank lines don't count. A record is the same as another with its keys in any order; lines that are no object compare as
    they are. null_rate is over the required fields; the content fields (the required ones, if none are given) are those of
    a median length of CONTENT_LENGTH or more, and the worst of them stands for all. dup_rate is the larger of both.
    """
    content = required if content is None else content
    rows = lines.where(F.trim("value") != "").select(F.trim("value").alias("value"), F.try_parse_json("value").alias("v"))
    valid = F.coalesce(F.schema_of_variant("v").startswith("OBJECT"), F.lit(False))
    rows = rows.select(valid.alias("valid"), F.md5(F.when(valid, F.to_json("v")).otherwise(F.col("value"))).alias("record"), F.when(valid, F.col("v")).alias("v"))
    empty = sum((_is_empty(_field(F.col("v"), f)).cast("int") for f in required), F.lit(0))
    texts = [F.when(F.col("valid"), _as_text(_field(F.col("v"), f))).alias(f"f{k}") for k, f in enumerate(content)]
    rows = rows.select("valid", "record", F.when(F.col("valid"), empty).alias("empty"), *texts)
    each = [x for k in range(len(content)) for x in (F.count_distinct(F.md5(f"f{k}")).alias(f"n{k}"), F.percentile(F.length(f"f{k}"), F.lit(0.5)).alias(f"m{k}"))]
    sums = rows.agg(F.count("*").alias("total"), F.count(F.when(F.col("valid"), 1)).alias("parsed"), F.coalesce(F.sum("empty"), F.lit(0)).alias("empty"), F.count_distinct("record").alias("records"), *each)
    dup = lambda k: F.when((F.col("parsed") > 0) & (F.col(f"m{k}") >= CONTENT_LENGTH), 1 - F.col(f"n{k}") / F.col("parsed"))
    worst = F.struct(F.lit(0.0).alias("rate"), F.lit(0).alias("k"), F.lit("").alias("field"))
    for k, name in enumerate(content):
        rate = F.coalesce(dup(k), F.lit(0.0))
        worst = F.when(rate > worst["rate"], F.struct(rate.alias("rate"), F.lit(k).alias("k"), F.lit(name).alias("field"))).otherwise(worst)
    share = lambda part, whole: F.round(F.when(whole > 0, part / whole).otherwise(0.0), 6)
    record = F.when(F.col("total") > 0, 1 - F.col("records") / F.col("total")).otherwise(0.0)
    out = sums.withColumn("w", worst)
    return out.select(
        "total", share(F.col("parsed"), F.col("total")).alias("parse_valid_rate"), share(F.col("empty"), F.col("parsed") * len(required)).alias("null_rate"), F.round(record, 6).alias("record_dup_rate"),
        F.round("w.rate", 6).alias("field_dup_rate"), F.col("w.field").alias("dup_field"), F.round(F.greatest(record, F.col("w.rate")), 6).alias("dup_rate"),
    )


def record_text(value: Column) -> Column:
    """All strings of a JSON text but its keys, however deep, joined by spaces in their order; empty ones are left out."""
    found = F.regexp_extract_all(value, F.lit(r'("(?:[^"\\]|\\.)*+"\s*:?)'), F.lit(1))
    quoted = F.filter(found, lambda s: ~s.endswith(":"))
    texts = F.from_json(F.concat(F.lit("["), F.array_join(quoted, ","), F.lit("]")), "array<string>")
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def first_examples(rows: DataFrame, flags: DataFrame, index: DataFrame, id_col: str, text_col: str = "text", n: int = 13, most: int = EXAMPLES) -> DataFrame:
    """(id, example) of the first ``most`` hits by id: the first gram in the text that the index (gram) has. flags: (id, hit)."""
    first = flags.where("hit").select("id").orderBy("id").limit(most)
    texts = rows.join(first, rows[id_col] == first["id"], "left_semi").select(F.col(id_col).alias("id"), F.posexplode(ngrams(tokens(F.col(text_col)), n)).alias("at", "gram"))
    return texts.join(index, "gram", "left_semi").groupBy("id").agg(F.min_by("gram", "at").alias("example"))


def instruction_export(rows: DataFrame, user: str, assistant: str) -> tuple[DataFrame, DataFrame]:
    """((instruction, input, output), (rows, skipped_blank_rows)) of records; those with a blank side are skipped and counted."""
    kept = F.coalesce((F.trim(user) != "") & (F.trim(assistant) != ""), F.lit(False))
    pairs = rows.where(kept).select(F.col(user).alias("instruction"), F.lit("").alias("input"), F.col(assistant).alias("output"))
    return pairs, rows.agg(F.count(F.when(kept, 1)).alias("rows"), F.count(F.when(~kept, 1)).alias("skipped_blank_rows"))


def write_export(pairs: DataFrame, folder: str) -> None:
    """Write an export as JSON lines; an empty one is refused and leaves nothing."""
    if pairs.isEmpty():
        raise ValueError("the export has no rows")
    pairs.write.json(folder)


def ledger_totals(rows: DataFrame) -> DataFrame:
    """One row of a ledger (pair, good, calls, tokens, tags): samples, goodcase, api_calls, tokens, goodcase_per_call, unique_pairs, most, mean, top_failure_tags.

    Rows without a pair count in all but the figures by pair. The top tags are (tag, n), most frequent first, then by name.
    """
    total = rows.agg(F.count("*").alias("samples"), F.coalesce(F.sum(F.col("good").cast("long")), F.lit(0)).alias("goodcase"), F.coalesce(F.sum("calls"), F.lit(0)).alias("api_calls"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"))
    pairs = rows.where("pair is not null").groupBy("pair").agg(F.count("*").alias("n")).agg(F.count("*").alias("unique_pairs"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.round(F.avg("n"), 6).alias("mean"))
    tags = rows.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(TOP_TAGS)
    top = tags.agg(F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("k"), "tag"))).alias("t")).select(F.transform("t", lambda x: F.struct(x["tag"].alias("tag"), (-x["k"]).alias("n"))).alias("top_failure_tags"))
    rate = F.round(F.when(F.col("api_calls") > 0, F.col("goodcase") / F.col("api_calls")), 6)
    one = lambda df, name: df.select(name).scalar()  # noqa: E731  each is one row
    return total.select("samples", "goodcase", "api_calls", "tokens", rate.alias("goodcase_per_call"), *[one(pairs, c).alias(c) for c in ("unique_pairs", "most", "mean")], one(top, "top_failure_tags").alias("top_failure_tags"))


def dead_letters(rows: DataFrame, key: str, operator: str, error: str) -> DataFrame:
    """(key, operator, error_class, message) of the rows with an error text ``Class: message``; without a class it is Error."""
    named = F.regexp_extract(error, r"^([A-Za-z_][A-Za-z0-9_.]*):", 1)
    message = F.substring(F.regexp_replace(error, r"^[A-Za-z_][A-Za-z0-9_.]*:\s*", ""), 1, MESSAGE_CHARS)
    return rows.where(F.col(error).isNotNull()).select(key, F.lit(operator).alias("operator"), F.coalesce(F.nullif(named, F.lit("")), F.lit("Error")).alias("error_class"), message.alias("message"))


def to_run(rows: DataFrame, letters: DataFrame, key: str, operator: str) -> DataFrame:
    """The rows that a rerun of an operator takes up: those that it has not failed on."""
    return rows.join(letters.where(F.col("operator") == operator).select(key), key, "left_anti")


def final_step(files: DataFrame) -> DataFrame:
    """(file, step, n_rows, problem) of the last step of a run from (file, n_rows): the highest number in ``..._step<N>``.

    Files of telemetry don't count. A final step without rows is a failure, as are two files of it; no step gives no row.
    """
    step = F.regexp_extract("file", r"_step(\d+)\.[^.]*$", 1)
    numbered = files.where(~F.col("file").rlike("(?i)usage|telemetry|failures")).select("file", "n_rows", step.alias("s")).where("s <> ''").withColumn("step", F.col("s").cast("int"))
    best = numbered.groupBy("step").agg(F.min("file").alias("file"), F.sum("n_rows").alias("n_rows"), F.count("*").alias("files")).orderBy(F.desc("step")).limit(1)
    return best.select("file", "step", "n_rows", F.when(F.col("files") > 1, "doubled").when(F.col("n_rows") == 0, "empty").alias("problem"))


def result_table(results: DataFrame, benchmarks: list[str]) -> DataFrame:
    """A row a method from (method, benchmark, score): a column a benchmark, how many it has, their mean, and its rank.

    Only methods with all benchmarks have a mean and a rank; ties share it. A benchmark given twice counts by its best score.
    """
    wide = results.groupBy("method").pivot("benchmark", benchmarks).agg(F.max("score"))
    present = sum((F.col(b).isNotNull().cast("int") for b in benchmarks), F.lit(0))
    mean = F.when(present == len(benchmarks), F.round(sum((F.col(b) for b in benchmarks), F.lit(0.0)) / len(benchmarks), 6))
    rows = wide.withColumn("present", present).withColumn("mean", mean)
    return rows.withColumn("rank", F.when(F.col("mean").isNotNull(), F.rank().over(Window.orderBy(F.desc_nulls_last("mean")))))  # a row a method
