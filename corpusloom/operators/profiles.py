"""Profiles of records of any shape: scalar paths of JSON texts, their coverage and their values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.canonical import once

# Bounds of a profile.
DEPTH, MOST_PATHS, MOST_VALUES, VALUE_CHARS, EMBEDDED_CHARS = 3, 40, 20, 160, 64 * 1024


def _is_object(value: Column) -> Column:
    return F.schema_of_variant(value).startswith("OBJECT")


def _opened(value: Column) -> Column:
    """The object in a variant, or in a text that is one whole JSON object; null for all else."""

    def embedded(text: Column) -> Column:
        found = F.when(text.startswith("{") & text.endswith("}") & (F.length(text) <= EMBEDDED_CHARS), F.try_parse_json(text))
        return once(found, lambda o: F.when(_is_object(o), o))

    # a text is parsed once, however often what it holds is asked for
    text = lambda v: F.trim(F.try_variant_get(v, "$", "string"))
    return once(value, lambda v: once(F.schema_of_variant(v), lambda kind: F.when(kind.startswith("OBJECT"), v).when(kind == "STRING", once(text(v), embedded))))


def scalar_values(rows: DataFrame, column: str) -> DataFrame:
    """(path, value): every scalar of the JSON objects in a text column, down to three keys; one pass, no list of fields.

    Texts that are JSON objects themselves are opened like objects. Arrays, longer texts than VALUE_CHARS, and lines that
    are no JSON object give nothing. A value is the text itself or its JSON form; numbers are written as the parser holds
    them, so 1.0 and 1 are one value.
    """
    tvf = rows.sparkSession.tvf
    found = rows.select(_opened(F.try_parse_json(F.col(column))).alias("o0"))  # a filter here would parse every record anew
    for level in range(1, DEPTH + 1):
        opened = tvf.variant_explode_outer(F.col(f"o{level - 1}").outer()).select(F.col("key").alias(f"k{level}"), F.col("value").alias(f"v{level}"))
        found = found.lateralJoin(opened).withColumn(f"o{level}", _opened(F.col(f"v{level}")))
    path = F.concat_ws(".", *[F.col(f"k{level}") for level in range(1, DEPTH + 1)])
    value, is_open = F.coalesce(*[F.col(f"v{level}") for level in range(DEPTH, 0, -1)]), F.coalesce(*[F.when(F.col(f"v{level}").isNotNull(), F.col(f"o{level}").isNotNull()) for level in range(DEPTH, 0, -1)])
    kind = F.schema_of_variant(value)
    text = F.when(kind == "STRING", F.try_variant_get(value, "$", "string")).otherwise(F.to_json(value))
    scalars = found.where(~is_open & ~kind.startswith("ARRAY")).select(path.alias("path"), text.alias("value"), kind.alias("kind"))
    return scalars.where((F.col("kind") != "STRING") | (F.length("value") <= VALUE_CHARS)).select("path", "value")


def scalar_profile(rows: DataFrame, column: str) -> DataFrame:
    """path, present_rows, missing_rows, coverage_rate, distinct_values, value, n: the value counts of up to 40 paths.

    Paths with more than 20 different values take no part; the others rank by rows, then by different values, then by name.
    """
    counts = scalar_values(rows, column).groupBy("path", "value").agg(F.count("*").alias("n"))
    paths = counts.groupBy("path").agg(F.sum("n").alias("present_rows"), F.count("*").alias("distinct_values")).where(F.col("distinct_values") <= MOST_VALUES)
    paths = paths.orderBy(F.desc("present_rows"), F.desc("distinct_values"), "path").limit(MOST_PATHS)
    total = rows.where(F.trim(F.col(column)) != "").agg(F.count("*")).scalar()
    missing = F.greatest(F.lit(0).cast("long"), total - F.col("present_rows"))
    figures = paths.select("path", "present_rows", missing.alias("missing_rows"), F.round(F.col("present_rows") / total, 6).alias("coverage_rate"), "distinct_values")
    return counts.join(figures, "path").select("path", "present_rows", "missing_rows", "coverage_rate", "distinct_values", "value", "n")


def top_fields(rows: DataFrame, column: str, most: int = 256) -> DataFrame:
    """(field): names of the first level of the JSON objects in a text column, the first ``most`` by name."""
    keys = F.json_object_keys(F.when(F.trim(F.col(column)).startswith("{"), F.col(column)))
    return rows.select(F.explode(keys).alias("field")).distinct().orderBy("field").limit(most)


def repeated_share(rows: DataFrame, column: str) -> DataFrame:
    """(path, value, n, share) of the most frequent value of every path; ties go to the smaller value."""
    best = Window.partitionBy("path").orderBy(F.desc("n"), "value")
    ranked = scalar_profile(rows, column).withColumn("r", F.row_number().over(best)).where("r = 1")
    return ranked.select("path", "value", "n", F.round(F.col("n") / F.col("present_rows"), 6).alias("share"))
