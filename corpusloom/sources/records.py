"""Reading and writing record tables: declared schemas, corrupt rows, profiles, step tables, exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW_CAP, PREVIEW_ROWS, PREVIEW_CHARS = 200_000, 3, 200


def read_records(spark: SparkSession, path: str, schema: T.StructType | str, kind: str | None = None) -> DataFrame:
    """json, jsonl, csv or parquet (by the text after the last dot) under a declared schema; NaN reads as null."""
    kind = kind or path.rstrip("/").rpartition(".")[2]
    reader = spark.read.schema(schema)
    if kind == "json":
        rows = reader.option("multiLine", True).json(path)
    elif kind in ("jsonl", "ndjson"):
        rows = reader.json(path)
    elif kind == "csv":
        rows = reader.option("header", True).csv(path)
    elif kind == "parquet":
        rows = reader.parquet(path)
    else:
        raise ValueError(f"no reader for {kind}")
    return nan_as_null(rows)


def nan_as_null(rows: DataFrame) -> DataFrame:
    floats = {f.name for f in rows.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if c in floats else F.col(c) for c in rows.columns])


def read_objects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, corrupt lines) of a file of one JSON object a line; blank lines are skipped."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}).alias("r"))
    bad = F.col("r._corrupt").isNotNull() | ~F.col("value").rlike(r"^\s*\{")
    return parsed.where(~bad).select(*[F.col(f"r.{f.name}") for f in schema]), parsed.where(bad).select("value")


def read_texts(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """Reference texts, a line each; JSON objects give their fields joined by spaces, a leading byte-order mark is dropped."""
    line = F.regexp_replace("value", r"^\x{FEFF}", "")
    parsed = F.from_json(line, "map<string,string>")
    chosen = F.filter(F.array(*[parsed[f] for f in fields]) if fields else F.map_values(parsed), lambda v: v.isNotNull() & (v != ""))
    text = F.when(line.rlike(r"^\s*\{"), F.array_join(chosen, " ")).otherwise(line)
    return spark.read.text(path).select(text.alias("text")).where(F.trim("text") != "")


def profile(rows: DataFrame) -> dict:
    """Fields, a row count up to a cap, and a few shortened sample rows."""
    n = rows.limit(ROW_CAP + 1).count()
    short = [F.substring(F.col(c).cast("string"), 1, PREVIEW_CHARS).alias(c) for c in rows.columns]
    return {"fields": rows.columns, "rows": min(n, ROW_CAP), "capped": n > ROW_CAP, "sample": [r.asDict() for r in rows.select(*short).limit(PREVIEW_ROWS).collect()]}


def union_ragged(first: DataFrame, *more: DataFrame) -> DataFrame:
    for rows in more:
        first = first.unionByName(rows, allowMissingColumns=True)
    return first


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """New rows replace old ones of the same key."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def verified_blobs(spark: SparkSession, folder: str, expected: DataFrame) -> DataFrame:
    """Files of a folder whose SHA-256 is among the expected (sha256)."""
    blobs = spark.read.format("binaryFile").load(folder).withColumn("sha256", F.sha2("content", 256))
    return blobs.join(expected.select("sha256").distinct(), "sha256", "left_semi")


def dangling(rows: DataFrame, refs: str, registry: DataFrame, key: str) -> DataFrame:
    """References that the registry lacks; must be empty."""
    return rows.select(F.explode(refs).alias(key)).distinct().join(registry.select(key), key, "left_anti")


def permuted_choices(items: DataFrame, views: int, seed: str) -> DataFrame:
    """Views of a multiple-choice item (id, choices), each with its options in an order by hash."""
    view = items.select("id", "choices", F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view"))
    keyed = F.transform("choices", lambda c, i: F.struct(F.sha2(F.concat_ws("|", F.lit(seed), F.col("id").cast("string"), F.col("view").cast("string"), i.cast("string")), 256).alias("k"), i.alias("i"), c.alias("c")))
    return view.select("id", "view", F.transform(F.array_sort(keyed), lambda x: x["c"]).alias("choices"))
