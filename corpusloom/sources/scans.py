"""Scans of folders of files: rows by number without a sort, counts from footers, completeness, and evaluation sets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.sources.shared import scratch

# The fields that an evaluation reads.
EVALUATED = ("problem", "answer", "solution", "id", "problem_idx")
BLOCK_BITS = 18  # numbers of files are compared in blocks of so many bits
GAP_ROWS = 1 << 16
JSON_KINDS, TABLE_KINDS = {"json", "jsonl", "ndjson"}, {"parquet"}


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, bytes, kind) of all files below a folder or of one file; nothing is opened."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", recursive)
    listed = reader.load(folder).select("path", F.col("length").alias("bytes"))
    return listed.withColumn("kind", F.lower(F.regexp_extract(file_name(F.col("path")), r"\.([^.]+)$", 1)))


def numbered(rows: DataFrame, name: str = "row") -> DataFrame:
    """rows of a file scan with their number from 0, in the order of file paths and of rows in them, without sorting rows.

    Spark reads files in blocks. A first pass counts the rows of each block (Parquet: from the footers), sums of a row a
    block give where each starts, and within a block rows stand in order. The second pass reads just what is asked of it.
    """
    at = [F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"), F.monotonically_increasing_id().alias("__id")]
    blocks = rows.select(*at).groupBy("__file", "__block").agg(F.count("*").alias("n"), F.min("__id").alias("__first"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block, as many as tasks read
    known = blocks.select("__file", "__block", "__first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__begin"))
    number = (F.col("__begin") + F.col("__id") - F.col("__first")).alias(name)
    return rows.select("*", *at).join(known, ["__file", "__block"]).select(*[c for c in rows.columns if c != "_metadata"], number)


def batch(rows: DataFrame, size: int, index: int, name: str = "row") -> DataFrame:
    """Rows ``index * size`` up to ``(index + 1) * size`` of a file scan, numbered from 0 again."""
    if size < 1 or index < 0:
        raise ValueError("a batch has a positive size and an index from 0")
    all_ = numbered(rows, name)
    return all_.where(F.col(name).between(index * size, (index + 1) * size - 1)).withColumn(name, F.col(name) - index * size)


def batches(rows: DataFrame, size: int, name: str = "row") -> Iterator[DataFrame]:
    """All batches, one after the other, as tables that are read when used; a last one may be short. An empty scan gives none."""
    all_ = numbered(rows, name)
    n = rows.count()
    for k in range(-(-n // size)):
        yield all_.where(F.col(name).between(k * size, (k + 1) * size - 1)).withColumn(name, F.col(name) - k * size)


def parquet_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_rows, bytes) of each Parquet file that has rows. No column is asked for, so tasks read footers only, whatever the rows."""
    rows = spark.read.parquet(folder).select(file_name(F.col("_metadata.file_path")).alias("file"), F.col("_metadata.file_size").alias("bytes"))
    return rows.groupBy("file", "bytes").agg(F.count("*").alias("n_rows")).select("file", "n_rows", "bytes")


def line_counts(spark: SparkSession, folder: str) -> DataFrame:
    """(file, n_rows) of files of one record a line; blank lines are no records."""
    lines = spark.read.text(folder).select(file_name(F.col("_metadata.file_path")).alias("file"), "value")
    return lines.groupBy("file").agg(F.count(F.when(F.trim("value") != "", 1)).alias("n_rows"))


def numbering_gaps(names: DataFrame, pattern: str = r"(\d+)\D*$", column: str = "file") -> DataFrame:
    """(number, problem): numbers that are missing between the smallest and the largest of files ``column``, or stand there twice.

    Files without a number are not looked at. Gaps come from neighbours, so no list of all numbers is made but of missing ones.
    Neighbours are sought within blocks of ``1 << BLOCK_BITS`` numbers, then between the blocks of a block of blocks, and so
    on, each time by the least and the greatest number that stand in them; no group has more rows than that.
    """
    number = F.regexp_extract(column, pattern, 1)
    digits = names.select(number.alias("digits")).where("digits <> ''").select(F.col("digits").cast("long").alias("number"))
    seen = digits.groupBy("number").agg((F.count("*") > 1).alias("doubled"))
    spark, path = names.sparkSession, scratch(names.sparkSession, "numbers")
    seen.write.parquet(path)  # names are read once
    seen = spark.read.schema(seen.schema).parquet(path)
    level = seen.select(F.col("number").alias("first"), F.col("number").alias("last"), F.shiftright("number", BLOCK_BITS).alias("block"))
    bounds = seen.groupBy(F.shiftright("number", BLOCK_BITS).alias("block")).agg(F.min("number").alias("first"), F.max("number").alias("last"))
    gaps = None
    for _ in range(-(-63 // BLOCK_BITS)):  # of 63 bits, the last level has one block
        next_ = F.lead("first").over(Window.partitionBy("block").orderBy("first"))
        found = level.select("last", next_.alias("next")).where(F.col("next") - 1 > F.col("last"))
        gaps = found if gaps is None else gaps.unionByName(found)
        level = bounds.select("first", "last", F.shiftright("block", BLOCK_BITS).alias("block"))
        bounds = level.groupBy("block").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    # a wide gap is cut first, so no row holds all its numbers
    runs = gaps.select(F.explode(F.sequence(F.col("last") + 1, F.col("next") - 1, F.lit(GAP_ROWS))).alias("a"), "next")
    missing = runs.select(F.explode(F.sequence("a", F.col("a") + F.least(F.lit(GAP_ROWS - 1), F.col("next") - 1 - F.col("a")))).alias("number"), F.lit("missing").alias("problem"))
    return missing.union(seen.where("doubled").select("number", F.lit("doubled").alias("problem")))


def read_evaluation(spark: SparkSession, folder: str, fields: tuple[str, ...] = EVALUATED) -> DataFrame:
    """The fields of an evaluation set that it has, as text, from a folder of JSON files (an array of objects, or objects under ``data``), JSON lines, or Parquet.

    Only these fields are read. Folders without such files, or with both forms, are refused.
    """
    kinds = {r.kind for r in files(spark, folder).select("kind").distinct().collect()} & (JSON_KINDS | TABLE_KINDS)
    if not kinds:
        raise FileNotFoundError(f"no JSON, JSON lines or Parquet files in {folder}")
    if kinds & JSON_KINDS and kinds & TABLE_KINDS:
        raise ValueError(f"mixed files in {folder}: {sorted(kinds)}")
    if kinds & TABLE_KINDS:
        rows = spark.read.option("recursiveFileLookup", True).parquet(folder)
        return rows.select(*[F.col(f).cast("string").alias(f) for f in fields if f in rows.columns])
    flat = ", ".join(f"{f} string" for f in fields)
    found = None
    for kind in sorted(kinds):
        reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{kind}")
        if kind == "json":
            whole = reader.schema(f"data array<struct<{flat.replace(' string', ': string')}>>, {flat}").option("multiLine", True).json(folder)
            rows = whole.select(F.explode(F.when(F.col("data").isNull(), F.array(F.struct(*fields))).otherwise(F.col("data"))).alias("r")).select("r.*")
        else:
            rows = reader.schema(flat).json(folder)
        found = rows if found is None else found.unionByName(rows)
    return found


def corpus_texts(spark: SparkSession, path: str, field: str = "text", most: int | None = None) -> DataFrame:
    """(text): the texts of a corpus that is one file of JSON lines, a folder of them, or else a folder of Parquet shards; blank ones are left out.

    ``most`` takes the first so many by file and line.
    """
    kinds = {r.kind for r in files(spark, path).select("kind").distinct().collect()}
    lines = kinds & {"jsonl", "ndjson"}
    if lines:
        rows = spark.read.schema(f"`{field}` string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jsonl,ndjson}").json(path)
    elif "parquet" in kinds:
        rows = spark.read.option("recursiveFileLookup", True).parquet(path).select(F.col(field).cast("string"))
    else:
        raise FileNotFoundError(f"no JSON lines or Parquet shards in {path}")
    text = rows if most is None else numbered(rows, "__row").where(F.col("__row") < most)
    return text.where(F.trim(F.col(field)) != "").select(F.col(field).alias("text"))
