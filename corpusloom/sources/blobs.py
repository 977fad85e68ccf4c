"""Blobs by content: stored once under their SHA-256, verified when read, under keys that can't leave their folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STORED = "sha256 string, content binary, bytes long, head string"


def safe_key(key: Column) -> Column:
    """Whether a key is relative and has no empty, ``.`` or ``..`` part and no colon, with either kind of slash."""
    parts = F.split(F.replace(key, F.lit("\\"), F.lit("/")), "/")
    return F.coalesce(~F.exists(parts, lambda p: p.isin("", ".", "..") | F.contains(p, F.lit(":"))), F.lit(False))


def refuse_unsafe(rows: DataFrame, key: str) -> DataFrame:
    """The rows, but an error in the task that meets a key that could leave its folder."""
    checked = F.when(safe_key(F.col(key)), F.col(key)).otherwise(F.raise_error(F.concat(F.lit("unsafe storage key "), F.coalesce(F.col(key), F.lit("null")))))
    return rows.withColumn(key, checked)


class BlobTable:
    """A Parquet table of blobs in a folder, in parts by the first two digits of the digest."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def rows(self) -> DataFrame:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(self.folder)

    def put(self, blobs: DataFrame) -> DataFrame:
        """Store the contents of (key, content, media_type) that are not there yet, once each.

        Returns references (key, uri, media_type, sha256, bytes), one for each row; unsafe keys are refused before anything
        is written. Only digests are compared with what is stored, contents are not read again.
        """
        blobs = refuse_unsafe(blobs, "key").withColumn("sha256", F.sha2("content", 256))
        refs = blobs.select("key", F.concat(F.lit("blobs/"), F.substring("sha256", 1, 2), F.lit("/"), "sha256").alias("uri"), "media_type", "sha256", F.length("content").cast("long").alias("bytes"))
        if blobs.where(F.col("content").isNull()).select(F.col("key")).head(1):
            raise ValueError("a blob without content")
        blobs.select("key").write.format("noop").mode("overwrite").save()  # unsafe keys end here
        new = blobs.join(self.rows().select("sha256"), "sha256", "left_anti").groupBy("sha256").agg(F.first("content").alias("content"))
        new.withColumn("bytes", F.length("content").cast("long")).withColumn("head", F.substring("sha256", 1, 2)).write.mode("append").partitionBy("head").parquet(self.folder)
        return refs

    def get(self, refs: DataFrame) -> DataFrame:
        """refs (key, sha256, ...) with their content and a problem: missing, changed (the content has another digest) or null.

        What is missing or changed comes without its content.
        """
        found = self.rows().withColumn("same", F.sha2("content", 256) == F.col("sha256")).select("sha256", "content", "same")
        rows = refs.join(found, "sha256", "left")
        problem = F.when(F.col("same").isNull(), "missing").when(~F.col("same"), "changed")
        return rows.withColumn("problem", problem).withColumn("content", F.when(F.col("same"), F.col("content"))).drop("same")


def reference_problem(kind: Column, uri: Column, media_type: Column) -> Column:
    """Why a reference to an artifact is refused: an unknown kind, no address, or a type that is not its kind's; null if it is not."""
    family = F.split_part(F.coalesce(media_type, F.lit("")), F.lit("/"), F.lit(1))
    return (
        F.when(~F.coalesce(kind.isin("image", "binary", "blob", "video_reference"), F.lit(False)), "unknown_kind").when(F.trim(F.coalesce(uri, F.lit(""))) == "", "uri_is_required")
        .when((kind == "image") & (family != "image"), "image_needs_image_type").when((kind == "video_reference") & (family != "video"), "video_needs_video_type")
    )


def registered(artifacts: DataFrame, new: DataFrame) -> DataFrame:
    """A registry (name, kind, uri, media_type, sha256) with new references in place of those of the same name; refused ones are an error of their task."""
    problem = reference_problem(F.col("kind"), F.col("uri"), F.col("media_type"))
    checked = F.when(problem.isNull(), F.col("uri")).otherwise(F.raise_error(F.concat_ws(": ", F.col("name"), problem)))
    columns = ["name", "kind", "uri", "media_type", "sha256"]
    latest = refuse_unsafe(new, "name").withColumn("uri", checked).select(*columns).dropDuplicates(["name"])
    return artifacts.select(*columns).join(latest.select("name"), "name", "left_anti").unionByName(latest)
