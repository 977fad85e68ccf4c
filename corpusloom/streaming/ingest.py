"""Bounded ingestion as a stream: new files since the last run, folded once into running totals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ingest(spark: SparkSession, folder: str, schema: str, target: str, checkpoint: str) -> None:
    """Append the rows of new JSON-lines files to a Parquet table; a rerun takes up after the last finished batch."""
    rows = spark.readStream.schema(schema).json(folder)
    query = rows.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def fold(state: DataFrame, batch: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    """Totals by key after a batch (batch_id, key, measures). Batch ids that the state holds already are left out.

    The state keeps one row per batch and key, so folding the same batch again changes nothing.
    """
    fresh = batch.join(state.select("batch_id").distinct(), "batch_id", "left_anti")
    sums = fresh.groupBy("batch_id", *key).agg(*[F.sum(m).alias(m) for m in measures])
    return state.unionByName(sums)


def totals(state: DataFrame, key: list[str], measures: list[str]) -> DataFrame:
    return state.groupBy(*key).agg(*[F.sum(m).alias(m) for m in measures])


def fold_stream(spark: SparkSession, folder: str, schema: str, state_path: str, checkpoint: str, key: list[str], measures: list[str]) -> None:
    """Fold new files into the state table, one partition of it per micro-batch, written again whole if a batch is retried."""

    def one(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy(*key).agg(*[F.sum(m).alias(m) for m in measures])
        sums.write.mode("overwrite").parquet(f"{state_path}/batch_id={batch_id}")

    spark.readStream.schema(schema).json(folder).writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
