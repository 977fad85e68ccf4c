"""Hypotheses under test: support and opposition by batch, retirement of what nothing tests, promotion up to a cap.

Observations are (strategy, hypothesis, batch, verdict), the verdict one of support, oppose and not_tested. A batch counts
once, by the strongest of its verdicts in this order: support, oppose, not_tested; the same again changes nothing. After a
batch a hypothesis that no batch tested ``retire_after`` times running is retired, for good; one that at least
``least_support`` batches support, more than oppose it, asks to be promoted. A strategy promotes at most ``most`` of them:
by the batch in which they first asked, then by support, then by name. What is promoted can't retire any more.

``fold`` is the batch form. ``run_stream`` gives the same states from files as they come, by keyed state over micro-batches.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

LEAST_SUPPORT, RETIRE_AFTER, MOST = 2, 2, 3
KEY = ["strategy", "hypothesis"]
OBSERVED = "strategy string, hypothesis string, batch long, verdict string"
STATE = "support array<bigint>, oppose array<bigint>, streak int, asked bigint, asked_support int, stale bigint, last bigint"


def fold(observations: DataFrame, least_support: int = LEAST_SUPPORT, retire_after: int = RETIRE_AFTER) -> DataFrame:
    """The state of each hypothesis after all its batches: support, oppose, streak, asked, asked_support, stale, last.

    asked: the batch in which it first asked to be promoted; stale: the one that retired it (null: none).
    """
    one = observations.groupBy(*KEY, "batch").agg(F.max(F.struct(F.array_position(F.array(*map(F.lit, ("not_tested", "oppose", "support"))), F.col("verdict")), "verdict"))["verdict"].alias("verdict"))
    so_far = Window.partitionBy(*KEY).orderBy("batch").rowsBetween(Window.unboundedPreceding, 0)
    is_ = lambda v: (F.col("verdict") == v).cast("int")
    rows = one.withColumn("tested", F.sum(1 - is_("not_tested")).over(so_far)).withColumn("for_", F.sum(is_("support")).over(so_far)).withColumn("against", F.sum(is_("oppose")).over(so_far))
    streak = F.sum(is_("not_tested")).over(Window.partitionBy(*KEY, "tested").orderBy("batch").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("streak", streak.cast("int"))
    stale = F.min(F.when(F.col("streak") >= retire_after, F.col("batch")))
    asks = (F.col("for_") >= least_support) & (F.col("against") < F.col("for_"))
    asked = F.min(F.when(asks, F.struct("batch", F.col("for_").cast("int").alias("n"))))
    states = rows.groupBy(*KEY).agg(
        F.array_sort(F.collect_list(F.when(F.col("verdict") == "support", F.col("batch")))).alias("support"),
        F.array_sort(F.collect_list(F.when(F.col("verdict") == "oppose", F.col("batch")))).alias("oppose"),
        F.max_by("streak", "batch").alias("streak"), asked.alias("a"), stale.alias("stale"), F.max("batch").alias("last"),
    )
    early = F.col("stale").isNull() | (F.col("a.batch") < F.col("stale"))  # what is retired does not ask
    return states.select(*KEY, "support", "oppose", "streak", F.when(early, F.col("a.batch")).alias("asked"), F.when(early, F.col("a.n")).alias("asked_support"), "stale", "last")


def statuses(states: DataFrame, most: int = MOST) -> DataFrame:
    """strategy, hypothesis, n_support, n_oppose, streak, status (open, promoted or retired) and since, the batch of the last change."""
    order = Window.partitionBy("strategy").orderBy("asked", F.desc("asked_support"), "hypothesis")
    ranked = states.where("asked is not null").withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select(*KEY, F.lit(True).alias("promoted"))
    rows = states.join(ranked, KEY, "left")
    status = F.when(F.col("promoted"), "promoted").when(F.col("stale").isNotNull(), "retired").otherwise("open")
    since: Column = F.when(F.col("promoted"), F.col("asked")).otherwise(F.col("stale"))
    return rows.select(*KEY, F.size("support").alias("n_support"), F.size("oppose").alias("n_oppose"), "streak", status.alias("status"), since.alias("since"))


def replayed(verdicts: dict[int, str], least_support: int = LEAST_SUPPORT, retire_after: int = RETIRE_AFTER) -> dict:
    """The state of a hypothesis from its verdict in each batch, whatever the order in which they came."""
    state = {"support": [], "oppose": [], "streak": 0, "asked": None, "asked_support": None, "stale": None, "last": None}
    for batch, verdict in sorted(verdicts.items()):
        state |= {"last": batch, "streak": state["streak"] + 1 if verdict == "not_tested" else 0}
        if verdict in ("support", "oppose"):
            state[verdict].append(batch)
        if state["stale"] is None and state["streak"] >= retire_after:
            state["stale"] = batch
        n = len(state["support"])
        if state["stale"] is None and state["asked"] is None and n >= least_support and len(state["oppose"]) < n:
            state["asked"], state["asked_support"] = batch, n
    return state


class Tracker(StatefulProcessor):
    """Keyed state of one hypothesis: its verdict in each batch so far, a number and a word a batch."""

    RANK = {"not_tested": 0, "oppose": 1, "support": 2}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("verdicts", "batches array<bigint>, verdicts array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values) -> Iterator[Row]:  # noqa: N802
        held = self.state.get() if self.state.exists() else ([], [])
        verdicts = dict(zip(*held, strict=True))
        for row in rows:
            verdicts[row.batch] = max(verdicts.get(row.batch, row.verdict), row.verdict, key=self.RANK.get)
        self.state.update((list(verdicts), list(verdicts.values())))
        yield Row(strategy=key[0], hypothesis=key[1], **replayed(verdicts), seen=len(verdicts))

    def close(self) -> None:
        pass


def run_stream(spark: SparkSession, folder: str, target: str, checkpoint: str) -> DataFrame:
    """Take in new files of observations (JSON lines, in any order) and return the states so far.

    A run ends when all files are in; the next one takes up there. ``target`` gets the state of each hypothesis that a
    micro-batch touched; the newest of each is its state.
    """
    key, provider = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(key)
    spark.conf.set(key, provider)  # keyed state of this kind needs it; the session's own holds again after the run
    try:
        rows = spark.readStream.schema(OBSERVED).option("maxFilesPerTrigger", 1).json(folder)
        states = rows.groupBy(*KEY).transformWithState(statefulProcessor=Tracker(), outputStructType=f"strategy string, hypothesis string, {STATE}, seen int", outputMode="append", timeMode="none")
        states.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(key, before)
    return latest(spark.read.parquet(target))


def latest(states: DataFrame) -> DataFrame:
    """The newest state of each hypothesis: the one that has seen most batches, then the one with most verdicts for it."""
    columns = [c for c in states.columns if c not in (*KEY, "seen")]
    newest = F.max_by(F.struct(*columns), F.struct("seen", F.size("support"), F.size("oppose")))
    return states.groupBy(*KEY).agg(newest.alias("s")).select(*KEY, "s.*")
