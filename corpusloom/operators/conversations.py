"""Conversations as rows of turns: validity and supervised export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def conversation_validity(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, n_turns and valid: an optional leading system turn, then user and assistant in strict alternation, two turns
    or more, an assistant last, and no blank text."""
    item = F.struct(F.col(turn).alias("t"), F.col(role).alias("role"), F.coalesce(F.trim(F.col(text)) == "", F.lit(True)).alias("blank"))
    rows = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(item)).alias("all"))
    body = F.when(F.col("all")[0]["role"] == "system", F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(0)))).otherwise(F.col("all"))
    rows = rows.withColumn("body", body)
    order = F.transform("body", lambda x, i: x["role"] == F.when(i % 2 == 0, "user").otherwise("assistant"))
    valid = (F.size("body") >= 2) & (F.size("body") % 2 == 0) & F.forall(order, lambda x: x) & ~F.exists("all", lambda x: x["blank"])
    return rows.select("conv_id", F.size("all").cast("long").alias("n_turns"), F.coalesce(valid, F.lit(False)).alias("valid"))


def supervised_pairs(turns: DataFrame) -> DataFrame:
    """instruction, input (empty) and output from each user turn and the assistant turn right after it; blank ones are skipped."""
    next_ = lambda c: F.lead(c).over(Window.partitionBy("conv_id").orderBy("turn"))
    rows = turns.select("conv_id", "turn", "role", F.col("text").alias("instruction"), next_("role").alias("then"), next_("text").alias("output"))
    rows = rows.where("role = 'user' and then = 'assistant' and trim(instruction) <> '' and trim(output) <> ''")
    return rows.select("conv_id", "turn", "instruction", F.lit("").alias("input"), "output")
