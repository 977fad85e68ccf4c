"""Pipelines of record operators: contracts, checks before the run, step tables and their reuse."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """Fields that must be there, and those of them that must not be null or empty."""

    fields: tuple[str, ...] = ()
    required: tuple[str, ...] = ()

    def missing(self, columns: list[str]) -> list[str]:
        return [c for c in (*self.fields, *self.required) if c not in columns]

    def violations(self, rows: DataFrame) -> DataFrame:
        """Rows that break the contract, with the fields at fault."""
        at_fault = [F.when(F.col(c).isNull() | (F.col(c).cast("string") == ""), F.lit(c)) for c in self.required]
        faults = F.filter(F.array(*at_fault), lambda c: c.isNotNull()) if at_fault else F.array().cast("array<string>")
        return rows.withColumn("violations", faults).where(F.size("violations") > 0)


@dataclass(frozen=True)
class Operator:
    """A named step from one table to the next, with what it reads and what it adds. version: changes with its meaning."""

    name: str
    apply: Callable[[DataFrame], DataFrame]
    reads: tuple[str, ...] = ()
    adds: tuple[str, ...] = ()
    drops: tuple[str, ...] = ()
    version: str = "1"
    settings: dict = field(default_factory=dict)

    def identity(self, before: str) -> str:
        state = [before, self.name, self.version, sorted(self.reads), sorted(self.adds), sorted(self.drops), self.settings]
        return hashlib.sha256(json.dumps(state, sort_keys=True, default=str).encode()).hexdigest()


class Pipeline:
    def __init__(self, *operators: Operator):
        self.operators = operators

    def compile(self, columns: list[str]) -> list[list[str]]:
        """Columns after every step; raises once with all fields that are read but not there, or written twice."""
        have, after, problems = list(columns), [], []
        for op in self.operators:
            problems += [f"{op.name} reads {c}, which no step before it has" for c in op.reads if c not in have]
            problems += [f"{op.name} writes {c}, which is there already" for c in op.adds if c in have]
            have = [c for c in have if c not in op.drops] + [c for c in op.adds if c not in have]
            after.append(have)
        if problems:
            raise KeyError("; ".join(problems))
        return after

    def plan(self, rows: DataFrame) -> DataFrame:
        """One lazy plan of all steps."""
        self.compile(rows.columns)
        for op in self.operators:
            rows = op.apply(rows)
        return rows

    def run(self, spark: SparkSession, rows: DataFrame, folder: str, source: str) -> tuple[DataFrame, DataFrame]:
        """(result, steps): every step is a table under its identity, and the longest prefix that is there already is reused.

        source identifies the input. steps: step, name, identity, n_rows, reused.
        """
        self.compile(rows.columns)
        identity, report, reuse = source, [], True
        for k, op in enumerate(self.operators):
            identity = op.identity(identity)
            path = f"{folder}/step={k + 1}-{identity[:16]}"
            reuse = reuse and _is_complete(spark, path)
            if not reuse:
                op.apply(rows).write.mode("overwrite").parquet(path)
            rows = spark.read.parquet(path)
            report.append((k + 1, op.name, identity, rows.count(), reuse))
        return rows, spark.createDataFrame(report, "step int, name string, identity string, n_rows long, reused boolean")


def _is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished table is there, on whatever file system the path names."""
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return bool(marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker))


def split_failures(rows: DataFrame, result: str, error: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, dead letters) of a table whose model column left a value or an error message, cut to 1,000 characters."""
    bad = F.col(error).isNotNull()
    return rows.where(~bad).drop(error), rows.where(bad).drop(result).withColumn(error, F.substring(error, 1, 1000))


def best(candidates: list[tuple[bool, float]], strict: bool = True) -> int:
    """Index of the best (passed, score); the earlier wins ties if strict, else the later."""
    top = 0
    for k, c in enumerate(candidates):
        if c > candidates[top] or (not strict and c == candidates[top]):
            top = k
    return top


def review_score(parts: dict[str, float], weights: dict[str, float], hard_factor: float, policy: str = "gate") -> float:
    """Weighted mean over the parts at hand; the hard factor multiplies it only under ``penalty``."""
    got = {k: w for k, w in weights.items() if k in parts}
    score = sum(parts[k] * w for k, w in got.items()) / sum(got.values()) if got else 0.0
    return score * hard_factor if policy == "penalty" else score
