"""A versioned table: versions are only added, a log says which one is active, and a commit on an old base is refused.

A version's rows are a Parquet table of their own, complete before its entry is made. Entry k of the log is one small file
``log/<k>.json`` that is created only where none is, so of two writers that start from one base the second fails and can
read again and retry. Reads as of an entry or a version never change.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "entry long, kind string, version long, parent long, data string, reason string"


class BaseMoved(RuntimeError):
    """Someone else has committed since the base was read."""


class VersionedTable:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def log(self) -> DataFrame:
        """(entry, kind, version, parent, data, reason), a row each; kind is commit or activate."""
        if not self._files.exists(self._path(f"{self.folder}/log")):
            return self.spark.createDataFrame([], ENTRY)
        return self.spark.read.schema(ENTRY).option("mode", "DROPMALFORMED").json(f"{self.folder}/log")

    def head(self) -> int:
        """Number of the last entry, 0 before the first."""
        return self.log().agg(F.max("entry")).first()[0] or 0

    def _append(self, base: int, **entry) -> int:
        path = self._path(f"{self.folder}/log/{base + 1:012d}.json")
        try:
            out = self._files.create(path, False)  # not if it is there
        except Exception as e:
            raise BaseMoved(f"entry {base + 1} is there already") from e
        try:
            out.write(bytearray(json.dumps({"entry": base + 1, **entry}, sort_keys=True).encode()))
        finally:
            out.close()
        return base + 1

    def commit(self, rows: DataFrame, base: int, reason: str = "") -> int:
        """Add the rows as a new version, active from now on; its number is that of its entry. ``base`` is the head that the rows derive from."""
        if base != self.head():
            raise BaseMoved(f"the log has entry {self.head()}, the rows derive from {base}")
        data = f"data/{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.folder}/{data}")
        return self._append(base, kind="commit", version=base + 1, parent=self.active(base), data=data, reason=reason)

    def activate(self, version: int, base: int, reason: str = "") -> int:
        """Point to an earlier version again; the log keeps all in between."""
        found = self.log().where((F.col("kind") == "commit") & (F.col("version") == version)).first()
        if found is None:
            raise KeyError(f"no version {version}")
        return self._append(base, kind="activate", version=version, parent=self.active(base), data=found.data, reason=reason)

    def active(self, entry: int | None = None) -> int | None:
        """The version that is active now, or was as of an entry."""
        log = self.log() if entry is None else self.log().where(F.col("entry") <= entry)
        last = log.orderBy(F.desc("entry")).first()
        return last.version if last else None

    def read(self, entry: int | None = None, version: int | None = None) -> DataFrame:
        """The active rows, now or as of an entry, or those of a version."""
        log = self.log()
        if version is not None:
            log = log.where((F.col("kind") == "commit") & (F.col("version") == version))
        elif entry is not None:
            log = log.where(F.col("entry") <= entry)
        last = log.orderBy(F.desc("entry")).first()
        if last is None:
            raise KeyError("no such version")
        return self.spark.read.parquet(f"{self.folder}/{last.data}")
