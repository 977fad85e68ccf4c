r"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line stripped of ``[\x20\x09-\x0D]`` and with A-Z lower-cased; keys are compared by 128-bit hashes. Keys
of at least ``chars`` code points that at least ``least`` documents hold lose all their lines.

Documents come in batches. A run holds (key, number of documents), ascending by key. Each new batch is counted, merge-anti-
joined with the run of settled keys (those that reached ``least`` already and need no more counting), and what is left is
added as a run of level 0. When a level has ``fanout`` runs they are merged into one of the next level, and keys that reach
``least`` there move to the settled run. So a key is rewritten once a level, a logarithm of the number of batches, and
frequent lines stop taking part early. Runs are tables in the shared folder; a run that has been merged is deleted only
when its successor is complete.

A text is hashed once, into postings of (document, key). The settled keys come back to their documents by two joins, on the
key, salted so that a line that a third of all documents hold is dealt to ``SALTS`` tasks, and then on a hash of id and
text; nothing is broadcast by us or gathered for more than one document.

Odd rows: null and empty texts are one empty line; an empty key is shorter than one code point and stays. Every row counts
as a document, also repeated ones, and null ids are ids like others. An empty table gives no rows. Columns of the input
that have the name of a result (n_lines, n_dropped) are replaced.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import in_arrow, shared_dir, slices

BLANK = b" \t\n\v\f\r"
KEY = ["k1", "k2"]
SALTS = 8


def line_hashes(text: bytes, chars: int) -> list[bytes | None]:
    """A 128-bit hash of the key of each line, None for keys that are too short."""
    keys = [line.strip(BLANK).lower() for line in text.split(b"\n")]
    # bytes below 0xC0 and above 0x7F only continue a code point
    short = [len(k) < chars or (len(k) < 4 * chars and len(k.decode("utf-8", "replace")) < chars) for k in keys]
    return [None if s else hashlib.blake2b(k, digest_size=16).digest() for k, s in zip(keys, short, strict=True)]


def _route(docs: DataFrame):
    """A hash that brings back to a row what was found out about its text."""
    return F.xxhash64("doc_id", "text")


def postings(docs: DataFrame, batches: int, chars: int = 1) -> DataFrame:
    """(batch, route, k1, k2): each distinct line key of each document."""

    def run(batches_):
        for part in slices(batches_, "text"):
            rows, found = [], []
            for i, text in enumerate(part["text"]):
                keys = {h for h in line_hashes((text.as_py() or "").encode(), chars) if h is not None}
                found.extend(keys)
                rows.append(np.full(len(keys), i))
            at = np.concatenate(rows)
            keys = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*(part[c].combine_chunks().take(pa.array(at)) for c in ("batch", "route")), pa.array(np.ascontiguousarray(keys[:, 0])), pa.array(np.ascontiguousarray(keys[:, 1]))], ["batch", "route", *KEY])

    dealt = docs.select(F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"), _route(docs).alias("route"), "text")
    return in_arrow(dealt, run, "batch int, route long, k1 long, k2 long")


class LineRuns:
    """Runs of (k1, k2, n) in a folder that driver and executors share; in each, settled keys lie apart from the others."""

    def __init__(self, spark: SparkSession, folder: str, least: int = 10, fanout: int = 2):
        self.spark, self.folder, self.least, self.fanout = spark, folder.rstrip("/"), least, fanout
        self.levels: list[list[str]] = [[]]
        self.all: list[str] = []

    def _read(self, runs: list[str], settled: bool) -> DataFrame:
        rows = self.spark.read.option("basePath", self.folder).schema("k1 long, k2 long, n long, run string, settled boolean").parquet(*runs)
        return rows.where(F.col("settled") == settled).select(*KEY, "n")

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.folder}/run={len(self.all)}-{uuid.uuid4().hex}"
        rows.withColumn("settled", F.col("n") >= self.least).sortWithinPartitions("settled", *KEY).write.partitionBy("settled").parquet(path)
        self.all.append(path)
        return path

    def add(self, keys: DataFrame) -> None:
        """One more batch: (k1, k2), a row for each document that holds the key."""
        fresh = keys.groupBy(*KEY).agg(F.count("*").alias("n"))
        if self.all:
            fresh = fresh.join(self._read(self.all, True), KEY, "left_anti")
        self.levels[0].append(self._write(fresh))
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            self._merge(self.levels[level], level + 1)
            self.levels[level] = []
            level += 1

    def _merge(self, runs: list[str], level: int) -> None:
        path = self._write(self._read(runs, False).groupBy(*KEY).agg(F.sum("n").alias("n")))
        self.levels += [[] for _ in range(level + 1 - len(self.levels))]
        self.levels[level].append(path)
        for run in runs:  # what has settled in them stays
            old = self.spark._jvm.org.apache.hadoop.fs.Path(f"{run}/settled=false")
            old.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(old, True)

    def frequent(self) -> DataFrame:
        """(k1, k2) of all keys that at least ``least`` documents hold, after merging what is left of all levels."""
        runs = [run for level in self.levels for run in level]
        if len(runs) > 1:
            top = len(self.levels)
            self.levels = [[] for _ in range(top)]
            self._merge(runs, top)
        if not self.all:
            return self.spark.createDataFrame([], "k1 long, k2 long")
        return self._read(self.all, True).select(*KEY)


def drop_repeated_lines(docs: DataFrame, least: int = 10, chars: int = 1, batches: int = 4, fanout: int = 2) -> DataFrame:
    """docs (doc_id, text, ...) with the texts' repeated lines dropped, n_lines before that and n_dropped."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    folder = f"{shared_dir(spark).rstrip('/')}/corpusloom/lines-{uuid.uuid4().hex}"
    postings(docs, batches, chars).write.partitionBy("batch").parquet(f"{folder}/postings")
    posted = spark.read.schema("route long, k1 long, k2 long, batch int").parquet(f"{folder}/postings")
    runs = LineRuns(spark, f"{folder}/runs", least, fanout)
    for batch in range(batches):
        runs.add(posted.where(F.col("batch") == batch).select(*KEY))
    salted = runs.frequent().withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    hits = posted.withColumn("salt", F.pmod("route", F.lit(SALTS)).cast("int")).join(salted, [*KEY, "salt"], "left_semi").select("route", *KEY).distinct()
    marked = hits.groupBy("route").agg(F.collect_list(F.struct(*KEY)).alias("__drop"))
    fields = docs.schema.fields
    own = [f"__{i}" for i in range(len(fields))]  # names of any kind, also "route", may be in the input
    plain = docs.select(_route(docs).alias("__route"), *[F.col(f"`{f.name}`").alias(o) for f, o in zip(fields, own, strict=True)])
    joined = plain.join(marked.withColumnRenamed("route", "__route"), "__route", "left").select(*own, "__drop")
    names = [f.name for f in fields]
    text = names.index("text")

    def run(batches_):
        for part in slices(batches_, own[text]):
            texts, lines, dropped = [], [], []
            for value, drop in zip(part[own[text]], part["__drop"], strict=True):
                value = (value.as_py() or "").encode()
                if drop.is_valid:
                    gone = {np.array([d["k1"], d["k2"]], "<i8").tobytes() for d in drop.as_py()}
                    before = value.split(b"\n")
                    kept = [line for line, h in zip(before, line_hashes(value, chars), strict=True) if h not in gone]
                    lines.append(len(before))
                    dropped.append(len(before) - len(kept))
                    value = b"\n".join(kept)
                else:
                    lines.append(value.count(b"\n") + 1)
                    dropped.append(0)
                texts.append(value)
            columns = [pa.array(texts, pa.binary()).cast(pa.string()) if k == text else part[o] for k, o in enumerate(own)]
            yield from pa.Table.from_arrays([*columns, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], [*names, "n_lines", "n_dropped"]).combine_chunks().to_batches()

    return in_arrow(joined, run, T.StructType([*fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_lines, n_dropped, and the SHA-256 of the lines that stay, joined by newlines."""
    done = drop_repeated_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))
