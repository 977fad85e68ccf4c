"""Shared pieces of the training-data operators: table access, materialised steps, and vectorised tokenising.

Inside tasks text is handled as one byte buffer per slice of rows. A slice holds whole rows and about ``SLICE_BYTES``
bytes, so the numpy temporaries of a task stay bounded however many rows Arrow delivers at once.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from corpusloom.sources.shared import root

SLICE_BYTES = 2 << 20
BATCH_ROWS = 500
FILE_ROWS = 10_000
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    return root(spark)


def materialize(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and survives lost executors.

    ``rows`` tells about how many rows (or documents) stand behind it: shuffled partitions are then joined to one file
    for ``FILE_ROWS`` of them, but no fewer files than cores, so that small results don't become many small files.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS)))
    path = f"{shared_dir(spark).rstrip('/')}/corpusloom/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """At most ``rows`` rows reach Python at once in what is run inside; the session's own bound holds again after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def in_arrow(df: DataFrame, run, schema) -> DataFrame:
    """df.mapInArrow(run, schema), with the session's Arrow batches held to ``BATCH_ROWS`` rows from here on.

    A batch lies whole in the JVM and in the Python worker, and rows can be long texts; slices() joins small batches
    again. The setting is read when the plan runs, which may be long after this call, so it is lowered for good.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark = df.sparkSession
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))
    return df.mapInArrow(run, schema)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2] if len(column) else None
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, size: int = SLICE_BYTES) -> Iterator[pa.Table]:
    """Tables of whole rows with about ``size`` bytes of text each, small batches joined and large ones cut."""
    held: list[pa.RecordBatch] = []
    used = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(lengths)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + size - used, side="right")))
            held.append(batch.slice(start, stop - start))
            used += int(ends[stop - 1] - before)
            start = stop
            if used >= size or start < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, used = [], 0
    if held:
        yield pa.Table.from_batches(held)
    _powers.clear()  # workers live on after a task; what it no longer needs goes back
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


#: ASCII A-Z to a-z, other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of the space-separated kind: all but 0x20 and 0x09-0x0D.
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
#: Words of letters and digits (lower-cased ASCII) and of all bytes beyond ASCII.
LETTERS = np.zeros(256, bool)
LETTERS[0x30:0x3A] = LETTERS[0x61:0x7B] = LETTERS[0x80:] = True


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        grown = np.full(max(n, 1 << 16), base, np.uint64)
        grown[0] = 1
        _powers[base] = have = np.cumprod(grown)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the row it is in; words end at the end of their row."""
    inside = is_word[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    last = inside
    last = last.copy()
    last[:-1] &= ~inside[1:] | first[1:]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of values[start:end], alike wherever equal runs stand. values: unsigned integers."""
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values.astype(np.uint64) + np.uint64(1)) * powers(len(values)), out=sums[1:])
    back = powers(len(values) + 1, _INVERSE)[starts]
    return mix((sums[ends] - sums[starts]) * back + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def text_of(data: np.ndarray, start: int, end: int) -> bytes:
    return data[start:end].tobytes()


class Lookup:
    """Vectorised map from distinct 64-bit keys to their positions, by open addressing."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys
        bits = max(4, int(2 * max(1, len(keys)) - 1).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(_BASE)) >> self.shift).astype(np.int64)

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each wanted key, -1 where there is none."""
        at = self._home(wanted)
        found = self.slots[at]
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        todo = np.flatnonzero((found >= 0) & (self.keys[found] != wanted))
        while len(todo):
            at[todo] = (at[todo] + 1) & self.mask
            found[todo] = got = self.slots[at[todo]]
            todo = todo[(got >= 0) & (self.keys[got] != wanted[todo])]
        return found
