"""Removal of passages that repeat across documents, with compressed FM-indexes.

A window is ``window`` consecutive words. A word goes if it lies in a window whose words also start in a document with a
smaller doc_id. Comparing every document with the index of every shard would grow with the square of the corpus, so shards
are cut by content: each window has an anchor, the smallest hash of the ``GRAM``-word runs in it, and neighbouring windows
with one anchor are one segment. Equal windows have equal anchors, so all places of a window are in one shard.

1. Segments are summed by (anchor, content hash) to their smallest document. Copies of any number are one row from there.
   In all documents but the smallest, a repeated content goes as a whole.
2. Where an anchor has several contents, their windows may still be alike. Their words are fetched from the smallest documents, and each
   shard of them becomes an FM-index: a Burrows-Wheeler transform in a wavelet matrix of packed bit vectors with block ranks.
   Backward search streams all contents through it side by side; it reports the intervals whose matches of ``window``
   words or more occur in a smaller document (a range minimum over the suffix order).
3. An anchor with more than ``HOT`` contents, as in passages that very many documents share, is not indexed in one task:
   its windows are summed by their hash instead, with the same result.
4. The intervals of each document are joined with its text, which is read again, and cut out.

Words are compared by 64-bit hashes. Nulls and empty texts have no words; texts shorter than a window lose none. Rows with the same
doc_id count as one document, so repeated rows do not repeat each other, but each reports its own text; rows with a null doc_id
neither lose nor cause anything. Empty tables give empty results. Columns besides id and text are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACED, in_arrow, materialize, slices, span_hashes, utf8, word_bounds
from corpusloom.llm.decontaminate import Suffixes

WINDOW, GRAM, HOT, SHARD_WORDS = 50, 6, 2_000, 400_000
_STEP = 256


class FmIndex:
    """FM-index over some rows of words, with the smallest document of every suffix range."""

    def __init__(self, words: np.ndarray, row: np.ndarray, rows: int, owner: np.ndarray):
        shard = Suffixes(words, row, rows, 1 << 40)
        text, order = shard.text, shard.order
        n = len(text)
        code = np.maximum(text - rows + 1, 0)  # separators are 0
        self.codes, self.heads = code, shard.heads
        self.size = int(code.max(initial=0)) + 1
        self.first = rows + np.searchsorted(np.sort(code[code > 0]), np.arange(self.size))  # suffixes before those of a word
        symbols = code[order - 1]
        symbols[order == 0] = 0
        self.bits = max(1, (self.size - 1).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            bit = ((symbols >> b) & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-n % 64 + 64, bool)), bitorder="little").view(np.uint64)
            ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)[:-1]]).astype(np.int32)
            zeros = int(n - bit.sum())
            self.levels.append((b, packed, ranks, zeros))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])
        every = np.arange(self.size)
        self.bottom = self._down(every, np.zeros(self.size, np.int64))
        table = [owner[shard.row_of(order)].astype(np.int32)]
        while 2 << (len(table) - 1) <= n:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))
        self.least = table

    def _down(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for b, packed, ranks, zeros in self.levels:
            word = at >> 6
            ones = ranks[word] + np.bitwise_count(packed[word] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1))).astype(np.int64)
            at = np.where((code >> b) & 1 == 1, zeros + ones, at - ones)
        return at

    def extend(self, code: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix ranges of the patterns with one more word before them."""
        both = self._down(np.concatenate([code, code]), np.concatenate([low, high])) + np.concatenate([self.first[code] - self.bottom[code]] * 2)
        return both[: len(code)], both[len(code) :]

    def smallest(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Smallest owner in each range; ranges are not empty."""
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int32)
        for k in np.unique(level):
            at = np.flatnonzero(level == k)
            out[at] = np.minimum(self.least[k][low[at]], self.least[k][high[at] - (1 << k)])
        return out

    def repeated(self, rows: np.ndarray, owner: np.ndarray, window: int) -> list[np.ndarray]:
        """For each row, which of its windows also stand in a row with a smaller owner."""
        counts = self.heads[rows + 1] - 1 - self.heads[rows] - window + 1
        base = np.concatenate([[0], np.cumsum(counts)])
        found = np.zeros(base[-1], bool)
        n, start = len(rows), self.heads[rows]
        at, step = np.zeros(n, np.int64), np.ones(n, np.int64)
        left = step + window - 1  # words of the pattern still to be read
        low, high = np.zeros(n, np.int64), np.full(n, len(self.codes))
        live = np.flatnonzero(counts > 0)
        while len(live):
            spot = at[live] + left[live] - 1
            lo, hi = self.extend(self.codes[start[live] + spot], low[live], high[live])
            good = hi > lo
            good[good] = self.smallest(lo[good], hi[good]) < owner[live[good]]
            low[live], high[live] = lo, hi
            left[live[good]] -= 1
            bad = live[~good]
            # A short pattern that fails at a word rules out all windows up to that word; a long one is tried shorter.
            short = step[bad] == 1
            at[bad] += np.where(short, left[bad], 0)
            full = live[good & (left[live] == 0)]
            if len(full):
                each = np.repeat(full, step[full])
                inner = np.arange(len(each)) - np.repeat(np.cumsum(step[full]) - step[full], step[full])
                found[base[each] + at[each] + inner] = True
                at[full] += step[full]
            step[full] = np.minimum(step[full] * 2, _STEP)
            step[bad] = np.where(short, 1, step[bad] // 4).clip(1)
            anew = np.concatenate([bad, full])
            step[anew] = np.minimum(step[anew], np.maximum(counts[anew] - at[anew], 1))
            left[anew] = step[anew] + window - 1
            low[anew], high[anew] = 0, len(self.codes)
            live = live[at[live] < counts[live]]
        return [found[base[i] : base[i + 1]] for i in range(n)]


def _hashed_words(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of all rows, and the first and last place of each row in them."""
    data, offsets = utf8(column)
    starts, ends, row = word_bounds(data, offsets, SPACED)
    counts = np.bincount(row, minlength=len(offsets) - 1)
    stop = np.cumsum(counts)
    return span_hashes(data, starts, ends), stop - counts, stop


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` neighbours."""
    out, reach = values, 1
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(out) - (width - reach)], out[width - reach :]) if width > reach else out


def _segments(window: int):
    def run(batches):
        for part in slices(batches, "text"):
            words, first, stop = _hashed_words(part["text"])
            if len(words) < window:
                continue
            grams = span_hashes(words, np.arange(len(words) - GRAM + 1), np.arange(len(words) - GRAM + 1) + GRAM)
            anchor = _sliding_least(grams, window - GRAM + 1)  # of the window that starts at each word
            row = np.repeat(np.arange(len(first)), np.maximum(stop - first - window + 1, 0))
            at = first[row] + np.arange(len(row)) - np.searchsorted(row, row)
            if not len(at):
                continue
            value = anchor[at]
            heads = np.flatnonzero(np.append(True, (value[1:] != value[:-1]) | (row[1:] != row[:-1])))
            count = np.diff(np.append(heads, len(at)))
            start = at[heads]
            content = span_hashes(words, start, start + count + window - 1)
            own = pa.array(row[heads])
            yield pa.RecordBatch.from_pydict(
                {
                    "anchor": value[heads].view(np.int64), "content": content.view(np.int64), "doc_id": part["doc_id"].combine_chunks().take(own),
                    "text_key": part["text_key"].combine_chunks().take(own), "start": (start - first[row[heads]]).astype(np.int32), "n": count.astype(np.int32),
                }
            )

    return run


def _fetched(window: int):
    """The word hashes of the wanted segments of each row."""

    def run(batches):
        for part in slices(batches, "text"):
            words, first, _ = _hashed_words(part["text"])
            out = {"anchor": [], "content": [], "doc_id": [], "words": []}
            for f, doc, wanted in zip(first, part["doc_id"].to_pylist(), part["wanted"].to_pylist(), strict=True):
                for w in wanted:
                    out["anchor"].append(w["anchor"])
                    out["content"].append(w["content"])
                    out["doc_id"].append(doc)
                    out["words"].append(words[f + w["start"] : f + w["start"] + w["n"] + window - 1].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["anchor"], pa.int64()), pa.array(out["content"], pa.int64()), pa.array(out["doc_id"], pa.int64()), pa.array(out["words"], pa.binary())], list(out))

    return run


_RUNS = "anchor long, content long, runs array<struct<s:int,e:int>>"


def _runs(flags: np.ndarray, window: int) -> list[dict]:
    """Word intervals of the windows that are flagged."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8)))
    return [{"s": int(a), "e": int(b) + window - 1} for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _indexed(window: int):
    def run(key, table):
        words = [np.frombuffer(w, np.uint64) for w in table["words"].to_pylist()]
        row = np.repeat(np.arange(len(words)), [len(w) for w in words])
        _, owner = np.unique(table["doc_id"].to_numpy(), return_inverse=True)
        index = FmIndex(np.concatenate(words), row, len(words), owner)
        flags = index.repeated(np.arange(len(words)), owner, window)
        runs = [_runs(f, window) for f in flags]
        keep = pa.array([bool(r) for r in runs])
        kind = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
        return pa.table([table["anchor"], table["content"], pa.array(runs, kind)], names=["anchor", "content", "runs"]).filter(keep)

    return run


def _window_hashes(window: int):
    def run(batches):
        for batch in batches:
            for a, c, d, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                words = np.frombuffer(raw, np.uint64)
                at = np.arange(len(words) - window + 1)
                n = len(at)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, a)), pa.array(np.full(n, c)), pa.array(np.full(n, d)), pa.array(at.astype(np.int32)), pa.array(span_hashes(words, at, at + window).view(np.int64))], ["anchor", "content", "doc_id", "at", "hash"])

    return run


def repeated_intervals(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key (a hash of the text) and intervals (word positions s to e) of every row that repeats a smaller document."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id is not null and text is not null")
    rows = rows.withColumn("text_key", F.xxhash64("text"))
    segments = materialize(in_arrow(rows, _segments(window), "anchor long, content long, doc_id long, text_key long, start int, n int"))
    place = F.struct("doc_id", "text_key", "start", "n")
    contents = segments.groupBy("anchor", "content").agg(F.min(place).alias("at"), F.max("doc_id").alias("last"))
    contents = contents.select("anchor", "content", "at.*", "last")
    anchors = contents.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("last").alias("hi"), F.count("*").alias("kinds")).where("lo < hi")
    contents = materialize(contents.join(anchors.select("anchor", "kinds"), "anchor"))
    open_ = contents.where("kinds > 1")
    wanted = open_.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("anchor", "content", "start", "n")).alias("wanted"))
    kinds = open_.select("anchor", "kinds").distinct()
    texts = rows.join(wanted, ["doc_id", "text_key"]).select("doc_id", "text", "wanted")
    # Rows may repeat, so a content may be fetched more than once; one is enough.
    fetched = in_arrow(texts, _fetched(window), "anchor long, content long, doc_id long, words binary").dropDuplicates(["anchor", "content"])
    fetched = materialize(fetched.join(kinds, "anchor"))
    size = fetched.agg(F.sum(F.length("words") / 8)).first()[0] or 0
    shards = max(1, int(size // SHARD_WORDS))
    cold = fetched.where(f"kinds <= {HOT}").select("anchor", "content", "doc_id", "words", F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard"))
    found = cold.groupBy("shard").applyInArrow(_indexed(window), _RUNS)
    hot = fetched.where(f"kinds > {HOT}").select("anchor", "content", "doc_id", "words")
    each = in_arrow(hot, _window_hashes(window), "anchor long, content long, doc_id long, at int, hash long")
    least = each.groupBy("hash").agg(F.min("doc_id").alias("least"), F.count("*").alias("k")).where("k > 1").select("hash", "least")
    again = each.join(least, "hash").where("least < doc_id").groupBy("anchor", "content").agg(F.collect_list(F.struct(F.col("at").alias("s"), (F.col("at") + window).cast("int").alias("e"))).alias("runs"))
    runs = found.union(again.select("anchor", "content", "runs"))
    marked = contents.where("last > doc_id").select("anchor", "content", F.col("doc_id").alias("least"))
    marked = marked.join(runs, ["anchor", "content"], "full").select("anchor", "content", "least", "runs")
    whole = F.array(F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") + (window - 1)).cast("int").alias("e")))
    part = F.transform("runs", lambda r: F.struct((r["s"] + F.col("start")).alias("s"), (r["e"] + F.col("start")).alias("e")))
    hit = segments.join(marked, ["anchor", "content"]).withColumn("cut", F.when(F.col("doc_id") > F.col("least"), whole).otherwise(part)).where("cut is not null")
    return hit.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("cut")).alias("intervals"))


def _kept(part: pa.Table, text_column: str, cut_column: str) -> tuple[list[np.ndarray], list[list[bytes]]]:
    """Per row which words stay and all its words."""
    keep, words = [], []
    for text, cuts in zip(part[text_column].to_pylist(), part[cut_column].to_pylist(), strict=True):
        own = [w for w in (text or "").encode().translate(_AS_SPACE).split(b" ") if w]
        change = np.zeros(len(own) + 1, np.int64)
        for c in cuts or ():
            change[c["s"]] += 1
            change[c["e"]] -= 1
        keep.append(np.cumsum(change[:-1]) == 0)
        words.append(own)
    return keep, words


_AS_SPACE = bytes(32 if b in (9, 10, 11, 12, 13) else b for b in range(256))


def _joined(docs: DataFrame, window: int, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    """docs with the intervals to cut in one more column, and the name of it, which no column of docs has."""
    taken = {c.lower() for c in docs.columns}
    mark = "_" * next(k for k in range(2, len(taken) + 3) if not any("_" * k + x in taken for x in ("id", "key", "cuts")))
    cuts = repeated_intervals(docs, window=window, id_col=id_col, text_col=text_col)
    cuts = cuts.select(F.col("doc_id").alias(f"{mark}id"), F.col("text_key").alias(f"{mark}key"), F.col("intervals").alias(f"{mark}cuts"))
    joined = docs.join(cuts, (docs[id_col].cast("long") == F.col(f"{mark}id")) & (F.xxhash64(docs[text_col]) == F.col(f"{mark}key")), "left")
    return joined.drop(f"{mark}id", f"{mark}key"), f"{mark}cuts"


def repeated_report(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (of the kept words, joined by single spaces) of every row."""

    def run(batches):
        for part in slices(batches, "text"):
            keep, words = _kept(part, "text", cut_column)
            kept = [b" ".join(w for w, k in zip(own, mask.tolist(), strict=True) if k) if not mask.all() else b" ".join(own) for own, mask in zip(words, keep, strict=True)]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part["doc_id"].combine_chunks(), "n_words": pa.array([len(w) for w in words], pa.int64()),
                    "n_removed": pa.array([int((~k).sum()) for k in keep], pa.int64()), "kept_sha256": [hashlib.sha256(k).hexdigest() for k in kept],
                }
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    joined, cut_column = _joined(rows, window, "doc_id", "text")
    return in_arrow(joined, run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(docs: DataFrame, *, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all their columns; a text that repeats passages keeps its other words, joined by single spaces."""
    fields = docs.schema

    def run(batches):
        for part in slices(batches, text_col):
            keep, words = _kept(part, text_col, cut_column)
            old = part[text_col].to_pylist()
            new = [t if m.all() else b" ".join(w for w, k in zip(own, m.tolist(), strict=True) if k).decode() for t, own, m in zip(old, words, keep, strict=True)]
            at = part.schema.get_field_index(text_col)
            yield from part.set_column(at, text_col, pa.array(new, part.schema.field(text_col).type)).drop_columns([cut_column]).to_batches()

    joined, cut_column = _joined(docs, window, id_col, text_col)
    return in_arrow(joined.select(*[F.col(f"`{c}`") for c in docs.columns], cut_column), run, fields)
