"""Benchmark decontamination with suffix arrays over the training text.

Every slice of the corpus is one shard: its words are put in suffix order, and every suffix of every benchmark item is
searched in it by bisection. The search gives the longest verbatim match of each suffix, and the range of the order
that holds all places of a window. The corpus is read once and not shuffled. The benchmark reaches the tasks in blocks
of at most ``BLOCK_BYTES`` of text, each its own broadcast: the driver gathers one block at a time. A task keeps the text of
all blocks, but the words and suffixes of one block at a time, made anew for every slice if there are several.

Words are runs of ASCII letters (lower-cased), digits and non-ASCII characters. They are compared by 64-bit hashes.

Nulls, empty texts and texts without words have no words and are clean; a null item, or one without words, matches
nothing. Repeated rows are judged each for itself. Empty tables give empty or clean results. Only the id and text
columns are read, so other columns can have any name.
"""

from __future__ import annotations

import hashlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LETTERS, LOWER, in_arrow, slices, span_hashes, utf8, word_bounds

BLOCK_BYTES = 8 << 20
REPORT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "longest_match long, match_start long, match_item string, item_ids array<string>"
)


def words_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all rows in a line, and the number of the row of each."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, row = word_bounds(data, offsets, LETTERS)
    return span_hashes(data, starts, ends), row


class Suffixes:
    """Suffix order of some rows of words, exact for the first ``depth`` words of each suffix."""

    def __init__(self, words: np.ndarray, row: np.ndarray, rows: int, depth: int):
        self.vocabulary, rank = np.unique(words, return_inverse=True)
        counts = np.bincount(row, minlength=rows)
        self.heads = np.concatenate([[0], np.cumsum(counts + 1)])  # one separator closes each row
        text = np.empty(len(words) + rows, np.int64)
        text[np.arange(len(words)) + row] = rank + rows
        text[self.heads[1:] - 1] = np.arange(rows)  # unlike each other and every word
        self.text, self.rows = text, rows
        self.order = self._sort(depth)

    def _sort(self, depth: int) -> np.ndarray:
        n = len(self.text)
        order = np.argsort(self.text, kind="stable")
        rank = np.empty(n + 1, np.int64)
        rank[n] = -1
        fresh = np.ones(n, bool)
        fresh[1:] = self.text[order[1:]] != self.text[order[:-1]]
        rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        length, tied = 1, np.arange(n)
        while length < depth:
            alone = np.append(fresh[1:], True) & fresh
            tied = tied[~alone]
            if not len(tied):
                break
            at = order[tied]
            own, after = rank[at], rank[np.minimum(at + length, n)]
            by = np.argsort(own * (n + 1) + after + 1)
            order[tied] = at = at[by]
            own, after = own[by], after[by]
            fresh = np.ones(len(tied), bool)
            fresh[1:] = (own[1:] != own[:-1]) | (after[1:] != after[:-1])
            rank[at] = np.maximum.accumulate(np.where(fresh, tied, 0))
            length *= 2
        return order

    def common(self, at: np.ndarray, query: np.ndarray, start: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each text suffix and query suffix, up to ``most`` words."""
        out = np.zeros(len(at), np.int64)
        live = np.flatnonzero(most > 0)
        while len(live):
            here = at[live] + out[live]
            same = (here < len(self.text)) & (self.text[np.minimum(here, len(self.text) - 1)] == query[start[live] + out[live]])
            live = live[same]
            out[live] += 1
            live = live[out[live] < most[live]]
        return out

    def bound(self, query: np.ndarray, start: np.ndarray, most: np.ndarray, above: bool) -> np.ndarray:
        """First place in the order at or above each query prefix; with ``above``, the first beyond its matches."""
        low, high = np.zeros(len(start), np.int64), np.full(len(start), len(self.order), np.int64)
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) // 2
            at = self.order[mid]
            n = self.common(at, query, start[live], most[live])
            end = n == most[live]
            word = self.text[np.minimum(at + n, len(self.text) - 1)]
            less = np.where(end, above, word < query[np.minimum(start[live] + n, len(query) - 1)])
            low[live[less]], high[live[~less]] = mid[less] + 1, mid[~less]
            live = live[low[live] < high[live]]
        return low

    def row_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.heads, at, side="right") - 1


class Items:
    """Benchmark items, ready to be searched: all their words in a line, and where each item's suffixes end."""

    def __init__(self, ids: list[str], column, window: int):
        self.ids = np.array(ids, dtype=object)
        self.words, self.item = words_of(column)
        counts = np.bincount(self.item, minlength=len(ids))
        ends = np.cumsum(counts)
        self.left = ends[self.item] - np.arange(len(self.words))  # words from each suffix to the end of its item
        self.window = np.minimum(window, counts[self.item])

    def search(self, shard: Suffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Longest match of every suffix, and all (suffix, place) pairs where a whole window matches."""
        place = np.searchsorted(shard.vocabulary, self.words)
        place = np.minimum(place, max(0, len(shard.vocabulary) - 1))
        known = shard.vocabulary[place] == self.words if len(shard.vocabulary) else np.zeros(len(self.words), bool)
        query = np.where(known, place + shard.rows, -2)
        every = np.flatnonzero(known)
        longest = np.zeros(len(self.words), np.int64)
        if not len(every):
            return longest, np.zeros(0, np.int64), np.zeros(0, np.int64)
        near = shard.bound(query, every, self.left[every], False)
        for step in (-1, 0):
            at = near + step
            good = np.flatnonzero((at >= 0) & (at < len(shard.order)))
            n = shard.common(shard.order[at[good]], query, every[good], self.left[every[good]])
            longest[every[good]] = np.maximum(longest[every[good]], n)
        whole = np.flatnonzero((longest >= self.window) & (self.left >= self.window))
        low, high = (shard.bound(query, whole, self.window[whole], above) for above in (False, True))
        each = np.repeat(np.arange(len(whole)), high - low)
        inner = np.arange(len(each)) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        self._query = query
        return longest, whole[each], shard.order[low[each] + inner]


class Benchmark:
    """Blocks of items as broadcasts, and the words of the longest item; a task indexes one block at a time."""

    def __init__(self, blocks: list, depth: int):
        self.blocks, self.depth, self._only = blocks, depth, None

    def indexes(self):
        if len(self.blocks) == 1:
            self._only = self._only or Items(*self.blocks[0].value)
            yield self._only
        else:
            for block in self.blocks:
                yield Items(*block.value)


def _benchmark(items: DataFrame, window: int, item_col: str, text_col: str, block_bytes: int) -> Benchmark:
    """The items in blocks of at most ``block_bytes`` of text (or one longer item)."""
    context = items.sparkSession.sparkContext
    rows = items.select(F.col(item_col).alias("o"), F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("i is not null and t is not null").orderBy("o", "t").select("i", "t")
    blocks, depth, ids, texts = [], 1, [], []

    def close():
        nonlocal depth
        column = pa.array(texts, pa.large_string())
        depth = max(depth, int(np.bincount(words_of(column)[1]).max(initial=0)))
        blocks.append(context.broadcast((list(ids), column, window)))

    used = 0
    for i, t in rows.toLocalIterator():
        ids.append(i)
        texts.append(t)
        used += len(t)
        if used >= block_bytes:
            close()
            ids, texts, used = [], [], 0
    if ids:
        close()
    return Benchmark(blocks, depth)


def contamination_report(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 13, hit_share: float = 0.05,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """One row per document: words, words inside benchmark windows, the items met, and the longest verbatim match.

    A window is ``window`` consecutive words of an item, or the whole of a shorter one. A document is contaminated if
    it has hit words and they are at least ``hit_share`` of its words.
    """
    items = _benchmark(benchmark, window, item_col, item_text_col, block_bytes)

    def scan(batches):
        for part in slices(batches, "text"):
            found = _judged(part["text"], items, hit_share)
            where = found["match_start"]
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part["doc_id"].combine_chunks(),
                    **{k: found[k] for k in ("n_words", "n_hit")},
                    "n_items": np.array([len(m) for m in found["item_ids"]], np.int64),
                    "items_sha256": [hashlib.sha256(",".join(m).encode()).hexdigest() for m in found["item_ids"]],
                    **{k: found[k] for k in ("contaminated", "longest_match")},
                    "match_start": pa.array(where, pa.int64(), mask=where < 0),
                    "match_item": pa.array(found["match_item"], pa.string()),
                    "item_ids": pa.array(found["item_ids"], pa.list_(pa.string())),
                }
            )

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), scan, REPORT)


def _judged(column, items: Benchmark, hit_share: float) -> dict:
    """Everything the report says of the rows of one shard."""
    share = Fraction(str(hit_share))
    words, row = words_of(column)
    rows = len(column)
    n_words = np.bincount(row, minlength=rows).astype(np.int64)
    shard = Suffixes(words, row, rows, items.depth)
    cover = np.zeros(len(shard.text) + 1, np.int64)
    met: list[set[str]] = [set() for _ in range(rows)]
    best, where, which = np.zeros(rows, np.int64), np.full(rows, -1), np.full(rows, None, object)
    for x in items.indexes():
        _, suffix, at = x.search(shard)
        if not len(at):
            continue
        np.add.at(cover, at, 1)
        np.add.at(cover, at + x.window[suffix], -1)
        doc = shard.row_of(at)
        for pair in np.unique(doc * len(x.ids) + x.item[suffix]).tolist():
            met[pair // len(x.ids)].add(x.ids[pair % len(x.ids)])
        n = shard.common(at, x._query, suffix, x.left[suffix])
        by = np.lexsort((x.item[suffix], at, -n, doc))  # ties: the earliest place, then the smallest item
        top = by[np.append(True, doc[by[1:]] != doc[by[:-1]])]
        d, place = doc[top], at[top] - shard.heads[doc[top]]
        better = (n[top] > best[d]) | (n[top] == best[d]) & (place < where[d])
        top, d = top[better], d[better]
        best[d], where[d], which[d] = n[top], at[top] - shard.heads[d], x.ids[x.item[suffix[top]]]
    hit = np.add.reduceat((np.cumsum(cover[:-1]) > 0).astype(np.int64), shard.heads[:-1])
    dirty = (hit > 0) & (share.denominator * hit >= share.numerator * n_words)
    return {"n_words": n_words, "n_hit": hit, "contaminated": dirty, "longest_match": best, "match_start": where, "match_item": which, "item_ids": [sorted(m) for m in met]}


def longest_matches(docs: DataFrame, benchmark: DataFrame, *, min_words: int = 5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The longest verbatim match of every benchmark suffix over all shards, of ``min_words`` words or more.

    Columns: item_id string, suffix_start (word in the item), n_words, doc_id. Ties go to the smallest doc_id.
    """
    items = _benchmark(benchmark, min_words, item_col, item_text_col, block_bytes)

    def scan(batches):
        for part in slices(batches, "text"):
            words, row = words_of(part["text"])
            shard = Suffixes(words, row, part.num_rows, items.depth)
            ids = part["doc_id"].to_numpy()
            for x in items.indexes():
                _, suffix, at = x.search(shard)
                n = shard.common(at, x._query, suffix, x.left[suffix]) if len(at) else at
                first = np.concatenate([[0], np.flatnonzero(np.diff(x.item)) + 1])
                start = suffix - first[np.searchsorted(first, suffix, side="right") - 1] if len(at) else at
                yield pa.RecordBatch.from_pydict({"item_id": pa.array(x.ids[x.item[suffix]], pa.string()), "suffix_start": start, "n_words": n, "doc_id": pa.array(ids[shard.row_of(at)], pa.int64())})

    found = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found = in_arrow(found, scan, "item_id string, suffix_start long, n_words long, doc_id long")
    best = F.max(F.struct("n_words", (-F.col("doc_id")).alias("o")))
    return found.groupBy("item_id", "suffix_start").agg(best.alias("b")).select("item_id", "suffix_start", "b.n_words", (-F.col("b.o")).alias("doc_id"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, window: int = 13, hit_share: float = 0.05,
    text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """The rows that are not contaminated, with all their columns, in one pass without a shuffle."""
    items = _benchmark(benchmark, window, item_col, item_text_col, block_bytes)

    def keep(batches):
        for part in slices(batches, text_col):
            yield from part.filter(pa.array(~_judged(part[text_col], items, hit_share)["contaminated"])).to_batches()

    return in_arrow(docs, keep, docs.schema)
