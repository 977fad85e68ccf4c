r"""Phrase collocation mining: frequent phrases scored by their weakest cut.

Texts (A-Z lower-cased) are cut at ``[.,;:!?\x0A-\x0D]`` into pieces and those at spaces and tabs into words. Everything is per
language. A phrase has 2 to ``LONGEST`` words inside a piece and ``least`` occurrences, overlaps included.

1. Candidates. Three scans sum 64-bit hashes of words, of pairs of frequent words, and of longer phrases whose pairs are all
   frequent (Apriori: no phrase is more frequent than a part of it). What is frequent is sent as a bit table of bounded size
   (``MOST_BITS``); a table that fills up lets more candidates through and loses none. Sums are made in the tasks first, so a
   hot word is one row of a task.
2. Counts. Candidates come in blocks of about ``block`` keys, whatever their number. A block gets a minimal perfect hash with
   its keys stored by slot. Tasks look up their phrases, check the stored key, and count slots with bincount into one array;
   the arrays are summed as a tree over segments of slots, ``WIDTH`` at a time. The text of a phrase comes from the first
   partition that had it in the scans before. So memory is bounded by the block, and a block costs one scan: work grows as
   corpus times blocks where candidates outgrow one block.
3. Cuts. Each candidate looks its parts up in the perfect hash of their block and reads their counts by slot.

Odd rows: a null language is ``und``; null and empty texts have no words; ids are not read; repeated rows count each time;
an empty table gives no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, in_arrow, materialize, mix, slices, span_hashes, utf8, word_bounds

LEAST, LONGEST, TOP, COVER_PERCENT = 30, 4, 2000, 80
BLOCK, MOST_BITS, SEGMENT, WIDTH, HELD, SHARES = 1 << 22, 28, 4096, 32, 1 << 21, 64
UNKNOWN, NONE, ANY = "und", -1, -2
_FACTORS = np.random.default_rng(71_993).integers(1, 1 << 63, 2 * LONGEST + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LEVELS = np.arange(1, 129, dtype=np.uint64) * _FACTORS[0]
_WORD, _SPLIT = np.ones(256, bool), np.zeros(256, bool)
_SPLIT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_WORD[[0x20, 0x09]] = False
_WORD &= ~_SPLIT


def _language_hash(name: str) -> int:
    return int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "little")


class Words:
    """The words of a slice of rows (lang, text), and the keys of phrases of any order at each word."""

    def __init__(self, texts, langs):
        data, offsets = utf8(texts)
        self.data = LOWER[data]
        self.starts, self.ends, row = word_bounds(self.data, offsets, _WORD)
        split = np.cumsum(_SPLIT[self.data], dtype=np.int64)
        n = len(self.starts)
        self.joined = np.zeros(n, bool)  # a word with the one after it
        if n > 1:
            self.joined[:-1] = (row[1:] == row[:-1]) & (split[self.starts[1:]] == split[self.ends[:-1] - 1])
        coded = pa.chunked_array([langs]) if isinstance(langs, pa.Array) else langs
        coded = coded.fill_null(UNKNOWN).combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.langs = coded.dictionary.to_pylist()
        self.lang = coded.indices.to_numpy()[row]
        seeds = np.array([_language_hash(x) for x in self.langs] or [0], np.uint64)
        self.seed = seeds[self.lang]
        self.hashes = span_hashes(self.data, self.starts, self.ends)

    def at(self, order: int) -> np.ndarray:
        """Where phrases of so many words begin."""
        n = len(self.starts) - order + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        fits = np.ones(n, bool)
        for k in range(order - 1):
            fits &= self.joined[k : k + n]
        return np.flatnonzero(fits)

    def keys(self, order: int, at: np.ndarray) -> np.ndarray:
        total = self.seed[at] * _FACTORS[order]
        for k in range(order):
            total += self.hashes[at + k] * _FACTORS[LONGEST + 1 + k]
        return mix(total)

    def phrase(self, at: int, order: int) -> bytes:
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[at : at + order], self.ends[at : at + order], strict=True))


class BitTable:
    """Keys by their leading bits: holds every key that was put in, and some others."""

    def __init__(self, words: np.ndarray):
        self.words = words
        self.shift = np.uint64(64 - int(len(words) * 64).bit_length() + 1)

    @classmethod
    def of(cls, keys: DataFrame) -> BitTable:
        bits = min(MOST_BITS, max(16, int(keys.count() * 32).bit_length()))
        bit = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("bit"))
        rows = bit.selectExpr("bit >> 6 as word", "shiftleft(1L, cast(bit & 63 as int)) as bits").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
        words = np.zeros(1 << (bits - 6), np.uint64)
        words[rows["word"].to_numpy()] = rows["bits"].to_numpy().view(np.uint64)
        return cls(words)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        bit = keys >> self.shift
        return (self.words[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) != 0


class PerfectHash:
    """Slots 0 .. n-1 for n distinct keys: levels of bits, a key standing at the first level where it is alone; slot = rank."""

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        self.stored = np.zeros(len(keys), np.uint64)
        before, left = 0, keys
        while len(left):
            size = 64 * max(1, -(-2 * len(left) // 64))
            at = self._spread(left, _LEVELS[len(self.levels)], size)
            alone = np.bincount(at, minlength=size) == 1
            words = np.packbits(alone, bitorder="little").view(np.uint64)
            ranks = before + np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)[:-1]])
            self.levels.append((size, words, ranks))
            placed = alone[at]
            self.stored[self._rank(at[placed], words, ranks)] = left[placed]
            before += int(placed.sum())
            left = left[~placed]

    @staticmethod
    def _spread(keys: np.ndarray, level: np.uint64, size: int) -> np.ndarray:
        return (((mix(keys + level) >> np.uint64(32)) * np.uint64(size)) >> np.uint64(32)).astype(np.int64)

    @staticmethod
    def _rank(at: np.ndarray, words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return ranks[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def __call__(self, wanted: np.ndarray) -> np.ndarray:
        """Slot of each key, -1 for keys that are not stored."""
        slots, todo = np.full(len(wanted), -1, np.int64), np.arange(len(wanted))
        for k, (size, words, ranks) in enumerate(self.levels):
            at = self._spread(wanted[todo], _LEVELS[k], size)
            hit = (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0
            slots[todo[hit]] = self._rank(at[hit], words, ranks)
            todo = todo[~hit]
            if not len(todo):
                break
        found = np.flatnonzero(slots >= 0)
        slots[found[self.stored[slots[found]] != wanted[found]]] = -1
        return slots


def _sums(docs: DataFrame, orders: tuple[int, ...], parts, least: int) -> DataFrame:
    """(key, part) of phrases of these orders with at least ``least`` occurrences; all their pairs (words, for pairs) stand in the bit table ``parts``.

    part: the first partition of the scan that has the phrase.
    """
    part_order = min(2, min(orders) - 1)

    def emit(held):
        keys, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "n": n.astype(np.int64), "part": np.full(len(keys), TaskContext.get().partitionId(), np.int32)})

    def run(batches) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for part in slices(batches, "text"):
            words = Words(part["text"], part["lang"])
            safe = None
            if part_order:
                safe, at = np.zeros(len(words.starts), bool), words.at(part_order)
                safe[at[parts.value(words.keys(part_order, at))]] = True
            for order in orders:
                at = words.at(order)
                for k in range(order - part_order + 1 if part_order else 0):
                    at = at[safe[at + k]]
                held.append(words.keys(order, at))
                size += len(at)
            if size >= HELD:
                yield emit(held)
                held, size = [], 0
        if size:
            yield emit(held)

    sums = in_arrow(docs, run, "key long, n long, part int").groupBy("key").agg(F.sum("n").alias("n"), F.min("part").alias("part"))
    return sums.where(F.col("n") >= least).select("key", "part")


def candidate_keys(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """(key, part) of all words (part -1) and phrases that can have ``least`` occurrences."""
    spark = docs.sparkSession
    words = materialize(_sums(docs, (1,), None, least))
    pairs = materialize(_sums(docs, (2,), spark.sparkContext.broadcast(BitTable.of(words)), least))
    longer = materialize(_sums(docs, tuple(range(3, LONGEST + 1)), spark.sparkContext.broadcast(BitTable.of(pairs)), least))
    return words.withColumn("part", F.lit(-1)).union(pairs).union(longer)


def _in_block(blocks: int, block: int):
    return F.shiftrightunsigned(F.shiftrightunsigned("key", 32) * blocks, 32) == block


def _slots(keys: DataFrame, hashed) -> DataFrame:
    def run(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"slot": hashed.value(batch["key"].to_numpy().view(np.uint64)), "key": batch["key"], "part": batch["part"]})

    return keys.mapInArrow(run, "slot long, key long, part int")


def _counted(docs: DataFrame, hashed, owners) -> DataFrame:
    """Of one block: rows (segment, part, counts), (slot, lang, phrase) and (lang, counts of one number, all words).

    A phrase is given by the partition that owns its slot, or by all that have it where the owner is ANY.
    """
    schema = "segment int, part int, counts array<long>, slot int, lang string, phrase string"

    def run(batches) -> Iterator[pa.RecordBatch]:
        find, part_id = hashed.value, TaskContext.get().partitionId()
        counts = np.zeros(-(-max(1, len(find.stored)) // SEGMENT) * SEGMENT, np.int64)
        seen, totals = (owners.value != part_id) & (owners.value != ANY), {}
        for part in slices(batches, "text"):
            words = Words(part["text"], part["lang"])
            for lang, n in zip(words.langs, np.bincount(words.lang, minlength=len(words.langs)), strict=False):
                totals[lang] = totals.get(lang, 0) + int(n)
            new = []
            for order in range(1, LONGEST + 1):
                at = words.at(order)
                slots = find(words.keys(order, at))
                at, slots = at[slots >= 0], slots[slots >= 0]
                counts += np.bincount(slots, minlength=len(counts))
                if order > 1:
                    first, where = np.unique(slots, return_index=True)
                    fresh = ~seen[first]
                    seen[first] = True
                    new += [(int(s), words.langs[words.lang[at[w]]], words.phrase(at[w], order)) for s, w in zip(first[fresh], where[fresh], strict=True)]
            if new:
                slot, lang, phrase = zip(*new, strict=True)
                yield _rows(len(new), slot=pa.array(slot, pa.int32()), lang=pa.array(lang), phrase=pa.array(phrase, pa.binary()).cast(pa.string()))
        if totals:
            yield _rows(len(totals), lang=pa.array(list(totals), pa.string()), counts=pa.array([[n] for n in totals.values()], pa.list_(pa.int64())))
        used = np.flatnonzero(counts.reshape(-1, SEGMENT).any(axis=1))
        for k in range(0, len(used), 64):
            some = used[k : k + 64]
            packed = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * SEGMENT), pa.array(counts.reshape(-1, SEGMENT)[some].ravel()))
            yield _rows(len(some), segment=pa.array(some, pa.int32()), part=pa.array([part_id] * len(some), pa.int32()), counts=packed)

    def _rows(n: int, **columns) -> pa.RecordBatch:
        kinds = (("segment", pa.int32()), ("part", pa.int32()), ("counts", pa.list_(pa.int64())), ("slot", pa.int32()), ("lang", pa.string()), ("phrase", pa.string()))
        return pa.RecordBatch.from_arrays([columns.get(name, pa.nulls(n, kind)) for name, kind in kinds], [name for name, _ in kinds])

    return in_arrow(docs, run, schema)


def tree_sum(rows: DataFrame) -> DataFrame:
    """(segment, counts) from (segment, part, counts), at most WIDTH arrays of a segment at a time."""

    def add(group: pa.Table) -> pa.Table:
        total = group["counts"].combine_chunks().flatten().to_numpy().reshape(group.num_rows, -1).sum(axis=0)
        return pa.table({"segment": group["segment"][:1], "part": pa.array([group["part"][0].as_py() // WIDTH], pa.int32()), "counts": pa.array([total], pa.list_(pa.int64()))})

    last = rows.agg(F.max("part")).first()[0] or 0
    while True:
        rows = rows.groupBy("segment", (F.col("part") / WIDTH).cast("int").alias("of")).applyInArrow(add, "segment int, part int, counts array<long>")
        last //= WIDTH
        if not last:
            return rows.select("segment", "counts")


def _parts(order: int) -> list[tuple[int, int]]:
    """(first word, words) of the contiguous parts of a phrase, shortest first."""
    return [(i, m) for m in range(1, order) for i in range(order - m + 1)]


def _with_parts(rows: DataFrame, hashed, counts, block: int) -> DataFrame:
    """Fill in the counts (part_counts) and places (part_slots) of those parts of each phrase that are in this block."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        find, number = hashed.value, counts.value
        for batch in batches:
            words = Words(batch["phrase"], batch["lang"])
            per_row = np.array([p.count(" ") + 1 for p in batch["phrase"].to_pylist()], np.int64)
            first = np.cumsum(per_row) - per_row
            got, at = ([list(x) for x in batch[c].to_pylist()] for c in ("part_counts", "part_slots"))
            for order in range(2, LONGEST + 1):
                of = np.flatnonzero(per_row == order)
                for k, (i, m) in enumerate(_parts(order)):
                    slots = find(words.keys(m, first[of] + i))
                    for row, slot in zip(of[slots >= 0], slots[slots >= 0], strict=True):
                        got[row][k], at[row][k] = int(number[slot]), (block << 32) + int(slot)
            columns = {name: batch[name] for name in batch.schema.names}
            columns["part_counts"], columns["part_slots"] = pa.array(got, pa.list_(pa.int64())), pa.array(at, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_pydict(columns)

    return in_arrow(rows, run, rows.schema)


def _phrases(rows: DataFrame) -> DataFrame:
    return rows.where("phrase is not null").groupBy(F.col("slot").cast("long").alias("slot")).agg(F.min("lang").alias("lang"), F.min("phrase").alias("phrase"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, block: int = BLOCK) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases by their lowest-scoring cut."""
    spark = docs.sparkSession
    docs = docs.select("lang", "text")
    keys = candidate_keys(docs, least)
    blocks = max(1, -(-keys.count() // block))
    send = spark.sparkContext.broadcast
    tables, found, totals = [], [], None
    for b in range(blocks):
        mine = keys.where(_in_block(blocks, b)).toArrow()
        hashed = PerfectHash(np.unique(mine["key"].to_numpy().view(np.uint64)))
        owners = np.full(len(hashed.stored), NONE, np.int32)
        owners[hashed(mine["key"].to_numpy().view(np.uint64))] = mine["part"].to_numpy()
        hashed = send(hashed)
        rows = materialize(_counted(docs, hashed, send(owners)))
        if b == 0:
            totals = rows.where("phrase is null and segment is null").groupBy("lang").agg(F.sum(F.col("counts")[0]).alias("n"))
        summed = tree_sum(rows.where("segment is not null").select("segment", "part", "counts"))
        counts = summed.select("segment", F.posexplode("counts")).select((F.col("segment").cast("long") * SEGMENT + F.col("pos")).alias("slot"), F.col("col").alias("a")).where("a > 0")
        tables.append(materialize(_slots(keys.where(_in_block(blocks, b)), hashed).join(counts, "slot")))
        phrases = _phrases(rows)
        wanted = tables[-1].where((F.col("part") != NONE) & (F.col("a") >= least))
        lost = wanted.join(phrases, "slot", "left_anti").select("slot").toArrow()["slot"].to_numpy()
        if len(lost):  # the second scan was cut otherwise than the first, so owners did not meet their phrases
            owners[:], owners[lost] = NONE, ANY
            phrases = phrases.union(_phrases(materialize(_counted(docs, hashed, send(owners)))))
        found.append(phrases.join(wanted, "slot").select((F.lit(b << 32) + F.col("slot")).alias("slot"), "lang", "phrase", "a"))
    rows = found[0]
    for more in found[1:]:
        rows = rows.union(more)
    size = F.size(F.split("phrase", " "))
    none = F.array_repeat(F.lit(-1).cast("long"), F.when(size == 2, 2).when(size == 3, 5).otherwise(9))
    rows = materialize(rows.withColumn("part_counts", none).withColumn("part_slots", none))
    for b, known in enumerate(tables):
        known = known.toArrow()
        hashed = PerfectHash(known["key"].to_numpy().view(np.uint64))
        number = np.zeros(len(hashed.stored), np.int64)
        number[hashed(known["key"].to_numpy().view(np.uint64))] = known["a"].to_numpy()
        rows = materialize(_with_parts(rows, send(hashed), send(number), b))
    return _ranked(rows, totals, top)


def _ranked(rows: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    """Drop phrases that a longer one covers, and rank the others."""
    size = F.size(F.split("phrase", " "))

    def cut(order: int, k: int):
        parts = _parts(order)
        left, right = F.col("part_counts")[parts.index((0, k))], F.col("part_counts")[parts.index((k, order - k))]
        return F.struct(left.alias("l"), right.alias("r"), F.lit(k).alias("k"))

    cuts = F.when(size == 2, F.array(cut(2, 1)))
    for order in range(3, LONGEST + 1):
        cuts = cuts.when(size == order, F.array(*[cut(order, k) for k in range(1, order)]))
    rows = rows.withColumn("cuts", cuts)
    scored = F.expr("transform(cuts, c -> named_struct('score', (cast(a as decimal(20,0)) * 2000000) div cast(c.l + c.r as decimal(20,0)), 'k', c.k, 'l', c.l, 'r', c.r))")
    best = rows.withColumn("best", F.array_min(scored)).select("slot", "lang", "phrase", "a", "best.l", "best.r", "best.score")
    inner = F.expr("filter(transform(part_slots, (s, i) -> named_struct('slot', s, 'f', part_counts[i], 'i', i)), p -> p.slot >= 0 and p.i >= size(split(phrase, ' ')))")
    longer = rows.where(size > 2).select("a", F.explode(inner).alias("p")).where(F.col("a") * 100 >= F.col("p.f") * COVER_PERCENT)
    kept = best.join(longer.select("p.slot").distinct(), "slot", "left_anti")
    best_of = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # the best of a language are among the best of each of its shares, so no task gets all phrases of one language
    shares = kept.withColumn("share", F.pmod("slot", F.lit(SHARES))).withColumn("rank", best_of("lang", "share")).where(F.col("rank") <= top)
    ranked = shares.withColumn("rank", best_of("lang")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
