"""Language-model scores by context-tree weighting over bytes, with a word-count baseline.

A text is its words, each closed by a space, and one end mark. Every byte is eight binary decisions; a decision's node in
the context tree of depth ``DEPTH`` (bytes before it) keeps a Krichevsky-Trofimov estimate, and the estimates of all
depths are mixed with the weights of context-tree weighting. The tree is learned from the training rows and then
fixed. A node that training never reached leaves the decision to the depths above it.

Neither tree nor word counts are ever in one place. Tasks cut the rows into blocks and send, per block, their distinct byte
grams and words with training counts to shards (grams by their two latest context bytes, so a shard holds whole
subtrees). Shards are summed in a tree of merges, compute their weights, and answer each block with the log-probability
of its grams and the counts of its words; blocks then add up their rows. Work and traffic grow with the distinct grams
and words of the blocks. Only depths 0 and 1 pass through the driver: at most 65,280 rows.

Null and empty texts are just the end mark. Rows whose held-out flag is null count as held out. Repeated rows count, and are
scored, each for itself. Without training rows all probabilities are even. Columns besides id, text and flag are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, SPACED, in_arrow, Lookup, materialize, mix, partitions, slices, span_hashes, utf8, word_bounds

DEPTH = 5
BLOCK_BYTES, FAN, GROUP, MOST_SHARDS = 6 << 20, 64, 256, 512
END = np.uint64(0x5EED_0F_E17D)  # key of the end mark among the words
_PAD = b" " + b"\n" * DEPTH
_WORDS, _GRAMS = 0, 1
_STATS = "kind int, shard int, block long, n long, keys binary, counts binary"


def _pack(values: np.ndarray, ascending: bool = False) -> bytes:
    """64-bit integers as compressed byte planes, of differences if ascending."""
    values = np.ascontiguousarray(values).view(np.uint64)
    if ascending and len(values):
        values = np.concatenate([values[:1], values[1:] - values[:-1]])
    return pa.compress(values.view(np.uint8).reshape(-1, 8).T.tobytes(), "zstd", asbytes=True) if len(values) else b""


def _unpack(raw: bytes, n: int, ascending: bool = False) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw, n * 8, "zstd", asbytes=True), np.uint8).reshape(8, n)
    values = np.ascontiguousarray(planes.T).reshape(-1).view(np.uint64)
    return np.cumsum(values, dtype=np.uint64) if ascending else values


class Block:
    """Words and byte grams of some rows."""

    def __init__(self, column):
        data, offsets = utf8(column)
        rows = len(offsets) - 1
        joined = data.tobytes()
        buffer = b"\n" * DEPTH + _PAD.join([joined[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]) + _PAD
        buffer = LOWER[np.frombuffer(buffer, np.uint8)]
        ends = DEPTH + offsets[1:] + len(_PAD) * np.arange(rows)  # where each row's closing pad begins
        begins = DEPTH + offsets[:-1] + len(_PAD) * np.arange(rows)
        starts, stops, _ = word_bounds(buffer, np.array([0, len(buffer)]), SPACED)
        self.word_row = np.searchsorted(ends, starts, side="right")
        self.words = span_hashes(buffer, starts, stops)
        keep = SPACED[buffer]
        after = np.zeros(len(buffer), bool)
        after[1:] = keep[:-1]
        after &= ~keep
        buffer = np.where(after, np.uint8(32), buffer)
        keep |= after
        keep[:DEPTH] = True
        for i in range(DEPTH):
            keep[ends + 1 + i] = True
            buffer[ends + 1 + i] = 10
        place = np.concatenate([[0], np.cumsum(keep, dtype=np.int64)])
        self.stream = buffer[keep]
        self.first, self.last = place[begins], place[ends + 1] + 1  # the row's bytes and its end mark
        self.rows = rows

    def grams(self, start: int, stop: int) -> np.ndarray:
        """Packed context and byte of the stream's places start..stop; the byte is lowest, then the latest context."""
        out = np.zeros(stop - start, np.uint64)
        for k in range(DEPTH + 1):
            out |= self.stream[start - k : stop - k].astype(np.uint64) << np.uint64(8 * k)
        return out

    def row_grams(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams of some rows, ascending, and how often each stands there."""
        edge = np.zeros(len(self.stream) + 1, np.int8)
        np.add.at(edge, self.first[rows], 1)
        np.add.at(edge, self.last[rows], -1)
        inside = np.cumsum(edge[DEPTH:-1], dtype=np.int8) > 0
        return np.unique(self.grams(DEPTH, len(self.stream))[inside], return_counts=True)


def _shard_of(kind: int, keys: np.ndarray, shards: int) -> np.ndarray:
    of = keys if kind == _WORDS else (keys >> np.uint64(8)) & np.uint64(0xFFFF)
    return (mix(of + np.uint64(kind)) % np.uint64(shards)).astype(np.int64)


def _sharded(kind: int, keys: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of ascending keys by shard, and the bounds of the shards in it."""
    shard = _shard_of(kind, keys, shards)
    return np.argsort(shard, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(shard, minlength=shards))])


def _merged(first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of distinct keys, with the counts of the second and 0 for those in the first alone."""
    keys = np.union1d(first, second)
    out = np.zeros(len(keys), np.int64)
    out[np.searchsorted(keys, second)] = counts
    return keys, out


def _requests(shards: int):
    def run(batches):
        for part in slices(batches, "text", BLOCK_BYTES):
            block = Block(part["text"])
            train = ~part["held"].to_numpy()
            learned = train[block.word_row]
            both = {
                _WORDS: _merged(np.append(np.unique(block.words), END), *np.unique(np.append(block.words[learned], np.full(int(train.sum()), END)), return_counts=True)),
                _GRAMS: _merged(block.row_grams(np.flatnonzero(~train))[0], *block.row_grams(np.flatnonzero(train))),
            }
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
                writer.write_table(part.combine_chunks())
            raw = sink.getvalue().to_pybytes()
            name = int(np.frombuffer(raw[-256:].rjust(256, b"\0"), np.uint64).sum(dtype=np.uint64) ^ np.bitwise_xor.reduce(block.words, initial=np.uint64(len(raw)))) & ((1 << 62) - 1)
            rows = [(-1, 0, name, part.num_rows, b"", b"", raw)]
            for kind, (keys, counts) in both.items():
                order, bounds = _sharded(kind, keys, shards)
                for s in np.flatnonzero(np.diff(bounds)):
                    own = order[bounds[s] : bounds[s + 1]]
                    rows.append((kind, int(s), name, len(own), _pack(keys[own], True), _pack(counts[own]), None))
            columns = list(zip(*rows, strict=True))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["kind", "shard", "block", "n", "keys", "counts", "rows"])

    return run


def _sum_up(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys with training counts over all rows of one shard."""
    keys, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for n, k, c in zip(table["n"].to_pylist(), table["keys"].to_pylist(), table["counts"].to_pylist(), strict=True):
        keys.append(_unpack(k, n, True))
        counts.append(_unpack(c, n))
    keys, counts = np.concatenate(keys), np.concatenate(counts).view(np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    sums = np.add.reduceat(counts, heads) if len(heads) else counts
    return keys[heads][sums > 0], sums[sums > 0]


def _merge(key, table):
    keys, counts = _sum_up(table)
    names = ("kind", "shard", "block")
    return pa.table({**{n: pa.array([k.as_py()], t) for n, k, t in zip(names, key, (pa.int32(), pa.int32(), pa.int64()), strict=True)}, "n": pa.array([len(keys)], pa.int64()), "keys": pa.array([_pack(keys, True)], pa.binary()), "counts": pa.array([_pack(counts)], pa.binary())})


def _log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after a shift by eight."""
    shift = np.zeros_like(x)
    for k in range(8):
        shift += np.log(x + k)
    z = x + 8
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + 1 / (12 * z) - 1 / (360 * z**3) + 1 / (1260 * z**5) - shift


def _log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return _log_gamma(zeros + 0.5) + _log_gamma(ones + 0.5) - _log_gamma(zeros + ones + 1.0) - np.log(np.pi)


def _nodes(byte: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The eight nodes (1 to 255) a byte passes, and the bit taken at each: arrays of shape (bytes, 8)."""
    b = byte.astype(np.int64)[:, None]
    k = np.arange(8)
    return (1 << k) | (b >> (8 - k)), (b >> (7 - k)) & 1


class Subtrees:
    """Depths 2 to DEPTH of the context tree under some latest two bytes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        node, bit = _nodes(grams & np.uint64(0xFF))
        context = (grams >> np.uint64(8))[:, None]
        key = ((context << np.uint64(8)) | node.astype(np.uint64)).ravel()
        ones = (counts[:, None] * bit).ravel().astype(np.float64)
        zeros = (counts[:, None] * (1 - bit)).ravel().astype(np.float64)
        self.keys, self.ones_share, self.weight = {}, {}, {}
        below = None
        for depth in range(DEPTH, 1, -1):
            keep = (np.uint64(1) << np.uint64(8 * depth + 8)) - np.uint64(1)
            key = key & keep
            key, (zeros, ones, *more) = _grouped(key, [zeros, ones] + ([below] if below is not None else []))
            own = _log_kt(zeros, ones)
            weighted = own if not more else np.logaddexp(own, more[0]) - np.log(2)
            self.keys[depth], self.ones_share[depth] = key, (ones + 0.5) / (zeros + ones + 1)
            self.weight[depth] = np.ones(len(key)) if not more else np.exp(own - np.log(2) - weighted)
            below = weighted
        self.top = key, zeros, ones, below

    def ones(self, grams: np.ndarray) -> np.ndarray:
        """Probability of a one at each of the eight decisions by depths 2 and more; NaN where no node was reached."""
        node, _ = _nodes(grams & np.uint64(0xFF))
        full = ((grams >> np.uint64(8))[:, None] << np.uint64(8)) | node.astype(np.uint64)
        p = np.full(full.shape, np.nan)
        for depth in range(DEPTH, 1, -1):
            keys = self.keys[depth]
            if not len(keys):
                continue
            wanted = full & ((np.uint64(1) << np.uint64(8 * depth + 8)) - np.uint64(1))
            at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            there = keys[at] == wanted
            own = self.ones_share[depth][at]
            w = self.weight[depth][at]
            p = np.where(there, np.where(np.isnan(p), own, w * own + (1 - w) * p), p)
        return p


def _grouped(key: np.ndarray, values: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    if not len(key):
        return key, values
    order = np.argsort(key, kind="stable")
    key = key[order]
    heads = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    return key[heads], [np.add.reduceat(v[order], heads) for v in values]


def _top_rows(batches):
    """What depth 1 needs of each shard's depth 2: counts and log-weights by latest byte and node."""
    for batch in batches:
        for n, k, c in zip(batch.column("n").to_pylist(), batch.column("keys").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            key, zeros, ones, below = Subtrees(_unpack(k, n, True), _unpack(c, n).view(np.int64)).top
            if len(key):
                key, (zeros, ones, below) = _grouped(key & np.uint64(0xFFFF), [zeros, ones, below])
                yield pa.RecordBatch.from_pydict({"node": key.astype(np.int64), "zeros": zeros, "ones": ones, "below": below})


def _top(rows: list) -> np.ndarray:
    """(2, 65536, 2): for depths 1 and 0, per (latest byte, node), the estimate of a one (NaN: not reached) and its weight."""
    out = np.full((2, 1 << 16, 2), np.nan)
    if rows:
        key = np.array([r["node"] for r in rows], np.uint64)
        zeros, ones, below = (np.array([r[c] for r in rows], np.float64) for c in ("zeros", "ones", "below"))
        for depth in (0, 1):
            if depth:
                key, (zeros, ones, below) = _grouped(key & np.uint64(0xFF), [zeros, ones, below])
            own = _log_kt(zeros, ones)
            weighted = np.logaddexp(own, below) - np.log(2)
            out[depth, key.astype(np.int64)] = np.stack([(ones + 0.5) / (zeros + ones + 1), np.exp(own - np.log(2) - weighted)], axis=1)
            below = weighted
    return out


def _log10_grams(tree: Subtrees, grams: np.ndarray, top: np.ndarray) -> np.ndarray:
    node, bit = _nodes(grams & np.uint64(0xFF))
    p = tree.ones(grams)
    latest = ((grams >> np.uint64(8)) & np.uint64(0xFF)).astype(np.int64)[:, None]
    for level, at in ((0, (latest << 8) | node), (1, node)):
        own, w = top[level, at, 0], top[level, at, 1]
        p = np.where(np.isnan(own), p, np.where(np.isnan(p), own, w * own + (1 - w) * p))
    p = np.where(np.isnan(p), 0.5, p)
    return np.log10(np.where(bit == 1, p, 1 - p)).sum(axis=1)


def _respond(top):
    def run(key, asked, model):
        kind, shard = key[0].as_py(), key[1].as_py()
        keys, counts = _sum_up(model)
        if kind == _GRAMS:
            tree, table = Subtrees(keys, counts), top.value
        out = {"kind": [], "shard": [], "block": [], "n": [], "answer": []}
        for n, raw, block in zip(asked["n"].to_pylist(), asked["keys"].to_pylist(), asked["block"].to_pylist(), strict=True):
            wanted = _unpack(raw, n, True)
            if kind == _WORDS:
                at = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
                answer = _pack(np.where(keys[at] == wanted, counts[at], 0)) if len(keys) else _pack(np.zeros(n, np.int64))
            else:
                answer = np.concatenate([_log10_grams(tree, wanted[i : i + 50_000], table) for i in range(0, n, 50_000)]).astype(np.float32).tobytes()
            for name, value in zip(out, (kind, shard, block, n, answer), strict=True):
                out[name].append(value)
        return pa.table([pa.array(out["kind"], pa.int32()), pa.array(out["shard"], pa.int32()), pa.array(out["block"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["answer"], pa.binary())], names=list(out))

    return run


def _scored(shards: int, total: int, distinct: int):
    def run(key, blocks, answers):
        by = {(k, s): (n, a) for k, s, n, a in zip(*(answers[c].to_pylist() for c in ("kind", "shard", "n", "answer")), strict=True)}
        parts = []
        for raw in blocks["rows"].to_pylist():
            with pa.ipc.open_stream(raw) as reader:
                part = reader.read_all()
            block = Block(part["text"])
            # The block's distinct words, in the order in which they were asked for.
            words = np.union1d(np.unique(block.words), np.array([END]))
            order, bounds = _sharded(_WORDS, words, shards)
            count = np.empty(len(words), np.int64)
            for s in np.flatnonzero(np.diff(bounds)):
                n, a = by[_WORDS, int(s)]
                count[order[bounds[s] : bounds[s + 1]]] = _unpack(a, n).view(np.int64)
            seen = count[np.searchsorted(words, np.append(block.words, END))]
            logs = np.log10((seen + 0.5) / (total + 0.5 * (distinct + 1)))
            n_words = np.bincount(block.word_row, minlength=block.rows)
            base = np.bincount(block.word_row, logs[:-1], minlength=block.rows) + logs[-1]
            known = np.bincount(block.word_row, seen[:-1] > 0, minlength=block.rows).astype(np.int64) + int(seen[-1] > 0)
            grams = block.row_grams(np.arange(block.rows))[0]
            order, bounds = _sharded(_GRAMS, grams, shards)
            value = np.empty(len(grams), np.float32)
            for s in np.flatnonzero(np.diff(bounds)):
                value[order[bounds[s] : bounds[s + 1]]] = np.frombuffer(by[_GRAMS, int(s)][1], np.float32)
            lookup, sums = Lookup(grams), np.zeros(len(block.stream) + 1)
            for i in range(DEPTH, len(block.stream), 1 << 20):
                j = min(i + (1 << 20), len(block.stream))
                found = lookup(block.grams(i, j))
                sums[i + 1 : j + 1] = np.where(found >= 0, value[found], 0)  # pads between rows were not asked for
            sums = np.add.reduceat(sums[1:], np.stack([block.first, block.last], axis=1).ravel()[: 2 * block.rows])[::2] if block.rows else sums[:0]
            size = block.last - block.first
            parts.append(pa.table({"doc_id": part["doc_id"], "held_out": part["held"], "n_tokens": pa.array(n_words + 1, pa.int64()), "n_known": known, "train_tokens": pa.array(np.full(block.rows, total), pa.int64()), "base_score": base, "score": sums, "bits_per_byte": -sums / np.log10(2) / size}))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
        return pa.concat_tables([p.cast(schema) for p in parts]) if parts else schema.empty_table()

    return run


def score(docs: DataFrame, *, held_out_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts, the word baseline and the model's log10-probability of every row; rows that are not held out train.

    base_score sums log10((c + 0.5) / (N + 0.5 * (V + 1))) over a text's words and its end, with c, N and V from the training rows.
    """
    spark = docs.sparkSession
    shards = max(1, min(MOST_SHARDS, partitions(spark)))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(held_out_col), F.lit(True)).alias("held"))
    asked = materialize(in_arrow(rows, _requests(shards), _STATS + ", rows binary"))
    blocks = asked.where("kind = -1").count()
    stats = asked.where("kind >= 0").select("kind", "shard", "block", "n", "keys", "counts")
    groups = max(1, -(-blocks // FAN))
    while True:
        stats = stats.withColumn("block", F.pmod(F.xxhash64("block"), F.lit(groups))).groupBy("kind", "shard", "block").applyInArrow(_merge, _STATS)
        if groups == 1:
            break
        groups = -(-groups // FAN)
    model = materialize(stats)
    sizes = in_arrow(model.where(f"kind = {_WORDS}"), _sizes, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    total, distinct = int(sizes[0] or 0), int(sizes[1] or 0)
    top = in_arrow(model.where(f"kind = {_GRAMS}"), _top_rows, "node long, zeros double, ones double, below double")
    top = _top(top.groupBy("node").agg(F.sum("zeros").alias("zeros"), F.sum("ones").alias("ones"), F.sum("below").alias("below")).collect())  # 256 bytes times 255 nodes
    table = spark.sparkContext.broadcast(top)
    parts = max(1, -(-blocks // GROUP))
    wanted = asked.where("kind >= 0").select("kind", "shard", F.pmod(F.xxhash64("block"), F.lit(parts)).alias("part"), "block", "n", "keys")
    copies = model.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))).select("kind", "shard", "part", "n", "keys", "counts")
    by = ("kind", "shard", "part")
    answers = wanted.groupBy(*by).cogroup(copies.groupBy(*by)).applyInArrow(_respond(table), "kind int, shard int, block long, n long, answer binary")
    texts = asked.where("kind = -1").select("block", "rows")
    out = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    return texts.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_scored(shards, total, distinct), out)


def _sizes(batches):
    for batch in batches:
        n = [int(_unpack(c, k).view(np.int64).sum()) for k, c in zip(batch.column("n").to_pylist(), batch.column("counts").to_pylist(), strict=True)]
        yield pa.RecordBatch.from_pydict({"n": pa.array(n, pa.int64()), "v": pc.cast(batch.column("n"), pa.int64())})
