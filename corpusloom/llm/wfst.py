"""SentencePiece encoding and decoding as shortest paths in a weighted finite-state transducer.

The transducer is compiled on the driver from a model file and broadcast (its size is that of the vocabulary): the
normaliser (dummy prefix, spaces as U+2581), the pieces as a trie of arcs, and byte fallback for characters that
no piece covers. Composition with a text gives a lattice whose nodes are positions and whose arcs are pieces; the
encoding is its shortest path in the tropical semiring.

* In a unigram model an arc weighs minus the piece's score.
* In a merge (BPE) model an arc weighs 0 if it may follow the arc before it, and infinity if not. Two pieces may stand
  side by side if undoing their merges, latest first, never meets a pair across their border that would have been merged
  earlier. Each position then has exactly one incoming arc of finite weight, so the path is the merge result itself.

Texts are cut into units at spaces (no piece has a space after another character; without that property the whole text is one
unit), and equal units of a slice are encoded once, all of them side by side in numpy.

Null and empty texts have no tokens and decode to the empty text. Decoding gives back the text, byte for byte, but for U+2581, which
the normaliser reads as a space. Repeated rows get equal results. No text is cut; there is no shuffle.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import in_arrow, Lookup, slices, span_hashes, utf8

SPACE = "▁"
_SLICE, LATTICE_BYTES = 4 << 20, 1 << 19


def _fields(raw: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(raw):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, raw[at : at + size]
            at += size


@dataclass
class Transducer:
    """Compiled tables. Tokens are ids of the model; a character without a piece is the pseudo token ``unknown``."""

    unigram: bool
    pieces: list[bytes]  # text of each id, spaces as spaces; empty for control pieces
    kinds: np.ndarray  # type of each id: 1 normal, 2 unknown, 3 control, 4 user defined, 5 unused, 6 byte
    scores: np.ndarray
    byte_ids: np.ndarray  # id of each byte piece, -1 where there is none
    unknown_id: int
    prefix: bool  # whether a space is put before the text
    cuts: bool  # whether texts can be cut at spaces
    trie_keys: np.ndarray  # node * 256 + byte, and the node it leads to
    trie_next: np.ndarray
    trie_token: np.ndarray  # token that ends at each node, -1 if none
    pair_keys: np.ndarray  # left << 32 | right of pairs that merge, and the rank of the result
    pair_rank: np.ndarray
    rank: np.ndarray  # of each token: when it is merged; -1 for single characters
    left: np.ndarray  # what each token is merged from
    right: np.ndarray


def compile_model(path: str) -> Transducer:
    """Read a SentencePiece model file on the driver and compile it."""
    with open(path, "rb") as f:
        raw = f.read()
    texts, scores, kinds, trainer, normaliser = [], [], [], {}, {}
    for number, value in _fields(raw):
        if number == 1:
            piece = dict(_fields(value))
            texts.append(piece.get(1, b"").decode())
            scores.append(float(np.frombuffer(piece[2], "<f4")[0]) if 2 in piece else 0.0)
            kinds.append(piece.get(3, 1))
        elif number == 2:
            trainer = dict(_fields(value))
        elif number == 3:
            normaliser = dict(_fields(value))
    if normaliser.get(2) or normaliser.get(4, 1):
        raise ValueError("only models with the identity normaliser and without white-space removal are supported")
    kinds_, scores_ = np.array(kinds), np.array(scores)
    unigram = trainer.get(3, 1) == 1
    byte_ids = np.full(256, -1, np.int64)
    for i in np.flatnonzero(kinds_ == 6):
        byte_ids[int(texts[i][3:5], 16)] = i
    usable = {t: i for i, t in enumerate(texts) if kinds[i] in (1, 4) and t}
    n = len(texts)
    rank, left, right = np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64), np.full(n + 1, -1, np.int64)
    pairs: dict[tuple[int, int], int] = {}
    if not unigram:
        for t, i in usable.items():
            for cut in range(1, len(t)):
                a, b = usable.get(t[:cut]), usable.get(t[cut:])
                if a is not None and b is not None:
                    pairs[a, b] = i
        order = {i: r for r, i in enumerate(sorted(usable.values(), key=lambda i: (-scores[i], i)))}
        made: dict[str, int] = {}
        for t, i in usable.items():
            if len(t) == 1:
                made[t] = i
                continue
            parts = [usable.get(c) for c in t]
            last = None
            while len(parts) > 1 and None not in parts:
                best = min(((order[pairs[p]], k) for k, p in enumerate(zip(parts, parts[1:], strict=False)) if p in pairs), default=None)
                if best is None:
                    break
                k = best[1]
                last = (parts[k], parts[k + 1])
                parts[k : k + 2] = [pairs[last]]
            if parts == [i]:  # else merging never yields this piece
                made[t] = i
                rank[i], left[i], right[i] = order[i], *last
        usable = made
    keys, nodes, tokens = {}, 1, [-1]
    for t, i in usable.items():
        at = 0
        for byte in t.replace(SPACE, " ").encode():
            key = at * 256 + byte
            if key not in keys:
                keys[key] = nodes
                nodes += 1
                tokens.append(-1)
            at = keys[key]
        tokens[at] = i
    cuts = not any(" " in t.replace(SPACE, " ").lstrip(" ") for t in usable)
    pair_keys = np.array([(a << 32) | b for a, b in pairs], np.uint64)
    pair_rank = np.array([order[i] for i in pairs.values()], np.int64) if pairs else np.zeros(0, np.int64)
    by = np.argsort(pair_keys)
    return Transducer(
        unigram, [t.replace(SPACE, " ").encode() if k in (1, 4) else b"" for t, k in zip(texts, kinds, strict=True)], kinds_, scores_, byte_ids,
        int(np.flatnonzero(kinds_ == 2)[0]), bool(normaliser.get(3, 1)), cuts,
        np.array(list(keys), np.uint64), np.array(list(keys.values()), np.int64), np.array(tokens, np.int64),
        pair_keys[by], pair_rank[by], rank, left, right,
    )


class Encoder:
    """Composition and shortest paths, with the tables of one transducer."""

    def __init__(self, t: Transducer):
        self.t = t
        self.trie, self.pairs = Lookup(t.trie_keys), Lookup(t.pair_keys)
        self.unknown = len(t.pieces)

    def _may_follow(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each right token may stand after the left one; verdicts on distinct pairs are made once a call."""
        both, place = np.unique(left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64), return_inverse=True)
        return self._judge((both >> np.uint64(32)).astype(np.int64), (both & np.uint64(0xFFFFFFFF)).astype(np.int64))[place]

    def _judge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        t = self.t
        good = np.ones(len(a), bool)
        limit = np.full(len(a), np.iinfo(np.int64).max)  # the border pair must not merge before this rank
        live = np.arange(len(a))
        a, b = a.copy(), b.copy()
        while len(live):
            la, lb = a[live], b[live]
            at = self.pairs(la.astype(np.uint64) << np.uint64(32) | lb.astype(np.uint64))
            early = (at >= 0) & (t.pair_rank[at] < limit[live]) if len(t.pair_rank) else np.zeros(len(live), bool)
            good[live[early]] = False
            live, la, lb = live[~early], la[~early], lb[~early]
            ra, rb = t.rank[la], t.rank[lb]
            undo_left = ra > rb  # the later merge is undone first; on equal ranks the one on the right came later
            some = (ra >= 0) | (rb >= 0)
            limit[live] = np.where(undo_left, ra, rb + 1)
            a[live] = np.where(undo_left, t.right[la], la)
            b[live] = np.where(undo_left | (rb < 0), lb, t.left[lb])
            live = live[some]
        return good

    def encode_units(self, data: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all units in a line, and the bounds of the units in them. Units are data[heads[i]:ends[i]]."""
        t = self.t
        sizes = ends - heads
        unit = np.repeat(np.arange(len(heads)), sizes)
        base = np.cumsum(sizes) - sizes
        inner = np.arange(len(unit)) - base[unit]
        text = data[heads[unit] + inner].astype(np.uint64)
        left = sizes[unit] - inner
        # Composition: walk the trie from every position at once.
        arc_from, arc_size, arc_token = [], [], []
        at, node, depth = np.arange(len(unit)), np.zeros(len(unit), np.int64), 0
        while len(at):
            found = self.trie(node.astype(np.uint64) << np.uint64(8) | text[at + depth])
            at, node = at[found >= 0], t.trie_next[found[found >= 0]]
            depth += 1
            token = t.trie_token[node]
            is_arc = token >= 0
            arc_from.append(at[is_arc])
            arc_token.append(token[is_arc])
            arc_size.append(np.full(int(is_arc.sum()), depth))
            more = left[at] > depth
            at, node = at[more], node[more]
        # Byte fallback: a character without a piece of its own is one arc of the pseudo token.
        lead = np.flatnonzero((text & np.uint64(0xC0)) != 0x80)
        width = np.diff(np.append(lead, len(text)))
        known = np.zeros(len(text), bool)
        first_from, first_size = np.concatenate(arc_from) if arc_from else lead[:0], np.concatenate(arc_size) if arc_size else lead[:0]
        width_at = np.zeros(len(text), np.int64)
        width_at[lead] = width
        known[first_from[first_size == width_at[first_from]]] = True
        bare = lead[~known[lead]]
        start = np.concatenate([first_from, bare])
        size = np.concatenate([first_size, width_at[bare]])
        token = np.concatenate([*arc_token, np.full(len(bare), self.unknown)]) if len(start) else start
        # Shortest path: nodes by their place in the unit, all units at once.
        goal = inner[start] + size if len(start) else start
        by = np.argsort(goal.astype(np.uint16) if goal.max(initial=0) < 1 << 16 else goal, kind="stable")
        start, size, token, goal = start[by], size[by], token[by], goal[by]
        last = np.full(len(text) + 1, -1, np.int64)  # token of the best arc into the position behind each byte
        back = np.zeros(len(text) + 1, np.int64)
        cost = np.full(len(text) + 1 if t.unigram else 0, np.inf)
        bounds = np.searchsorted(goal, np.arange(1, int(goal.max(initial=0)) + 2))
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            s, z, k = start[lo:hi], size[lo:hi], token[lo:hi]
            stop = s + z - 1
            opens = inner[s] == 0
            before = np.where(opens, -1, last[s - 1])
            if t.unigram:
                weight = np.where(k == self.unknown, 10 - t.scores.min(), -t.scores[np.minimum(k, self.unknown - 1)])
                total = np.where(opens, 0, cost[s - 1]) + weight
                order = np.lexsort((total, stop))
                top = order[np.append(True, stop[order[1:]] != stop[order[:-1]])] if len(order) else order
                top = top[np.isfinite(total[top])]
                cost[stop[top]] = total[top]
            else:  # at most one arc into a position has finite weight
                fine = opens.copy()
                check = np.flatnonzero(~opens & (before >= 0))
                fine[check] = self._may_follow(before[check], k[check])
                top = np.flatnonzero(fine)
            last[stop[top]], back[stop[top]] = k[top], z[top]
        # Read the paths from their ends; unknown characters become their bytes.
        spot, owner, chain = base + sizes - 1, np.arange(len(heads)), []
        live = np.flatnonzero(sizes > 0)
        while len(live):
            p = spot[live]
            if (last[p] < 0).any():
                raise RuntimeError("the lattice has no path: the model's pieces do not cover a text")
            chain.append(np.stack([owner[live], p - back[p] + 1, last[p], back[p]]))
            spot[live] = p - back[p]
            live = live[inner[p] + 1 > back[p]]
        if not chain:
            return np.zeros(0, np.int64), np.zeros(len(heads) + 1, np.int64)
        own, place, tok, wide = np.concatenate(chain, axis=1)
        order = np.argsort(place, kind="stable")
        own, place, tok, wide = own[order], place[order], tok[order], wide[order]
        bare = tok == self.unknown
        times = np.where(bare, wide, 1)
        grown = np.repeat(np.arange(len(tok)), times)
        step = np.arange(len(grown)) - np.repeat(np.cumsum(times) - times, times)
        byte = t.byte_ids[text[place[grown] + step].astype(np.int64)]
        out = np.where(bare[grown], np.where(byte >= 0, byte, t.unknown_id), tok[grown])
        return out, np.concatenate([[0], np.cumsum(np.bincount(own[grown], minlength=len(heads)))])

    def _in_parts(self, data: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode_units() over lattices of about LATTICE_BYTES, which bounds its memory."""
        part = np.cumsum(ends - heads) // LATTICE_BYTES
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(part)) + 1, [len(heads)]])
        got = [self.encode_units(data, heads[a:b], ends[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        sizes = np.concatenate([np.diff(b) for _, b in got])
        return np.concatenate([tok for tok, _ in got]).astype(np.int32), np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, column) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all rows in a line, and the bounds of the rows in them."""
        t = self.t
        data, offsets = utf8(column)
        joined = data.tobytes()
        rows = len(offsets) - 1
        # Normaliser: U+2581 reads as a space, and a space goes before every text that is not empty.
        mark = SPACE.encode()
        if mark in joined:
            texts = [joined[a:b].replace(mark, b" ") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in texts])]).astype(np.int64)
            data = np.frombuffer(b"".join(texts), np.uint8)
        full = np.flatnonzero(np.diff(offsets))
        if t.prefix and len(full):
            data = np.insert(data, offsets[full], 32)
            grown = np.zeros(rows + 1, np.int64)
            grown[full + 1] = 1
            offsets = offsets + np.cumsum(grown)
        if not len(data):
            return np.zeros(0, np.int64), np.zeros(rows + 1, np.int64)
        opens = np.zeros(len(data), bool)
        opens[offsets[full]] = True
        if t.cuts:
            space = data == 32
            opens[1:] |= space[1:] & ~space[:-1]
            feed = data == 10
            if t.byte_ids[10] >= 0 and b"\n" not in b"".join(t.pieces):
                opens |= feed
                opens[1:] |= feed[:-1]
        heads = np.flatnonzero(opens)
        ends = np.append(heads[1:], len(data))
        _, one, place = np.unique(span_hashes(data, heads, ends), return_index=True, return_inverse=True)
        tokens, bounds = self._in_parts(data, heads[one], ends[one])
        counts = np.diff(bounds)[place]
        total = np.concatenate([[0], np.cumsum(counts)])
        each = np.repeat(bounds[:-1][place] - total[:-1], counts) + np.arange(total[-1])
        return tokens[each], total[np.searchsorted(heads, offsets)]

    def decode(self, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all rows in a line and the bounds of the rows: the inverse transducer."""
        t = self.t
        if not hasattr(self, "_out"):
            texts = [bytes([int(np.flatnonzero(t.byte_ids == i)[0])]) if k == 6 else b" \xe2\x81\x87 " if k == 2 else x for i, (x, k) in enumerate(zip(t.pieces, t.kinds, strict=True))]
            self._out = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        store, cut = self._out
        sizes = (cut[1:] - cut[:-1])[ids]
        total = np.concatenate([[0], np.cumsum(sizes)])
        data = store[np.repeat(cut[:-1][ids] - total[:-1], sizes) + np.arange(total[-1])]
        offsets = total[bounds]
        if t.prefix:  # drop the space put before each text
            full = np.flatnonzero(np.diff(offsets))
            drop = offsets[full][data[offsets[full]] == 32]
            gone = np.zeros(len(offsets), np.int64)
            gone[full[data[offsets[full]] == 32] + 1] = 1
            data, offsets = np.delete(data, drop), offsets - np.cumsum(gone)
        return data, offsets


def _shared(spark: SparkSession, model: str):
    return spark.sparkContext.broadcast(compile_model(model))  # as large as the vocabulary


def _lists(tokens: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(tokens.astype(np.int32)))


def encode(docs: DataFrame, model: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """All columns of the rows, and the token ids of their texts."""
    from pyspark.sql import types as T

    shared = _shared(docs.sparkSession, model)
    kept = [f for f in docs.schema if f.name != ids_col]

    def run(batches):
        encoder = Encoder(shared.value)
        for part in slices(batches, text_col, _SLICE):
            out = part.select([f.name for f in kept]).append_column(ids_col, _lists(*encoder.encode(part[text_col])))
            yield from out.to_batches()

    return in_arrow(docs, run, T.StructType([*kept, T.StructField(ids_col, T.ArrayType(T.IntegerType()))]))


def decode(rows: DataFrame, model: str, *, ids_col: str = "ids", text_col: str = "text") -> DataFrame:
    """All columns of the rows, and the text of their token ids; null ids give an empty text."""
    from pyspark.sql import types as T

    shared = _shared(rows.sparkSession, model)
    kept = [f for f in rows.schema if f.name != text_col]

    def run(batches):
        encoder = Encoder(shared.value)
        for batch in batches:
            ids = batch.column(ids_col).to_pylist()
            bounds = np.concatenate([[0], np.cumsum([len(x or ()) for x in ids])]).astype(np.int64)
            flat = np.array([i for x in ids for i in x or ()], np.int64)
            data, offsets = encoder.decode(flat, bounds)
            texts = pa.array([data[a:b].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.string())
            yield from pa.Table.from_batches([batch]).select([f.name for f in kept]).append_column(text_col, texts).to_batches()

    return in_arrow(rows, run, T.StructType([*kept, T.StructField(text_col, T.StringType())]))


def round_trip(docs: DataFrame, model: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, ids_sha256 (of the ids as 32-bit little-endian integers) and exact: whether decoding gives the text back."""
    shared = _shared(docs.sparkSession, model)
    mark = SPACE.encode()

    def run(batches):
        encoder = Encoder(shared.value)
        for part in slices(batches, "text", _SLICE):
            tokens, bounds = encoder.encode(part["text"])
            data, offsets = encoder.decode(tokens, bounds)
            before, at = utf8(part["text"])
            same = [data[a:b].tobytes() == before[c:d].tobytes().replace(mark, b" ") for a, b, c, d in zip(offsets[:-1], offsets[1:], at[:-1], at[1:], strict=True)]
            digests = [hashlib.sha256(tokens[a:b].astype("<i4").tobytes()).hexdigest() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].combine_chunks(), "ids": _lists(tokens, bounds), "n_tokens": np.diff(bounds), "ids_sha256": digests, "exact": same})

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return in_arrow(chosen, run, "doc_id long, ids array<int>, n_tokens long, ids_sha256 string, exact boolean")
