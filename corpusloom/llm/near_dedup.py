"""MinHash near-duplicates by an inverted join on signature coordinates.

A document's set holds its distinct word shingles. Documents with equal sets become one representative, so a group of
copies of any size costs one row from there on. A signature has ``COORDINATES`` minima. A pair is a candidate if at least
``matches(percent)`` coordinates agree, the largest number that a pair at the threshold misses with a probability of at most
``MISS`` (more similar pairs miss it far less often); these are the only links that can be lost.

Values are ordered by how many representatives hold them, rarest first, over the whole corpus. A pair with enough equal
coordinates must share one of the first (coordinates - matches + 1) of each side in that order (prefix filter), so a
representative is posted there only. Values that one document holds alone fill the prefix first and need no post: common
passages, whose minima very many documents share, come last and make no lists.

Lists are merged without pairing all members (skip merging): the first round pairs each list's members with its pivot,
the member whose posts are shared most, and confirms pairs with enough equal coordinates on their full sets. After
it only members in different components matter, since a pair within one component cannot change the result. They are
compared on their full sets within tasks, chunk by chunk of a list, and only links leave the task: neither all
members of a list nor all its pairs are ever gathered. Components come from a star contraction. Nothing is capped.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, SPACED, in_arrow, materialize, mix, slices, small_batches, span_hashes, utf8, word_bounds
from corpusloom.llm.components import connected_components

COORDINATES, MISS, CHUNK, _STRIP = 64, 1e-6, 64, 8192
_FACTORS = np.random.default_rng(20_240_607).integers(1, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def matches(percent: int) -> int:
    """Coordinates that must agree: fewer do with a probability of at most MISS at the threshold."""
    p, below, t = percent / 100, 0.0, 0
    while t < COORDINATES:
        below += comb(COORDINATES, t) * p**t * (1 - p) ** (COORDINATES - t)
        if below > MISS:
            break
        t += 1
    return max(1, t)


def shingle_hashes(column, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending within each row, and the bounds of the rows in them."""
    data, offsets = utf8(column)
    data = LOWER[data]
    starts, ends, row = word_bounds(data, offsets, SPACED)
    words = span_hashes(data, starts, ends)
    rows = len(offsets) - 1
    counts = np.bincount(row, minlength=rows)
    first = np.cumsum(counts) - counts
    per_row = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(per_row)])
    owner = np.repeat(np.arange(rows), per_row)
    start = first[owner] + np.arange(len(owner)) - bounds[owner]
    hashes = span_hashes(words, start, start + np.minimum(width, counts[owner]))
    for i in np.flatnonzero(per_row > 1):
        hashes[bounds[i] : bounds[i + 1]].sort()
    keep = np.ones(len(hashes), bool)
    keep[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
    return hashes[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=rows))])


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, n_shingles, a 128-bit hash of the set (set_a, set_b) and the signature (null for an empty set)."""

    def sign(batches):
        for part in slices(batches, "text"):
            hashes, bounds = shingle_hashes(part["text"], shingle)
            sizes = np.diff(bounds)
            full = np.flatnonzero(sizes)
            heads = bounds[full]
            set_a, set_b = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            values = np.zeros((len(full), COORDINATES), np.uint64)
            if len(full):
                set_a[full] = np.add.reduceat(hashes, heads)
                set_b[full] = np.add.reduceat(mix(hashes), heads)
                for k, factor in enumerate(_FACTORS):
                    values[:, k] = mix(np.minimum.reduceat(hashes * factor, heads) + np.uint64(k + 1))
            ends = np.zeros(len(sizes) + 1, np.int32)
            ends[1:] = np.cumsum((sizes > 0) * COORDINATES)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": part["doc_id"].combine_chunks(),
                    "n_shingles": sizes.astype(np.int64),
                    "set_a": set_a.view(np.int64),
                    "set_b": set_b.view(np.int64),
                    "signature": pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel().view(np.int64))),
                }
            )

    return in_arrow(docs, sign, "doc_id long, n_shingles long, set_a long, set_b long, signature array<long>")


def shingle_sets(docs: DataFrame, shingle: int) -> DataFrame:
    def hashed(batches):
        for part in slices(batches, "text"):
            hashes, bounds = shingle_hashes(part["text"], shingle)
            sets = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].combine_chunks(), "shingles": sets})

    return in_arrow(docs, hashed, "doc_id long, shingles array<long>")


def _confirmed(pairs: DataFrame, signed: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) with enough equal coordinates whose full sets are similar enough."""
    side = lambda df, column, x: df.select(F.col("doc_id").alias(x), F.col(column).alias(f"{column}_{x}"))
    agree = F.aggregate(F.zip_with("signature_a", "signature_b", lambda x, y: (x == y).cast("int")), F.lit(0), lambda n, x: n + x)
    pairs = pairs.join(side(signed, "signature", "b"), "b").join(side(signed, "signature", "a"), "a").where(agree >= matches(percent)).select("a", "b")
    both = pairs.join(side(sets, "shingles", "b"), "b").join(side(sets, "shingles", "a"), "a")
    common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("long")
    return both.where(100 * common >= percent * (F.size("shingles_a") + F.size("shingles_b") - common)).select("a", "b")


def _members(column: pa.ListArray, k: int):
    """Ids, components, and posts and sets (values and bounds) of the members in row k."""
    at = column.offsets.to_numpy()
    rows = column.values.slice(at[k], at[k + 1] - at[k])
    lists = []
    for name in ("posts", "shingles"):
        x = rows.field(name)
        bounds = x.offsets.to_numpy()
        lists.append((x.values.to_numpy()[bounds[0] : bounds[-1]], bounds - bounds[0]))
    return rows.field("rep").to_numpy(), rows.field("component").to_numpy(), *lists


def _shared_counts(left, right, below: int | None = None) -> np.ndarray:
    """How many values each left member shares with each right one, in strips of the shared values."""
    shared = np.intersect1d(left[0], right[0])
    if below is not None:
        shared = shared[shared < below]
    out = np.zeros((len(left[1]) - 1, len(right[1]) - 1), np.float32)
    places = []
    for flat, bounds in (left, right):
        at = np.searchsorted(shared, flat)
        good = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == flat) if len(shared) else at[:0]
        places.append((np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[good], at[good]))
    for strip in range(0, len(shared), _STRIP):
        both = []
        for (row, at), n in zip(places, out.shape, strict=True):
            matrix = np.zeros((n, min(_STRIP, len(shared) - strip)), np.float32)
            inside = (at >= strip) & (at < strip + _STRIP)
            matrix[row[inside], at[inside] - strip] = 1
            both.append(matrix)
        out += both[0] @ both[1].T
    return np.rint(out).astype(np.int64)


def _block_links(percent: int):
    """Links between the members of two chunks of one list; only pairs whose smallest shared value is the list's."""

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                value = batch.column("value")[k].as_py()
                ra, ca, posts_a, sets_a = _members(batch.column("members"), k)
                rb, cb, posts_b, sets_b = _members(batch.column("members_b"), k)
                na, nb = np.diff(sets_a[1])[:, None], np.diff(sets_b[1])[None, :]
                wanted = (ca[:, None] != cb[None, :]) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
                if wanted.any():
                    wanted &= _shared_counts(posts_a, posts_b, value) == 0
                if not wanted.any():
                    continue
                common = _shared_counts(sets_a, sets_b)
                i, j = np.nonzero(wanted & (100 * common >= percent * (na + nb - common)))
                a, b = ra[i], rb[j]
                yield pa.RecordBatch.from_pydict({"a": np.maximum(a, b), "b": np.minimum(a, b)})

    return run


def near_duplicates(docs: DataFrame, *, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row.

    Rows are linked if their sets' similarity is at least ``percent`` per cent; a component is named by its smallest
    doc_id, whose row is ``kept``. Null and empty texts and texts without words have an empty set and stand alone.
    Rows with the same doc_id count as one document with several texts: each row reports its own set, and they share
    a component. Rows with a null doc_id are linked with nothing: their component is null and they are kept. Columns
    besides id and text are not read.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = materialize(signatures(docs, shingle))
    n = signed.count()
    real = signed.where("n_shingles > 0 and doc_id is not null")
    classes = real.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("rep"))
    reps = real.join(classes, ["set_a", "set_b"]).where("doc_id = rep").dropDuplicates(["set_a", "set_b"]).select("doc_id", "signature")
    values = reps.select(F.col("doc_id").alias("rep"), F.explode("signature").alias("value"))
    shared = values.join(values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "value")
    rare = shared.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "value"))).alias("p"))  # COORDINATES at most
    slots = F.size("p") - (matches(percent) - 1)  # of the prefix, after the values that no other document holds
    posts = materialize(rare.where(slots > 0).select("rep", F.explode(F.slice("p", 1, slots)).alias("x")).select("rep", "x.value", "x.n"), n)
    weight = posts.groupBy("rep").agg(F.sum("n").alias("weight"))
    pivots = posts.join(weight, "rep").groupBy("value").agg(F.max(F.struct("weight", (-F.col("rep")).alias("o"))).alias("top")).select("value", (-F.col("top.o")).alias("pivot"))
    posted = weight.select(F.col("rep").alias("doc_id"))
    signed_reps = materialize(reps.join(posted, "doc_id", "left_semi"), n)
    sets = materialize(shingle_sets(docs.join(posted, "doc_id", "left_semi").select("doc_id", "text"), shingle))
    tested = materialize(posts.join(pivots, "value").where("rep <> pivot").select(F.greatest("rep", "pivot").alias("a"), F.least("rep", "pivot").alias("b")).distinct(), n)
    links = materialize(_confirmed(tested, signed_reps, sets, percent), n)

    # Members of one list in different components after the pivot round: the rest of the list's pairs that matter.
    part = connected_components(links).withColumnRenamed("node", "rep")
    placed = posts.join(part, "rep", "left").select("value", "rep", F.coalesce("component", "rep").alias("component"))
    sizes = placed.groupBy("value", "component").agg(F.count("*").alias("n"))
    lists = sizes.groupBy("value").agg(F.sum("n").alias("members"), F.count("*").alias("parts"), F.max(F.struct("n", "component")).alias("top"))
    lists = lists.where("parts > 1 and members > 2").select("value", F.ceil(F.col("members") / CHUNK).alias("chunks"), F.col("top.component").alias("main"))
    mine = posts.groupBy("rep").agg(F.array_sort(F.collect_list("value")).alias("posts"))  # COORDINATES at most
    open_ = materialize(placed.join(lists, "value"), n)
    facts = mine.join(open_.select("rep").distinct(), "rep", "left_semi").join(sets.select(F.col("doc_id").alias("rep"), "shingles"), "rep")
    member = F.struct("rep", "component", "posts", "shingles")
    chunks = open_.join(facts, "rep").groupBy("value", F.pmod(F.xxhash64("rep"), F.col("chunks")).alias("chunk")).agg(F.collect_list(member).alias("members"), F.max(F.col("component") != F.col("main")).alias("open"))
    right = chunks.select("value", F.col("chunk").alias("chunk_b"), F.col("members").alias("members_b"), F.col("open").alias("open_b"))
    blocks = chunks.join(right, "value").where("chunk <= chunk_b and (open or open_b)").select("value", "members", "members_b")
    with small_batches(docs.sparkSession, 8):  # a row holds two chunks with their sets
        links = links.union(materialize(in_arrow(blocks, _block_links(percent), "a long, b long")))

    parts = connected_components(links.union(_several_texts(real, classes)))
    named = classes.join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("set_a", "set_b", F.coalesce("component", "rep").alias("component_id"))
    out = signed.join(named, ["set_a", "set_b"], "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)))


def _several_texts(real: DataFrame, classes: DataFrame) -> DataFrame:
    """Links between the representatives of the different texts that one doc_id has."""
    owned = real.join(classes, ["set_a", "set_b"]).groupBy("doc_id").agg(F.min("rep").alias("b"), F.max("rep").alias("a"), F.count_distinct("rep").alias("k"))
    several = owned.where("k > 1").select("doc_id", "b")
    return real.join(classes, ["set_a", "set_b"]).join(several, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """One document of each group, with all its columns, whatever their names; rows with a null id stay."""
    gone = near_duplicates(docs, id_col=id_col, **options).where("not kept").select("doc_id").distinct()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("doc_id"))
    return rows.join(gone, "doc_id", "left_anti").select("row.*")
