"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

Every word falls in one of ``BUCKETS`` hash buckets and has a fixed random sign vector (its index vector). The context
vector of a bucket is the sum of the index vectors seen around it in all documents; words are taken as written, and also by shape (runs
of capitals, small letters, digits and the marks themselves). A document is the mean of the vectors of its words. The
network is trained with numpy on the driver from at most ``FIT_ROWS`` labelled documents, chosen by hash, and its
logits are divided by a temperature fitted on a fifth of them that the network does not see. Fitting reads the corpus twice,
for the context sums of all documents and for the chosen rows, which are kept as a written table. Scoring reads every whole text once and shuffles nothing; the model is a broadcast of fixed size.

A null or empty text, or one without words, has the zero vector and the score the network gives that. Null labels and
labels of unknown documents are left out; of several labels for one document the largest counts. Without any label all
scores are 0.5; with one class they are that class's rate, smoothed. Repeated rows are scored each for itself.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import SPACED, in_arrow, materialize, slices, span_hashes, utf8, word_bounds

FIT_ROWS, BUCKETS, SIZE, HIDDEN, REACH = 8192, 1 << 14, 32, 32, 2
FIT_TASKS, BLOCKS, GROUP = 8, 64, 256
_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[48:58], _SHAPE[65:91], _SHAPE[97:123], _SHAPE[128:] = 48, 65, 97, 128
_INDEX = np.random.default_rng(3).choice(np.array([-1, 0, 0, 0, 1], np.float32), (2, BUCKETS, SIZE))


@dataclass
class Model:
    contexts: np.ndarray  # (2, BUCKETS, SIZE): of words as written and of shapes
    centre: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    temperature: float


def _buckets(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each word as written, of its shape, and the word's row."""
    data, offsets = utf8(column)
    starts, ends, row = word_bounds(data, offsets, SPACED)
    kinds = _SHAPE[data]
    kept = np.ones(len(data), bool)
    kept[1:] = kinds[1:] != kinds[:-1]
    kept[starts] = True
    place = np.concatenate([[0], np.cumsum(kept)])
    low = np.uint64(BUCKETS - 1)
    return (span_hashes(data, starts, ends) & low).astype(np.int64), (span_hashes(kinds[kept], place[starts], place[ends]) & low).astype(np.int64), row


def _context_sums(batches):
    """Sums of the index vectors around each bucket, over all rows of the task."""
    sums = np.zeros((2, BUCKETS, SIZE), np.float32)
    for part in slices(batches, "text"):
        *both, row = _buckets(part["text"])
        for kind, bucket in enumerate(both):
            for step in range(1, REACH + 1):
                near = row[step:] == row[:-step]
                a, b = bucket[:-step][near], bucket[step:][near]
                for x, y in ((a, b), (b, a)):
                    pairs, times = np.unique(x * BUCKETS + y, return_counts=True)
                    owner, other = pairs // BUCKETS, pairs % BUCKETS
                    heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else owner
                    if len(heads):
                        sums[kind, owner[heads]] += np.add.reduceat(_INDEX[kind, other] * times[:, None].astype(np.float32), heads)
    yield pa.RecordBatch.from_pydict({"block": np.arange(BLOCKS, dtype=np.int32), "part": np.full(BLOCKS, TaskContext.get().partitionId() // GROUP, np.int32), "sums": pa.array([b.tobytes() for b in np.split(sums.reshape(-1), BLOCKS)], pa.binary())})


def _total(part: pa.Table) -> pa.Table:
    """One block of the sums over all tasks, or over a group of them."""
    total = np.zeros(2 * BUCKETS * SIZE // BLOCKS)
    for sums in part["sums"]:
        total += np.frombuffer(sums.as_buffer(), np.float32)
    return pa.table({"block": part["block"][:1], "sums": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def pooled(column, contexts: np.ndarray, rows: int) -> np.ndarray:
    """Mean vectors of the words of each row, with the length of the mean index vector, high in repetitive text."""
    written, shapes, row = _buckets(column)
    counts = np.bincount(row, minlength=rows)
    full = np.flatnonzero(counts)
    heads = (np.cumsum(counts) - counts)[full]
    out = np.zeros((rows, 4 * SIZE + 2), np.float32)
    if not len(full):
        return out
    share = counts[full, None].astype(np.float32)
    for k, (vectors, bucket) in enumerate(((contexts[0], written), (contexts[1], shapes), (_INDEX[1], shapes), (_INDEX[0], written))):
        out[full, k * SIZE : (k + 1) * SIZE] = np.add.reduceat(vectors[bucket], heads) / share
    out[full, -2] = np.linalg.norm(out[full, 3 * SIZE : 4 * SIZE], axis=1)
    out[full, -1] = np.log1p(counts[full])
    return out


def _forward(layers, x: np.ndarray) -> np.ndarray:
    first, bias, second, last = layers
    return np.tanh(x @ first + bias) @ second + last


def _fit(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, rounds: int = 60, batch: int = 128):
    params = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    for _ in range(rounds):
        order = rng.permutation(len(x))
        for at in range(0, len(x), batch):
            xs, ys = x[order[at : at + batch]], y[order[at : at + batch]]
            hidden = np.tanh(xs @ params[0] + params[1])
            error = (1 / (1 + np.exp(-np.clip(hidden @ params[2] + params[3], -30, 30))) - ys) / len(xs)
            back = error[:, None] * params[2] * (1 - hidden * hidden)
            slopes = [xs.T @ back + 1e-4 * params[0], back.sum(axis=0), hidden.T @ error + 1e-4 * params[2], error.sum()]
            step += 1
            for i, slope in enumerate(slopes):
                first[i] = 0.9 * first[i] + 0.1 * slope
                second[i] = 0.999 * second[i] + 0.001 * slope * slope
                params[i] = params[i] - 0.003 * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return params[0], params[1], params[2], float(params[3])


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits under which held-back labels are likeliest."""
    tries = np.geomspace(0.25, 20, 200)
    loss = [np.mean(np.logaddexp(0, -np.where(y > 0, 1, -1) * logits / t)) for t in tries]
    return float(tries[int(np.argmin(loss))])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> Model:
    """Fit on ``labels`` (``id_col``, label 0 or 1). At most ``fit_rows`` of them are used, the first by a hash of the id."""
    chosen = labels.where(F.col("label").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(F.max(F.col("label").cast("int")).alias("label"))
    chosen = chosen.orderBy(F.xxhash64("id"), "id").limit(fit_rows)
    fit = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "id")  # fit_rows rows at most
    fit = fit.select("id", "text", "label", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)).alias("fold"))
    fit = materialize(fit.repartition(FIT_TASKS, "id")).coalesce(FIT_TASKS)  # all tasks read the corpus once; few work on the chosen rows
    summed = in_arrow(docs.select(F.col(text_col).alias("text")), _context_sums, "block int, part int, sums binary")
    for keys in (("block", "part"), ("block",)):  # no group holds more than the blocks of GROUP tasks, or of as many such groups as there are
        summed = summed.groupBy(*keys).applyInArrow(_total, "block int, sums binary")
    contexts = np.zeros((BLOCKS, 2 * BUCKETS * SIZE // BLOCKS), np.float32)
    for r in summed.collect():  # 4 MB in all
        contexts[r["block"]] = np.frombuffer(r["sums"], np.float32)
    contexts = contexts.reshape(2, BUCKETS, SIZE)
    length = np.linalg.norm(contexts, axis=2, keepdims=True)
    contexts = contexts / np.where(length > 0, length, 1)
    shared = docs.sparkSession.sparkContext.broadcast(contexts)

    def pool(batches):
        for part in slices(batches, "text"):
            rows = pooled(part["text"], shared.value, part.num_rows)
            yield pa.RecordBatch.from_pydict({"x": [r.tobytes() for r in rows], "label": part["label"].combine_chunks(), "fold": part["fold"].combine_chunks()})

    got = in_arrow(fit.select("text", "label", "fold"), pool, "x binary, label int, fold long").collect()
    shared.destroy()
    width = 4 * SIZE + 2
    x = np.frombuffer(b"".join(bytes(r["x"]) for r in got), np.float32).reshape(-1, width).astype(np.float64)
    y = np.array([float(r["label"] > 0) for r in got])
    held = np.array([r["fold"] == 0 for r in got], bool)
    plain = (np.zeros((width, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN))
    if len(y) == 0 or y.min() == y.max():
        rate = (y.sum() + 0.5) / (len(y) + 1)
        return Model(contexts, np.zeros(width), np.ones(width), (*plain, float(np.log(rate / (1 - rate)))), 1.0)
    order = np.lexsort(x.T[:3])  # the same rows in the same order each time
    x, y, held = x[order], y[order], held[order]
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - centre) / scale
    learn = ~held if held.any() and (~held).any() and y[~held].min() != y[~held].max() else np.ones(len(y), bool)
    layers = _fit(z[learn], y[learn], np.random.default_rng(17))
    test = held if held.any() else learn
    return Model(contexts, centre, scale, layers, _temperature(_forward(layers, z[test]), y[test]))


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher: label 1 is likelier) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part in slices(batches, "text", 1 << 20):
            x = (pooled(part["text"], m.contexts, part.num_rows) - m.centre) / m.scale
            logit = np.clip(_forward(m.layers, np.clip(x, -12, 12)) / m.temperature, -40, 40)
            yield pa.RecordBatch.from_pydict({"doc_id": part["doc_id"].combine_chunks(), "score": 1 / (1 + np.exp(-logit))})

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, *, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text scores ``threshold`` or more, with all their columns."""
    fields = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for part in slices(batches, text_col, 1 << 20):
            x = (pooled(part[text_col], m.contexts, part.num_rows) - m.centre) / m.scale
            logit = np.clip(_forward(m.layers, np.clip(x, -12, 12)) / m.temperature, -40, 40)
            yield from part.filter(pa.array(1 / (1 + np.exp(-logit)) >= threshold)).to_batches()

    return in_arrow(docs, run, fields)
