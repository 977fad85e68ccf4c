"""Approximate nearest neighbours by inner product over balanced posting lists.

Vectors are lengthened by one coordinate so that all have the largest norm; nearest by angle is then nearest by inner
product. A bounded sample (``SAMPLE`` rows by hash, documented bound) is halved again and again until parts hold about
``LIST_ROWS`` rows of the whole table or ``MIN_PART`` sampled ones; the parts' means are the centroids. Every vector is
then posted, in tasks, to its nearest centroid and to a second one whose distance is within ``CLOSURE`` of the nearest
(boundary replicas). Centroids are found through a neighbour graph in memory. A query reads its nearest lists as long as
their centroid distance is within a ratio of the nearest one's. Neither the number nor the ratio is fixed: both are fitted
on sampled queries, the number so that it holds the share ``target`` of their true neighbours in the sample, where
neighbours lie further off than in the whole table, the ratio so that it cuts ``CUT`` of these at most; ``target=1`` reads
all lists, which is exact. So well parted vectors read few lists, and vectors without any structure as many as it takes.

Equal vectors are one class, kept with its smallest ids, as many as an answer can hold; so a vector that a third of
all rows share is posted once. Neighbouring lists are searched together as a bundle, and bundles of more than ``SPLIT``
rows are cut into pieces that are searched separately.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm.common import in_arrow, materialize

SAMPLE, LIST_ROWS, MIN_PART = 32_768, 32, 8
REPLICAS, CLOSURE = 2, 1.04
TARGET, CUT, TRIED = 0.94, 0.005, 512
SPLIT, BUNDLE = 16_384, 128
DEGREE, BEAM = 16, 48
SALTS = 64


class Centroids:
    """Unit centroids with a neighbour graph; search() walks it from several entry points for many rows at once."""

    def __init__(self, points: np.ndarray):
        self.points = points.astype(np.float32)
        n = len(points)
        self.graph = np.empty((n, min(DEGREE, n)), np.int64)
        links = self.graph.shape[1]
        for i in range(0, n, 1024):
            self.graph[i : i + 1024] = np.argsort(-self.points[i : i + 1024] @ self.points.T, axis=1)[:, :links]
        extra = np.random.default_rng(7).integers(0, n, (n, 2))  # long links keep the graph in one piece
        self.graph = np.concatenate([self.graph, extra], axis=1)
        self.entries = np.unique(np.linspace(0, n - 1, min(n, 48)).astype(np.int64))

    def search(self, rows: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and distances of about the nearest ``want`` centroids of each row, nearest first."""
        n, want = len(self.points), min(want, len(self.points))
        beam = min(n, max(BEAM, want))
        if n <= 2 * beam:
            near = rows @ self.points.T
            best = np.argsort(-near, axis=1)[:, :want]
            return best, self._distance(np.take_along_axis(near, best, 1))
        seen = np.zeros((len(rows), n), bool)
        near = rows @ self.points[self.entries].T
        order = np.argsort(-near, axis=1)[:, :beam]
        at, value = self.entries[order], np.take_along_axis(near, order, 1)
        open_ = np.ones_like(at, bool)
        seen[:, self.entries] = True
        lines = np.arange(len(rows))[:, None]
        for _ in range(200):
            rank = np.argsort(np.where(open_, -value, np.inf), axis=1)[:, :8]
            live = np.take_along_axis(open_, rank, 1)
            if not live.any():
                break
            open_[lines, rank] = False
            step = self.graph[np.take_along_axis(at, rank, 1)].reshape(len(rows), -1)
            step.sort(axis=1)
            fresh = ~seen[lines, step] & np.repeat(live.any(axis=1), step.shape[1]).reshape(step.shape)
            fresh[:, 1:] &= step[:, 1:] != step[:, :-1]
            seen[lines, step] = True
            score = np.where(fresh, np.einsum("rd,rkd->rk", rows, self.points[step]), -np.inf)
            at, value, open_ = np.concatenate([at, step], 1), np.concatenate([value, score], 1), np.concatenate([open_, fresh], 1)
            best = np.argsort(-value, axis=1)[:, :beam]
            at, value, open_ = (np.take_along_axis(x, best, 1) for x in (at, value, open_))
            open_ &= np.isfinite(value)
        return at[:, :want], self._distance(value[:, :want])

    @staticmethod
    def _distance(product: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0, 2 - 2 * product))


def _lengthened(vectors: np.ndarray, norm: float) -> np.ndarray:
    """Unit rows: vectors / norm with one more coordinate for the length that is missing."""
    scaled = vectors / norm
    rest = np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", scaled, scaled)))
    return np.concatenate([scaled, rest[:, None]], axis=1).astype(np.float32)


def _plain(vectors: np.ndarray, norm: float) -> np.ndarray:
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return np.concatenate([vectors / length[:, None], np.zeros((len(vectors), 1))], axis=1).astype(np.float32)


def _halved(points: np.ndarray, parts: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Means of about ``parts`` equally large parts: each cut runs through the median between two means."""
    if parts <= 1 or len(points) < 2 * MIN_PART:
        mean = points.mean(axis=0)
        return [mean / max(np.linalg.norm(mean), 1e-12)]
    pair = points[rng.choice(len(points), 2, replace=False)]
    for _ in range(6):
        along = points @ (pair[0] - pair[1])
        left = along >= np.median(along)
        if left.all() or not left.any():
            left = np.arange(len(points)) % 2 == 0
        pair = np.stack([points[left].mean(axis=0), points[~left].mean(axis=0)])
    return _halved(points[left], parts // 2, rng) + _halved(points[~left], parts - parts // 2, rng)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _classes(vectors: DataFrame, k: int, id_col: str, vector_col: str) -> DataFrame:
    """Distinct usable vectors with their k + 1 smallest ids."""
    usable = F.size("v") > 0
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where("id is not null and v is not null").where(usable & ~bad).where(F.exists("v", lambda x: x != 0))
    merged = lambda c: F.slice(F.array_sort(F.flatten(F.collect_list(c))), 1, k + 1)
    key = F.xxhash64("v").alias("key")
    # A class of any size: ids go to salted groups first, each cut to the k + 1 smallest.
    ids = rows.select("v", key, "id").distinct().groupBy("key", "v", (F.xxhash64("id") % SALTS).alias("salt"))
    return ids.agg(F.slice(F.array_sort(F.collect_list("id")), 1, k + 1).alias("ids")).groupBy("key", "v").agg(merged("ids").alias("ids"))


@dataclass
class Index:
    """Posting lists over all vectors; search() reads them."""

    classes: DataFrame  # class, v, ids: distinct vectors
    lists: DataFrame  # list, bundle, piece, class, v
    sizes: DataFrame  # list, bundle, rows, pieces: a row a centroid
    centroids: Broadcast
    norm: float
    ratio: float  # lists up to this multiple of the nearest centroid's distance are read
    most: int  # lists that a query reads at most
    rows: int


def _reach(centroids: Centroids, points: np.ndarray, target: float, k: int) -> tuple[float, int]:
    """(ratio, lists): up to which ratio of the nearest distance, and up to how many lists, sampled rows must read to find ``target`` of their nearest sampled rows."""
    n = len(centroids.points)
    if target >= 1 or n == 1 or len(points) <= k + 1:
        return float("inf"), n
    asked = np.random.default_rng(9).choice(len(points), min(TRIED, len(points)), replace=False)
    best, ratios, ranks = [], [], []
    for at in range(0, len(asked), 64):
        own = asked[at : at + 64]
        near = points[own] @ points.T
        near[np.arange(len(own)), own] = -np.inf
        best.append(np.argpartition(-near, k, axis=1)[:, :k])
    best = np.concatenate(best)
    rows, back = np.unique(best, return_inverse=True)
    home = []
    for at in range(0, len(rows), 512):
        place, far = centroids.search(points[rows[at : at + 512]], REPLICAS)
        home.append(np.where(far <= CLOSURE * far[:, :1] + 1e-7, place, place[:, :1]))
    home = np.concatenate(home)[back.reshape(best.shape)]
    for at in range(0, len(asked), 64):
        far = centroids._distance(points[asked[at : at + 64]] @ centroids.points.T)
        lines = np.arange(len(far))[:, None, None]
        rank = np.empty(far.shape, np.int64)
        np.put_along_axis(rank, np.argsort(far, axis=1), np.arange(n)[None, :], axis=1)
        ranks.append(rank[lines, home[at : at + 64]].min(axis=2))
        ratios.append(far[lines, home[at : at + 64]].min(axis=2) / np.maximum(far.min(axis=1, keepdims=True), 1e-6))
    return max(1.0, float(np.quantile(np.concatenate(ratios), 1 - CUT))) + 1e-6, min(n, int(np.quantile(np.concatenate(ranks), target)) + 2)


def build_index(vectors: DataFrame, *, k: int = 20, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> Index | None:
    """Post every usable vector; None if there is none. ``k``: the most answers that a query will want."""
    spark = vectors.sparkSession
    classes = _classes(vectors, k, id_col, vector_col)
    classes = materialize(classes.withColumn("class", F.element_at("ids", 1)).drop("key"))
    square = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
    facts = classes.agg(F.count("*").alias("n"), F.max(square).alias("m")).first()
    if not facts["n"]:
        return None
    norm = float(np.sqrt(facts["m"])) * (1 + 1e-9)
    share = min(1.0, 1.3 * SAMPLE / facts["n"] + 1e-4)
    sample = classes.where(F.pmod(F.xxhash64("class", F.lit(11)), F.lit(1_000_000)) < share * 1e6).select("v").limit(SAMPLE)
    points = _lengthened(_matrix(sample.toArrow()["v"]), norm)
    parts = max(1, min(facts["n"] // LIST_ROWS, len(points) // MIN_PART))
    found = Centroids(np.array(_halved(points, parts, np.random.default_rng(5))))
    ratio, most = _reach(found, points, target, k)
    shared = spark.sparkContext.broadcast(found)  # at most SAMPLE / MIN_PART rows

    def post(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                place, far = shared.value.search(_lengthened(_matrix(part.column("v")), norm), REPLICAS)
                keep = far <= CLOSURE * far[:, :1] + 1e-7
                own = pa.array(np.repeat(np.arange(part.num_rows), keep.sum(axis=1)))
                yield pa.RecordBatch.from_pydict({"list": place[keep], "class": part.column("class").take(own), "v": part.column("v").take(own)})

    posted = materialize(in_arrow(classes.select("class", "v"), post, "list long, class long, v array<double>"))
    bundle = F.floor(F.col("list") / BUNDLE).alias("bundle")
    counts = posted.groupBy("list").agg(F.count("*").alias("rows")).select("list", bundle, "rows")
    sizes = materialize(counts.withColumn("pieces", F.ceil(F.sum("rows").over(Window.partitionBy("bundle")) / SPLIT)), 1)
    members = posted.join(F.broadcast(sizes.drop("rows")), "list").withColumn("piece", F.pmod(F.xxhash64("class"), F.col("pieces")))
    return Index(classes, members.select("list", "bundle", "piece", "class", "v"), sizes, shared, norm, ratio, most, facts["n"])


def _probes(index: Index, asking: DataFrame) -> DataFrame:
    """(query, v, bundle, lists): the lists that each query class (class, v) reads, by bundle."""
    centroids, norm, ratio, most = index.centroids, index.norm, index.ratio, index.most

    def probe(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                place, far = centroids.value.search(_plain(_matrix(part.column("v")), norm), most)
                own, at_ = np.nonzero(far <= ratio * far[:, :1] + 1e-7)
                lists = place[own, at_]
                order = np.lexsort((lists, own))
                own, lists = own[order], lists[order]
                heads = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (lists[1:] // BUNDLE != lists[:-1] // BUNDLE))) if len(own) else own
                row = pa.array(own[heads])
                cuts = pa.array(np.append(heads, len(own)).astype(np.int32))
                yield pa.RecordBatch.from_pydict({"query": part.column("class").take(row), "v": part.column("v").take(row), "bundle": lists[heads] // BUNDLE, "lists": pa.ListArray.from_arrays(cuts, pa.array(lists))})

    return in_arrow(asking, probe, "query long, v array<double>, bundle long, lists array<long>")


def work(index: Index, queries: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding") -> float:
    """Products that the queries take, replicas included, as a share of comparing each with all distinct vectors."""
    wanted = _query_classes(queries, index.classes, id_col, vector_col).select("class").distinct()
    asking = index.classes.join(wanted, "class", "left_semi").select("class", "v")
    read = _probes(index, asking).select(F.explode("lists").alias("list")).join(F.broadcast(index.sizes), "list").agg(F.sum("rows")).first()[0]
    return (read or 0) / max(1, asking.count() * index.rows)


def search(index: Index, queries: DataFrame, *, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each query row, as far as its lists hold them."""
    wanted = materialize(_query_classes(queries, index.classes, id_col, vector_col))
    asking = index.classes.join(wanted.select("class").distinct(), "class", "left_semi").select("class", "v")
    pieces = index.sizes.select("bundle", "pieces").distinct()
    probes = _probes(index, asking).join(F.broadcast(pieces), "bundle")
    probes = probes.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))

    def scan(keys, have, ask):
        out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        base, ids, place = (_matrix(have["v"]), have["class"].to_numpy(), have["list"].to_numpy() % BUNDLE) if have.num_rows else (None, out[0][0], out[0][0])
        members = [np.flatnonzero(place == one) for one in range(BUNDLE)]
        named = ask["query"].to_numpy()
        for at in range(0, ask.num_rows if have.num_rows else 0, 512):
            part = ask.slice(at, 512)
            lists, vectors = part["lists"].combine_chunks(), _matrix(part["v"])
            wants, flat = np.repeat(np.arange(part.num_rows), pc.list_value_length(lists).to_numpy()), lists.flatten().to_numpy() % BUNDLE
            least, seen = np.full(part.num_rows, -np.inf), []
            for one in np.unique(flat):  # products of the lists that are read, no others
                rows, own = wants[flat == one], members[one]
                if len(own):
                    score = vectors[rows] @ base[own].T
                    if len(own) > k + 1:  # one list holds k + 1 vectors that are no worse
                        least[rows] = np.maximum(least[rows], -np.partition(-score, k, axis=1)[:, k])
                    seen.append((rows, own, score))
            some = []
            for rows, own, score in seen:
                i, j = np.nonzero(score >= least[rows][:, None])  # with all that tie with the last
                some.append((rows[i], ids[own[j]], score[i, j]))
            if not some:
                continue
            q, c, s = (np.concatenate(x) for x in zip(*some, strict=True))
            order = np.lexsort((c, -s, q))
            q, c, s = q[order], c[order], s[order]
            fresh = np.append(True, (q[1:] != q[:-1]) | (c[1:] != c[:-1]))[: len(q)]  # replicas stand side by side
            q, c, s = q[fresh], c[fresh], s[fresh]
            keep = np.arange(len(q)) - np.searchsorted(q, q) <= k
            out.append((named[at : at + 512][q[keep]], c[keep], s[keep]))
        q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table({"query": q, "class": c, "score": s})

    by = lambda df: df.groupBy("bundle", "piece")
    found = by(index.lists).cogroup(by(probes.select("bundle", "piece", "query", "v", "lists"))).applyInArrow(scan, "query long, class long, score double")
    found = found.groupBy("query", "class").agg(F.max("score").alias("score"))
    top = Window.partitionBy("query").orderBy(F.desc("score"), "class")
    found = found.withColumn("r", F.row_number().over(top)).where(f"r <= {k + 1}").drop("r")
    each = found.join(index.classes.select("class", "ids"), "class").withColumn("vec_id", F.explode("ids"))
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, k + 1)
    lists = each.groupBy("query").agg(best.alias("best")).select(F.col("query").alias("class"), "best")
    answers = wanted.join(lists, "class").withColumn("best", F.slice(F.filter("best", lambda x: x["vec_id"] != F.col("id")), 1, k))
    answers = answers.select(F.col("id").alias("query_id"), F.posexplode("best").alias("p", "x"))
    return answers.select("query_id", (F.col("p") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.s")).alias("score"))


def nearest(vectors: DataFrame, queries: DataFrame, *, k: int = 20, target: float = TARGET, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each query row, by inner product in double precision.

    Query rows are rows of ``vectors``. Rows whose vector is null, empty, all zero or holds null or non-finite parts take
    no part on either side, nor do rows with a null id. All vectors have one length. Ties go to the smaller id. Repeated
    rows count once. With fewer than k other rows all are returned; empty tables give no rows. Only the id and vector
    columns are read, so other columns can have any name.
    """
    index = build_index(vectors, k=k, target=target, id_col=id_col, vector_col=vector_col)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, queries, k=k, id_col=id_col, vector_col=vector_col)


def _query_classes(queries: DataFrame, classes: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, class) of every query row with a usable vector."""
    rows = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v")).where("id is not null").distinct()
    return rows.join(classes.select("class", "v"), "v").select("id", "class")


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact answers (query_id, vec_id) that were found."""
    total = exact.count()
    return exact.join(found, ["query_id", "vec_id"], "left_semi").count() / total if total else 1.0
