"""Distribution and diversity of embeddings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import unit

BLOCK_ROWS = 32_768  # vectors of a block; a task holds two blocks and the products of CHUNK_ROWS vectors with one of them
CHUNK_ROWS = 512
FEWEST_BLOCKS = 4


def _units(rows: DataFrame, vector: str, *columns) -> DataFrame:
    """``columns`` and v, the vector at length 1; null and zero vectors and those with null or non-finite components are left out."""
    return rows.select(*columns, unit(F.col(vector)).alias("v")).where("v is not null").where(~F.exists("v", F.isnan))


def _block_pairs(x: DataFrame, y: DataFrame, key: str):
    """Cogroups of every block of x with every block of y. Rows are dealt to blocks by a hash of ``key``, so no block grows with the input."""
    blocks = [max(FEWEST_BLOCKS, -(-side.count() // BLOCK_ROWS)) for side in (x, y)]

    def dealt(side: DataFrame, own: int) -> DataFrame:
        names = ("xb", "yb") if own == 0 else ("yb", "xb")
        side = side.withColumn(names[0], F.pmod(F.xxhash64(key), F.lit(blocks[own])))
        return side.withColumn(names[1], F.explode(F.sequence(F.lit(0), F.lit(blocks[1 - own] - 1)).cast("array<long>")))

    other = dealt(y, 1)
    other = other.select("xb", "yb", *[F.col(c).alias(f"y_{c}") for c in y.columns])  # columns of its own, as x and y may be the same rows
    return dealt(x, 0).groupBy("xb", "yb").cogroup(other.groupBy("xb", "yb"))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.array(column.tolist(), np.float64)


def _kernel_sum(x: DataFrame, y: DataFrame, sigma: float) -> float:
    """Sum of the kernel over all pairs of the weighted vectors."""

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"s": []}, dtype=np.float64)
        x, y, w, total = _matrix(a["v"]), _matrix(b["y_v"]), a["w"].to_numpy(), 0.0
        for at in range(0, len(x), CHUNK_ROWS):
            kernel = np.exp((np.minimum(1, x[at : at + CHUNK_ROWS] @ y.T) - 1) / (sigma * sigma))
            total += float(w[at : at + CHUNK_ROWS] @ kernel @ b["y_w"].to_numpy())
        return pd.DataFrame({"s": [total]})

    return _block_pairs(x, y, "v").applyInPandas(met, "s double").agg(F.sum("s")).first()[0] or 0.0


def rbf_mmd(x: DataFrame, y: DataFrame, vector: str = "embedding", sigma: float = 1.0, biased: bool = True) -> float | None:
    """Squared maximum mean discrepancy of two sets of unit vectors, over all pairs in blocks; equal vectors are one with a weight.

    The work grows with the square of the sets, the memory of a task does not. None where a set has too few vectors.
    """
    wx, wy = (_units(side, vector).groupBy("v").agg(F.count("*").alias("w")) for side in (x, y))
    n, m = (side.agg(F.sum("w")).first()[0] or 0 for side in (wx, wy))
    if min(n, m) < (1 if biased else 2):
        return None
    xx, yy, xy = _kernel_sum(wx, wx, sigma), _kernel_sum(wy, wy, sigma), _kernel_sum(wx, wy, sigma)
    if biased:
        return xx / (n * n) + yy / (m * m) - 2 * xy / (n * m)
    return (xx - n) / (n * (n - 1)) + (yy - m) / (m * (m - 1)) - 2 * xy / (n * m)


def vendi(rows: DataFrame, vector: str = "embedding") -> tuple[float, float]:
    """Exponential of the entropy of the similarity spectrum, and its share of the rows, from the d x d second moment."""
    def run(parts):
        for pdf in parts:
            x = np.array(pdf["v"].tolist(), np.float64)
            yield pd.DataFrame({"i": np.arange(x.shape[1]), "row": list(x.T @ x), "n": len(x)})

    units = rows.select(unit(F.col(vector)).alias("v")).where("v is not null")
    d = units.select(F.max(F.size("v"))).first()[0]
    if not d:
        return 0.0, 0.0
    sums = units.mapInPandas(run, "i int, row array<double>, n long").groupBy("i").agg(*[F.sum(F.col("row")[j]).alias(f"c{j}") for j in range(d)], F.sum("n").alias("n")).orderBy("i").collect()
    n = sums[0]["n"]
    values = np.clip(np.linalg.eigvalsh(np.array([[r[f"c{j}"] for j in range(d)] for r in sums]) / n), 0, None)
    p = values[values > 1e-12]
    score = float(np.exp(-(p * np.log(p)).sum()))
    return score, score / n


def nearest_cosines(rows: DataFrame, id_col: str, vector: str = "embedding") -> DataFrame:
    """id and nearest: the largest cosine with a row of another id, exact, over all pairs in blocks. Rows without such a row are left out."""

    def met(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"id": np.zeros(0, np.int64), "nearest": np.zeros(0)})
        x, y, ids, y_ids, best = _matrix(a["v"]), _matrix(b["y_v"]), a["id"].to_numpy(), b["y_id"].to_numpy(), np.empty(len(a))
        both = bool(np.isin(ids, y_ids).any())  # rows of one id meet only where a block meets itself
        for at in range(0, len(x), CHUNK_ROWS):
            near = x[at : at + CHUNK_ROWS] @ y.T
            if both:
                near[ids[at : at + CHUNK_ROWS, None] == y_ids[None, :]] = -np.inf
            best[at : at + CHUNK_ROWS] = near.max(axis=1)
        return pd.DataFrame({"id": a["id"], "nearest": best})[np.isfinite(best)]

    held = _units(rows, vector, F.col(id_col).cast("long").alias("id")).where("id is not null")
    return _block_pairs(held, held, "id").applyInPandas(met, "id long, nearest double").groupBy("id").agg(F.max("nearest").alias("nearest"))


def nearest_summary(nearest: DataFrame) -> DataFrame:
    figures = [F.round(F.percentile("nearest", F.lit(p / 100)), 6).alias(f"p{p}") for p in (50, 90, 95, 99)]
    return nearest.agg(F.count("*").alias("n"), F.round(F.avg("nearest"), 6).alias("mean"), *figures)


def mean_pairwise_cosine(rows: DataFrame, d: int, vector: str = "embedding") -> DataFrame:
    """Mean cosine of all pairs from the sum vector: (|sum|^2 - n) / (n (n - 1)), one pass and no pairs."""
    sums = rows.select(unit(F.col(vector)).alias("v")).where("v is not null").agg(F.count("*").alias("n"), F.array(*[F.sum(F.col("v")[j]) for j in range(d)]).alias("s"))
    square = F.aggregate("s", F.lit(0.0), lambda a, x: a + x * x)
    return sums.select("n", F.round((square - F.col("n")) / (F.col("n") * (F.col("n") - 1)), 6).alias("mean_cosine"))


def quality_composite(mmd: float | None, vendi_ratio: float | None, p95: float | None) -> float | None:
    """Weighted mean of the parts at hand: distribution 0.4, diversity 0.3, novelty 0.3."""
    clip = lambda x: max(0.0, min(1.0, x))
    parts = [(0.4, None if mmd is None else clip(1 - mmd / 2**0.5)), (0.3, None if vendi_ratio is None else clip(vendi_ratio)), (0.3, None if p95 is None else clip((1 - p95) / 2))]
    got = [(w, v) for w, v in parts if v is not None]
    return sum(w * v for w, v in got) / sum(w for w, _ in got) if got else None
