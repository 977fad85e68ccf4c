"""N-gram decontamination of records against reference texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.text import ngrams, tokens

BROADCAST_BYTES = 16 << 20


def gram_index(reference: DataFrame, text_col: str = "text", n: int = 13) -> DataFrame:
    """Distinct n-grams of the reference; a shorter text is one whole gram, which only an equally short text can match."""
    return reference.select(F.explode(_grams(text_col, n)).alias("gram")).distinct()


def _grams(text_col: str, n: int):
    """N-grams with the tokens bound once: as a plain column they would be repeated in every use within the lambdas."""
    return F.element_at(F.transform(F.array(tokens(F.col(text_col))), lambda w: ngrams(w, n)), 1)


def contamination_flags(rows: DataFrame, reference: DataFrame, id_col: str, text_col: str = "text", n: int = 13) -> DataFrame:
    """id, hit and example (its smallest shared gram) of every row with text.

    All rows meet the reference by hashes of their grams; only texts that share a hash are compared gram by gram.
    """
    index = gram_index(reference, text_col, n)
    hashed = reference.select(F.explode(_gram_hashes(text_col, n)).alias("hash")).distinct()
    size = index.agg(F.count("*"), F.sum(F.octet_length("gram"))).first()
    small = lambda df, bytes_: F.broadcast(df) if bytes_ <= BROADCAST_BYTES else df
    every = rows.where(F.trim(F.col(text_col)) != "")
    near = every.withColumn("hash", F.explode(_gram_hashes(text_col, n))).select(F.col(id_col).alias("id"), "hash")
    near = near.join(small(hashed, 16 * size[0]), "hash", "left_semi").select("id").distinct()
    grams = every.select(F.col(id_col).alias("id"), text_col).join(near, "id", "left_semi").select("id", F.explode(_grams(text_col, n)).alias("gram"))
    hits = grams.join(small(index, 32 * size[0] + (size[1] or 0)), "gram", "left_semi").groupBy("id").agg(F.min("gram").alias("example"))
    return every.select(F.col(id_col).alias("id")).join(hits, "id", "left").select("id", F.col("example").isNotNull().alias("hit"), "example")


def _gram_hashes(text_col: str, n: int):
    """Hashes of the n-grams, without making their texts."""
    n = max(2, n)
    words = F.transform(F.array(tokens(F.col(text_col))), lambda w: F.transform(w, lambda x: F.xxhash64(x)))

    def runs(h):
        many = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(h) - n + 1)), lambda i: F.xxhash64(F.slice(h, i, n)))
        return F.when(F.size(h) >= n, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(F.array().cast("array<bigint>"))

    return F.element_at(F.transform(words, runs), 1)


def contamination_report(flags: DataFrame) -> DataFrame:
    hits = F.sum(F.col("hit").cast("long"))
    rate = F.when(F.count("*") > 0, hits / F.count("*")).otherwise(0.0)
    return flags.agg(F.count("*").alias("total"), F.coalesce(hits, F.lit(0)).alias("hits"), F.round(rate, 6).alias("rate"), F.min("example").alias("example"))
