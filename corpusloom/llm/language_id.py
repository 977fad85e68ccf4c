"""Language of web pages by Bayesian fusion of evidence.

Four sources are multiplied: the likelihood of the text under byte-trigram models, the language that the markup
declares, the suffix of the address's host, and a prior of the host. Declared languages and suffixes count by how often
they go with each language over all pages, and host priors are smoothed from host to domain to all pages. These three
are grouped sums of the pages' text-only posteriors, so they are learned without labels; a page's own share is taken
out of its host's prior. All pages enter; sums are pre-aggregated per task, and hot hosts are split by the adaptive join.

The trigram models are fitted on about ``FIT_ROWS`` labelled texts of each language at most, chosen by hash, in one
fixed-size table a language; languages are counted over all labelled rows, and each has one text at least.

A null page or address is missing evidence and changes nothing; a page without any has the prior of all pages. Rows with a
null language or text are not learned from. With no labelled text there are no languages and every result is null.
Repeated rows get equal results. Empty tables give empty results.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import LOWER, in_arrow, materialize, mix, slices, utf8

FIT_ROWS, CELLS = 8192, 1 << 16
TRUST = 60.0  # trigrams of one text stand for at most so many independent ones
HOST_WEIGHT, DOMAIN_WEIGHT, EVIDENCE_WEIGHT = 4.0, 8.0, 2.0
GROUP = 256
_DROP = re.compile(r"(?is)<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<[^>]*(?:>|\Z)")  # what nothing closes takes the rest


@dataclass
class Model:
    languages: list[str]
    logs: np.ndarray  # (languages, CELLS): log-probability of each trigram cell


def _cells(column) -> tuple[np.ndarray, np.ndarray]:
    """Cells of the letter trigrams of each row (digits and marks count as spaces), and the row of each."""
    data, offsets = utf8(column)
    kinds = LOWER[data]
    kinds = np.where((kinds >= 97) & (kinds <= 122) | (kinds >= 128), kinds, 32).astype(np.uint64)
    if len(kinds) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    gram = kinds[:-2] << np.uint64(16) | kinds[1:-1] << np.uint64(8) | kinds[2:]
    row = np.searchsorted(offsets, np.arange(len(gram)), side="right") - 1
    good = (np.arange(len(gram)) + 3 <= offsets[row + 1]) & ~((kinds[:-2] == 32) & (kinds[1:-1] == 32)) & ~((kinds[1:-1] == 32) & (kinds[2:] == 32))
    return (mix(gram[good]) & np.uint64(CELLS - 1)).astype(np.int64), row[good]


def _total(part: pa.Table) -> pa.Table:
    """Counts of one language over tasks, or over groups of them."""
    total = np.zeros(CELLS)
    for counts in part["counts"]:
        total += np.frombuffer(counts.as_buffer(), np.float32)
    return pa.table({"lang": part["lang"][:1], "counts": pa.array([total.astype(np.float32).tobytes()], pa.binary())})


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", fit_rows: int = FIT_ROWS) -> Model:
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where("text is not null and lang is not null")
    place = F.pmod(F.xxhash64("id"), F.lit(1 << 40))
    bounds = rows.groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least"))
    bounds = bounds.select("lang", F.greatest(F.col("least"), F.least(F.lit(1.0), F.lit(fit_rows) / F.col("n")) * float(1 << 40)).alias("bound"))
    chosen = rows.join(F.broadcast(bounds), "lang").where(place <= F.col("bound")).select("text", "lang")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for part in slices(batches, "text"):
            cell, row = _cells(part["text"])
            langs = np.array(part["lang"].to_pylist(), object)
            for lang in set(langs.tolist()):
                sums[lang] = sums.get(lang, np.zeros(CELLS, np.int64)) + np.bincount(cell[langs[row] == lang], minlength=CELLS)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(list(sums), pa.string()), "part": pa.array([TaskContext.get().partitionId() // GROUP] * len(sums), pa.int32()), "counts": pa.array([v.astype(np.float32).tobytes() for v in sums.values()], pa.binary())})

    total: dict[str, np.ndarray] = {}
    summed = in_arrow(chosen, count, "lang string, part int, counts binary")
    for keys in (("lang", "part"), ("lang",)):  # no group holds more than the counts of GROUP tasks, or of as many such groups as there are
        summed = summed.groupBy(*keys).applyInArrow(_total, "lang string, counts binary")
    for r in summed.toLocalIterator():  # a row of CELLS counts a language
        total[r["lang"]] = total.get(r["lang"], 0) + np.frombuffer(r["counts"], np.float32).astype(np.float64)
    languages = sorted(total)
    counts = np.array([total[x] for x in languages]).reshape(len(languages), CELLS) + 0.05
    return Model(languages, np.log(counts / counts.sum(axis=1, keepdims=True)))


def identify(pages: DataFrame, model: Model, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, lang, probability, text_lang, text_probability and declared of every row."""
    langs = model.languages
    k = len(langs)
    shared = pages.sparkSession.sparkContext.broadcast(model)  # fixed size

    def likelihoods(batches):
        m = shared.value
        for part in slices(batches, "html"):
            texts = pa.array([_DROP.sub(" ", h or "") for h in part["html"].to_pylist()], pa.string())
            cell, row = _cells(texts)
            counts = np.bincount(row, minlength=part.num_rows)
            logs = np.zeros((part.num_rows, len(m.languages)))
            for j in range(len(m.languages)):
                logs[:, j] = np.bincount(row, m.logs[j][cell], minlength=part.num_rows)
            logs *= (np.minimum(counts, TRUST) / np.maximum(counts, 1))[:, None]
            logs -= logs.max(axis=1, keepdims=True, initial=-np.inf) if logs.shape[1] else 0
            out = part.drop_columns(["html"]).append_column("logs", pa.array(list(logs), pa.list_(pa.float64())))
            yield from out.to_batches()

    lower = lambda c: F.lower(F.trim(c))
    host = F.nullif(lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    declared = F.nullif(lower(F.regexp_extract(F.col(html_col), r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1)), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), declared.alias("declared"), F.col(html_col).alias("html"))
    rows = in_arrow(rows, likelihoods, "page_id long, url string, host string, declared string, logs array<double>")
    if not k:
        empty = F.lit(None)
        return rows.select("page_id", "url", empty.cast("string").alias("lang"), empty.cast("double").alias("probability"), empty.cast("string").alias("text_lang"), empty.cast("double").alias("text_probability"), "declared")
    label = F.split("host", r"\.")
    rows = rows.withColumn("domain", F.concat_ws(".", F.slice(label, F.greatest(F.lit(1), F.size(label) - 1), 2)))
    rows = rows.withColumn("domain", F.when(F.col("host").isNotNull(), F.col("domain"))).withColumn("suffix", F.element_at(label, -1))
    rows = materialize(rows.withColumn("post", _softmax("logs")))

    sums = lambda: F.array(*[F.sum(F.col("post")[j]) for j in range(k)])
    whole = rows.agg(*[F.sum(F.col("post")[j]).alias(f"s{j}") for j in range(k)]).first()
    share = np.array([(whole[j] or 0.0) + 1.0 for j in range(k)])
    overall = F.array(*[F.lit(float(x)) for x in share / share.sum()])
    total = F.array(*[F.lit(float(x)) for x in share])
    for name in ("declared", "suffix"):
        seen = rows.where(F.col(name).isNotNull()).groupBy(name).agg(sums().alias("n"))
        # log P(value | language): the value's share of the language's pages, smoothed by its share of all pages
        every = F.aggregate("n", F.lit(0.0), lambda s, x: s + x) / float(share.sum())
        evidence = seen.select(name, F.zip_with("n", total, lambda n, t: F.log((n + EVIDENCE_WEIGHT * every + 1e-3) / (t + EVIDENCE_WEIGHT))).alias(f"{name}_logs"))
        rows = rows.join(evidence, name, "left")
    hosts = rows.where("host is not null").groupBy("host").agg(sums().alias("host_n"))
    domains = rows.where("domain is not null").groupBy("domain").agg(sums().alias("domain_n"))
    rows = rows.join(hosts, "host", "left").join(domains, "domain", "left")
    less = lambda c: F.zip_with(F.col(c), "post", lambda n, p: F.greatest(n - p, F.lit(0.0)))
    smooth = lambda c, base, w: F.zip_with(less(c), base, lambda n, b: (n + w * b)) if c else base
    share_of = lambda c: F.transform(c, lambda x: x / F.aggregate(c, F.lit(0.0), lambda s, y: s + y))
    rows = rows.withColumn("domain_prior", F.coalesce(share_of(smooth("domain_n", overall, DOMAIN_WEIGHT)), overall))
    rows = rows.withColumn("prior", F.coalesce(share_of(smooth("host_n", F.col("domain_prior"), HOST_WEIGHT)), F.col("domain_prior")))
    none = F.array(*[F.lit(0.0)] * k)
    added = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    fused = added(added(F.col("logs"), F.transform("prior", lambda p: F.log(p + 1e-12))), added(F.coalesce("declared_logs", none), F.coalesce("suffix_logs", none)))
    rows = rows.withColumn("fused", fused).withColumn("final", _softmax("fused"))
    names = F.array(*[F.lit(x) for x in langs])
    first = lambda c: F.array_position(c, F.array_max(c)).cast("int")  # noqa: E731  ties: the first language by name
    return rows.select("page_id", "url", F.element_at(names, first("final")).alias("lang"), F.array_max("final").alias("probability"), F.element_at(names, first("post")).alias("text_lang"), F.array_max("post").alias("text_probability"), "declared")


def _softmax(name: str):
    top = F.array_max(name)
    raised = F.transform(name, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / F.aggregate(raised, F.lit(0.0), lambda s, y: s + y))
