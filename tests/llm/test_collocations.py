"""Collocations against a plain count, in one and in several blocks, and the perfect hash alone."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import collocations as C

SCHEMA = "lang string, text string, n long"


def plain(rows, least, top):
    counts, totals = Counter(), Counter()
    for lang, text, _ in rows:
        lang = "und" if lang is None else lang
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts.update((lang, tuple(w[i : i + k])) for i in range(len(w) - k + 1))
    often = {key: a for key, a in counts.items() if a >= least}
    inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
    found = {}
    for (lang, p), a in often.items():
        if len(p) == 1 or any(lang == g and len(q) > len(p) and inside(p, q) and 100 * f >= 80 * a for (g, q), f in often.items()):
            continue
        score, _, left, right = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k, counts[lang, p[:k]], counts[lang, p[k:]]) for k in range(1, len(p)))
        found.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, r + 1, p.decode(), -a, x, y, totals[lang], -s) for lang, all_ in found.items() for r, (s, a, p, x, y) in enumerate(sorted(all_)[:top]))


@pytest.fixture(scope="module")
def rows():
    pick = random.Random(3)
    word = ["a", "B", "ab", "É", "日本", "d", "e", "\x00", " "]
    glue = [" ", "  ", "\t", ". ", "\n", " , ", "\r\n"]
    text = lambda n: "".join(pick.choice(word[: pick.choice((3, 9))]) + pick.choices(glue, (20, 2, 2, 2, 1, 1, 1))[0] for _ in range(n))
    made = [(pick.choice(["en", "fr", None, "und", ""]), text(pick.randint(0, 60)), k) for k in range(120)]
    return [*made, (None, None, 1), ("en", "", 2), ("xx", " .", 3), *[("hot", "One two three four five", 4)] * 30, ("long", "q r " * 20_000, 5), ("en", "z" * 70_000, 6)]


@pytest.mark.parametrize(("block", "least", "top"), [(C.BLOCK, 30, 2000), (40, 12, 2000), (C.BLOCK, 12, 3)])
def test_against_plain(spark, rows, block, least, top):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, C.collocations(docs, least, top, block).collect())) == plain(rows, least, top)


def test_phrases_whose_owner_is_elsewhere(spark, rows, monkeypatch):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(5)
    keys = C.candidate_keys(docs.select("lang", "text"), 30)
    monkeypatch.setattr(C, "candidate_keys", lambda *_: keys.withColumn("part", C.F.when(C.F.col("part") < 0, -1).otherwise(C.F.col("part") + 3)))
    assert sorted(map(tuple, C.collocations(docs).collect())) == plain(rows, 30, 2000)


def test_without_rows(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA)
    assert C.collocations(docs.limit(0)).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert C.collocations(docs.limit(0)).count() == 0
    assert C.collocations(docs.where("text is null or text = ''")).count() == 0


def test_scores_beyond_64_bits(spark):
    rows = spark.createDataFrame([(7, "en", "x y", 3 * 10**13, [4 * 10**13, 5 * 10**13], [0, 1])], "slot long, lang string, phrase string, a long, part_counts array<long>, part_slots array<long>")
    totals = spark.createDataFrame([("en", 10**15)], "lang string, n long")
    assert C._ranked(rows, totals, 10).first().score == 2_000_000 * 3 // 9


def test_tree(spark, monkeypatch):
    monkeypatch.setattr(C, "WIDTH", 3)
    rows = spark.createDataFrame([(s, p, [p, s, 1]) for s in (0, 4) for p in range(40)], "segment int, part int, counts array<long>")
    assert sorted(map(tuple, C.tree_sum(rows).collect())) == [(0, [780, 0, 40]), (4, [780, 160, 40])]


@pytest.mark.parametrize("n", [0, 1, 63, 100_000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    find = C.PerfectHash(keys)
    assert sorted(find(keys)) == list(range(n))
    assert (find(keys + np.uint64(1 << 63)) == -1).all()
    assert n == 0 or (find.stored[find(keys)] == keys).all()
