"""Column functions over text: normalising, tokens, n-grams, answers, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that are tokens by themselves (CJK ideographs, kana, hangul).
SINGLE = r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]"
# Stems that tell of motion.
MOTION = "walk run move travel enter exit leave approach cross drive ride climb descend turn return arrive depart follow trajectory".split()


def stripped(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, r"\A\s+|\s+\z", "")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalized(text: Column) -> Column:
    """Lower case, marks to spaces, white space collapsed."""
    return collapsed(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "))


def tokens(text: Column) -> Column:
    """Words of the normalised text; every CJK letter is a word. Null and blank texts have none."""
    parts = F.split(F.regexp_replace(normalized(text), f"({SINGLE})", " $1 "), r"\s+")
    return F.filter(F.coalesce(parts, F.array().cast("array<string>")), lambda t: t != "")


def ngrams(words: Column, n: int) -> Column:
    """Distinct runs of n words; fewer words make one gram, none make no gram."""
    n = max(2, n)
    size = F.size(words)
    long = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), size - n + 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.when(size >= n, long).when(size > 0, F.array(F.array_join(words, " "))).otherwise(none))


def folded_answer(text: Column) -> Column:
    """Answers compare without case and by single spaces; sharp s counts as ss."""
    return F.replace(F.lower(collapsed(text)), F.lit("ß"), F.lit("ss"))


def content_tokens(text: Column) -> Column:
    found = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda t: F.length(t) > 2)
    return F.array_distinct(found)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two token arrays, 0 if either is empty."""
    union = F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def benchmark_answer(text: Column) -> Column:
    """Final answers without box, dollar signs around them, commas and one last full stop; blank ones are null."""
    x = stripped(F.regexp_replace(stripped(text), r"(?s)\A\\boxed\{(.*)\}\z", "$1"))
    x = F.replace(stripped(F.regexp_replace(x, r"\A\$+|\$+\z", "")), F.lit(","), F.lit(""))
    return F.nullif(stripped(F.regexp_replace(x, r"\.\z", "")), F.lit(""))


def answer_letter(text: Column) -> Column:
    """A to D: right after an explicit marker, else leading with a mark behind it, else the last one that stands alone; null if there is none."""
    up = F.upper(stripped(F.coalesce(text, F.lit(""))))
    found = lambda p: F.nullif(F.regexp_extract(up, p, 1), F.lit(""))
    word = r"[\p{L}\p{N}_]"
    marked = found(rf"(?:ANSWER|OPTION|CHOICE|FINAL)\s*[:：]?\s*[*`#\[]?\s*([ABCD])(?!{word})")
    return F.coalesce(marked, found(r"\A[*`#\[]?\s*([ABCD])[.)：:]"), found(rf"(?s)\A(?:.*[^\p{{L}}\p{{N}}_])?([ABCD])(?!{word})"))


def bounded(text: Column, size: int, marker: str = " ... ") -> Column:
    """At most ``size`` characters: a third from the head, the rest from the tail, the marker between."""
    room = size - len(marker)
    head = room // 3
    tail = room - head
    return F.when(F.length(text) <= size, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(marker), F.substr(text, F.length(text) - tail + 1)))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def without_query(url: Column) -> Column:
    """Address without query, fragment and credentials."""
    return F.regexp_replace(F.regexp_replace(url, "[?#].*$", ""), "://[^/@]*@", "://")


def has_motion(text: Column) -> Column:
    return text.rlike(rf"(?i)(?<![\p{{L}}\p{{N}}_])(?:{'|'.join(MOTION)})")


def clipped(value: Column) -> Column:
    """Within 0 and 1; nulls and NaN count as 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(value.cast("double"), F.lit(0.0)), F.lit(0.0))))


def unit(vector: Column) -> Column:
    """The vector at length 1, in double precision; null for the zero vector."""
    v = vector.cast("array<double>")
    square = F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    # the length stands in an array of one, so it is computed once and not for every component
    scaled = F.element_at(F.transform(F.array(F.sqrt(square)), lambda n: F.transform(v, lambda x: x / n)), 1)
    return F.when(square > 0, scaled)
