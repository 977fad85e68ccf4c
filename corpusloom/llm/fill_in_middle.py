"""Fill-in-middle transformation by a streaming matcher that stores no units.

A text is a run of units: white space with the word after it, or white space alone at the end. The first pass only counts
the units; ranks of the two cuts are drawn from a hash of seed and id; the second pass advances a lazy match iterator to the
smaller and then to the larger rank and reads off where the matches end. Memory is that of the text itself, whatever its
number of units. Every row is on its own: no shuffle, and a lost task is simply run again with the same draws.

Odd rows: a null text counts as empty; an empty text, and one that holds a marker, stays plain. A null id draws by an empty
id. Repeated rows give equal results. Columns of the input that have the name of a result are replaced by it.
"""

from __future__ import annotations

import hashlib
import re
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import in_arrow, slices

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
RESULT = T.StructType().add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")


def draws(doc_id, seed: int) -> tuple[int, int, int, int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))


def cuts(text: str, first: int, second: int) -> tuple[int, int]:
    """Where the first and the second so many units end (first <= second), by one lazy walk."""
    ends = (m.end() for m in UNIT.finditer(text))
    low = next(islice(ends, first - 1, None)) if first else 0
    high = next(islice(ends, second - first - 1, None)) if second > first else low
    return low, high


def rearranged(text: str | None, doc_id, seed: int = 42, plain_percent: int = 50, spm_percent: int = 80) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of prefix and middle, output) of one text."""
    text = text or ""
    n = sum(1 for _ in UNIT.finditer(text))
    h1, h2, h3, h4 = draws(doc_id, seed)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= plain_percent:
        return n, "plain", None, None, text
    low, high = cuts(text, *sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h4 % 100 < spm_percent:
        return n, "spm", low, high - low, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", low, high - low, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def transform(docs: DataFrame, seed: int = 42, fim_percent: int = 50, spm_percent: int = 80) -> DataFrame:
    """All rows and columns of docs (doc_id, text, ...), with n (units), form (plain, psm or spm), prefix_chars, middle_chars and output.

    fim_percent of the rows are rearranged, spm_percent of these with the suffix first.
    """
    docs = docs.drop(*[f.name for f in RESULT])
    schema = T.StructType([*docs.schema.fields, *RESULT.fields])

    def run(batches):
        for part in slices(batches, "text"):
            rows = [rearranged(t.as_py(), i.as_py(), seed, fim_percent, spm_percent) for t, i in zip(part["text"], part["doc_id"], strict=True)]
            for column, (field, kind) in zip(zip(*rows, strict=True), (("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())), strict=True):
                part = part.append_column(field, pa.array(column, kind))
            yield from part.combine_chunks().to_batches()

    return in_arrow(docs, run, schema)


def restored(output: Column | str, form: Column | str) -> Column:
    """The text before the transformation. Markers can't stand in a rearranged text, so each is where it is found first."""
    output, form = F.col(output) if isinstance(output, str) else output, F.col(form) if isinstance(form, str) else form
    second = F.when(form == "psm", F.locate(SUFFIX, output)).otherwise(F.locate(PREFIX, output))
    third = F.locate(MIDDLE, output)
    one, two, three = output.substr(F.lit(4), second - 4), output.substr(second + 3, third - second - 3), output.substr(third + 3, F.length(output))
    return F.when(form == "psm", F.concat(one, three, two)).when(form == "spm", F.concat(two, three, one)).otherwise(output)


def report(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n, form, prefix_chars, middle_chars, and SHA-256 of the output and of the text rebuilt from it."""
    done = transform(docs.select("doc_id", "text")).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output", restored("output", "form").alias("again"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("again", 256).alias("restored_sha256"))
