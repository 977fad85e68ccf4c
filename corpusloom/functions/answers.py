"""Column functions that find answers in model output: last box, first JSON, final answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import stripped


def _closed_at(chars: Column, opening: Column, closing: Column, quotes: bool) -> Column:
    """Number of characters up to the one that brings the depth back to 0; null if none does. With ``quotes`` strings are passed over."""
    begin = F.struct(F.lit(0).alias("at"), F.lit(0).alias("depth"), F.lit(0).alias("end"), F.lit(False).alias("inside"), F.lit(False).alias("escaped"))

    def step(s, c):
        plain = ~s["inside"]
        depth = s["depth"] + F.when(plain & (c == opening), 1).when(plain & (c == closing), -1).otherwise(0)
        ends = (s["end"] == 0) & plain & (c == closing) & (depth == 0)
        quote = F.lit(quotes) & (c == '"') & ~s["escaped"]
        return F.struct(
            (s["at"] + 1).alias("at"), depth.alias("depth"), F.when(ends, s["at"] + 1).otherwise(s["end"]).alias("end"),
            F.when(quote, plain).otherwise(s["inside"]).alias("inside"), (s["inside"] & (c == "\\") & ~s["escaped"]).alias("escaped"),
        )

    return F.nullif(F.aggregate(chars, begin, step, lambda s: s["end"]), F.lit(0))


def last_boxed(text: Column) -> Column:
    """What the braces of the last box hold; null without a box, or if its braces don't close."""
    tail = F.regexp_extract(text, r"(?s)\A.*(\\boxed.*)\z", 1)
    size = _closed_at(F.split(tail, ""), F.lit("{"), F.lit("}"), False)
    whole = F.when(tail.startswith("\\boxed{"), F.substr(tail, F.lit(8), size - 8))
    return F.when(tail != "", stripped(whole))


def first_balanced(text: Column) -> Column:
    """The first {...} or [...] whose brackets close; brackets in strings don't count."""
    tail = F.regexp_extract(text, r"(?s)[{\[].*\z", 0)
    opening = F.substring(tail, 1, 1)
    size = _closed_at(F.split(tail, ""), opening, F.when(opening == "{", "}").otherwise("]"), True)
    return F.substr(tail, F.lit(1), size)


def first_json(text: Column) -> Column:
    """The first JSON value in a text, as text: of its first code fence, else the whole text, else the first balanced brackets; null if none parses."""
    fence = stripped(F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit("")))
    tries = [fence, first_balanced(fence), stripped(text), first_balanced(text)]
    return F.coalesce(*[F.when(F.try_parse_json(x).isNotNull(), x) for x in tries])


def final_answer(text: Column) -> Column:
    """The answer that a solution names: in the "final answer is $...$. I hope" form, else what follows the last box, else after its last
    "he answer is", "final answer is" or the Chinese marker, else its last number; blank if there is none, null for null."""
    part = lambda mark, at: F.element_at(F.split(text, mark), at)
    form = stripped(F.element_at(F.split(F.element_at(F.split(text, r"final answer is \$", 2), 2), r"\$\. I hope", 2), 1))
    tail = part("boxed", -1)
    size = _closed_at(F.split(tail, ""), F.lit("{"), F.lit("}"), False)
    box = F.when(tail.startswith("{"), F.coalesce(F.substr(tail, F.lit(2), size - 2), F.substr(tail, F.lit(2)))).otherwise(stripped(F.element_at(F.split(tail, r"\$"), 1)))
    numbers = F.regexp_extract_all(F.replace(text, F.lit(","), F.lit("")), F.lit(r"-?[0-9]*\.?[0-9]+"), F.lit(0))
    found = (
        F.when(text.contains("final answer is $") & text.contains("$. I hope"), form)
        .when(text.contains("boxed"), box)
        .when(text.contains("he answer is"), stripped(part("he answer is", -1)))
        .when(text.contains("final answer is"), stripped(part("final answer is", -1)))
        .when(text.contains("答案是"), stripped(F.element_at(F.split(stripped(part("答案是", 2)), r"\n\n"), 1)))
        .otherwise(F.when(F.size(numbers) > 0, F.element_at(numbers, -1)).otherwise(""))
    )
    for pattern in (r"\n\s*", r"\A:", r"\.\z", r"/\z"):
        found = F.regexp_replace(found, pattern, "")
    return F.when(text.isNotNull(), found)


def chosen_letter(text: Column) -> Column:
    """a to e after "answer is" (or "choice is") before any further problem; null if there is none."""
    head = F.lower(F.replace(F.element_at(F.split(text, "Problem:", 2), 1), F.lit("choice is"), F.lit("answer is")))
    return F.nullif(F.upper(F.regexp_extract(head, r"answer is \(?([abcde])\)?", 1)), F.lit(""))


def first_code(text: Column) -> Column:
    """What the first code fence of a text holds; without one the text, unless it opens a fence; null if there is nothing."""
    fence = F.regexp_extract(text, r"(?s)```(?:[a-zA-Z0-9_+-]*)[ \t]*\n(.*?)```", 1)
    fenced = text.rlike(r"(?s)```(?:[a-zA-Z0-9_+-]*)[ \t]*\n.*?```")
    plain = stripped(text)
    return F.when(fenced, stripped(fence)).when((plain != "") & ~plain.startswith("```"), plain)


def choice_prompt(question: Column, options: Column) -> Column:
    """The prompt of a multiple-choice question about a video, with its options a line each."""
    # Fixed value: the wording that answers are scored under.
    head = "Watch the video and answer the multiple-choice question. Return exactly one uppercase letter: A, B, C, or D.\n\nQuestion: "
    return F.concat(F.lit(head), question, F.lit("\n"), F.array_join(F.coalesce(options, F.array().cast("array<string>")), "\n"), F.lit("\n\nAnswer:"))
