"""Chunks of chat streams put together again, and trajectories of prose, programs and their outputs cut apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD = ("id", "model", "created", "system_fingerprint")
TEXTS = ("reasoning_content", "reasoning", "content")
_MESSAGE = f"struct<role: string, {', '.join(f'{t}: string' for t in TEXTS)}>"
CHUNK = f"id string, model string, created long, system_fingerprint string, usage string, choices array<struct<index: int, finish_reason: string, delta: {_MESSAGE}, message: {_MESSAGE}>>"
PIECE = 4096


def stream_chunks(bodies: DataFrame) -> DataFrame:
    """(stream, seq, chunk text) of buffered event streams (stream, body): the data lines but the closing mark, by place."""
    lines = bodies.select("stream", F.posexplode(F.split("body", r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]")).alias("seq", "line"))
    data = F.regexp_extract(F.trim("line"), r"(?s)^data:\s*(.*?)\s*$", 1)
    return lines.select("stream", F.col("seq").cast("long").alias("seq"), data.alias("chunk")).where("chunk not in ('', '[DONE]')")


def _text(field: str) -> Column:
    """The field of all members of ``p``, one after the other; nulls are left out."""
    return F.concat_ws("", F.transform("p", lambda x: x[field])).alias(field)


def _joined(rows: DataFrame, key: list[str], piece: int) -> DataFrame:
    """Texts by (key, seq) joined in order. Runs of ``piece`` numbers are joined first, so one group holds a run or the runs of a message."""
    fields = list(TEXTS)
    runs = rows.groupBy(*key, F.floor(F.col("seq") / piece).alias("run")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "place", *fields))).alias("p"), F.max_by("role", F.when(F.col("role") != "", F.struct("seq", "place"))).alias("role"), F.max(F.when(F.col("role") != "", F.struct("seq", "place"))).alias("role_at"),
        F.max_by("finish_reason", F.when(F.col("finish_reason").isNotNull(), F.struct("seq", "place"))).alias("finish_reason"), F.max(F.when(F.col("finish_reason").isNotNull(), F.struct("seq", "place"))).alias("finish_at"),
    )
    runs = runs.select(*key, "run", "role", "role_at", "finish_reason", "finish_at", *map(_text, fields))
    whole = runs.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("run", *fields))).alias("p"), F.max_by("role", "role_at").alias("role"), F.max_by("finish_reason", "finish_at").alias("finish_reason"))
    return whole.select(*key, F.coalesce("role", F.lit("assistant")).alias("role"), "finish_reason", *map(_text, fields))


def chat_messages(chunks: DataFrame, piece: int = PIECE) -> DataFrame:
    """stream, index, role, finish_reason, reasoning_content, reasoning, content: the messages of streams from (stream, seq, chunk).

    Chunks come in any order and partitioning; seq gives theirs. The last finish reason and role that are given count; texts
    are joined. Chunks that are no JSON object are left out, as are streams without a choice. A choice without index has
    its place in the chunk.
    """
    parsed = chunks.select("stream", "seq", F.from_json("chunk", CHUNK, {"mode": "PERMISSIVE"}).alias("c"))
    choices = parsed.select("stream", "seq", F.posexplode("c.choices").alias("place", "choice"))
    has = F.col("choice.delta").isNotNull() & (F.coalesce(F.to_json("choice.delta"), F.lit("{}")) != "{}")
    delta = F.when(has, F.col("choice.delta")).otherwise(F.col("choice.message"))
    rows = choices.where("choice is not null").select("stream", "seq", "place", F.coalesce("choice.index", "place").alias("index"), F.col("choice.finish_reason").alias("finish_reason"), delta.alias("d"))
    rows = rows.select("stream", "seq", "place", "index", "finish_reason", F.col("d.role").alias("role"), *[F.col(f"d.{t}").alias(t) for t in TEXTS])
    return _joined(rows, ["stream", "index"], piece)


def chat_heads(chunks: DataFrame) -> DataFrame:
    """stream, id, model, created, system_fingerprint, usage: the last of each that a stream's chunks give."""
    parsed = chunks.select("stream", "seq", F.from_json("chunk", CHUNK, {"mode": "PERMISSIVE"}).alias("c")).where("c is not null")
    last = lambda name: F.max_by(f"c.{name}", F.when(F.col(f"c.{name}").isNotNull(), F.col("seq"))).alias(name)
    return parsed.groupBy("stream").agg(*[last(n) for n in (*HEAD, "usage")])


def trajectory(text: Column) -> Column:
    r"""array of (role, content) of a text in which programs stand between ``\`\`\`python`` and ``\`\`\``` lines, each followed by its output block.

    A fold over lines; what is not closed at the end is a last block. Null where a program opens within another block, an
    empty program ends, or an output opens after text.
    """
    block = "struct<role: string, content: string>"
    start = F.struct(F.lit("rationale").alias("role"), F.lit("").alias("held"), F.array().cast(f"array<{block}>").alias("done"), F.lit(False).alias("bad"))
    lines = F.split(text, "\n")
    ended = F.transform(lines, lambda line, i: F.struct(line.alias("line"), F.when(i < F.size(lines) - 1, "\n").otherwise("").alias("end")))

    def push(s):
        return F.concat(s["done"], F.array(F.struct(s["role"].alias("role"), s["held"].alias("content"))))

    def state(role, held, done, bad):
        return F.struct(role.alias("role"), held.alias("held"), done.alias("done"), bad.alias("bad"))

    def step(s, x):
        line, lit = x["line"], F.lit
        opens = state(lit("program"), lit(""), F.when(s["held"] != "", push(s)).otherwise(s["done"]), s["bad"] | (s["role"] != "rationale"))
        closes = state(lit("output"), lit(""), push(s), s["bad"] | (s["held"] == ""))
        output = state(s["role"], s["held"], s["done"], s["bad"] | (s["held"] != ""))
        after = state(lit("rationale"), lit(""), push(s), s["bad"])
        more = state(s["role"], F.concat(s["held"], line, x["end"]), s["done"], s["bad"])
        return (
            F.when(line == "```python", opens).when((s["role"] == "program") & (line == "```"), closes).when((s["role"] == "output") & line.startswith("```output"), output)
            .when((s["role"] == "output") & (line == "```"), after).otherwise(more)
        )

    return F.aggregate(ended, start, step, lambda s: F.when(~s["bad"], F.when(s["held"] != "", push(s)).otherwise(s["done"])))


def trajectory_text(blocks: Column) -> Column:
    """The text of an array of (role, content)."""
    wrapped = lambda b: F.when(b["role"] == "program", F.concat(F.lit("```python\n"), b["content"], F.lit("```\n"))).when(b["role"] == "output", F.concat(F.lit("```output\n"), b["content"], F.lit("```\n"))).otherwise(b["content"])
    return F.concat_ws("", F.transform(blocks, wrapped))


def program_outputs(text: Column) -> Column:
    """array of the texts between ``output`` fences."""
    return F.regexp_extract_all(text, F.lit(r"(?s)```output\n(.*?)\n```"), 1)


# What an output says if its program failed.
FAILED = ("error", "exception", "no algorithms", "cannot", "nan", "...")


def last_program(text: Column) -> Column:
    """The programs of a text joined: of failed ones only the imports, put ahead; printing lines only of the last. A text that is no trajectory gives a program that says so."""
    lines = lambda program: F.split(program, "\n")
    ok = lambda output: ~F.exists(F.array(*map(F.lit, FAILED)), lambda w: F.contains(F.lower(output), w))
    no = "raise ValueError('Invalid trajectory')"

    def joined(blocks: Column) -> Column:
        ran = _ran(blocks, lines, ok)
        quiet = F.transform(ran, lambda p, i: F.when(i < F.size(ran) - 1, F.array_join(F.filter(lines(p), lambda x: ~F.trim(x).startswith("print(")), "\n")).otherwise(p))
        return F.when(blocks.isNull(), no).otherwise(F.array_join(quiet, "\n"))

    return F.transform(F.array(trajectory(text)), joined)[0]  # so that the text is parsed once


def _ran(blocks: Column, lines, ok) -> Column:
    """The programs that did not fail, the first with the imports of those that did."""
    paired = F.transform(blocks, lambda b, i: F.struct(b["role"].alias("role"), b["content"].alias("content"), F.when(i < F.size(blocks) - 1, ok(F.trim(F.get(blocks, i + 1)["content"]))).otherwise(True).alias("ran")))
    programs = F.filter(paired, lambda b: b["role"] == "program")
    imports = F.flatten(F.transform(F.filter(programs, lambda b: ~b["ran"]), lambda b: F.filter(lines(b["content"]), lambda x: x.startswith("import") | x.startswith("from"))))
    ran = F.transform(F.filter(programs, lambda b: b["ran"]), lambda b: b["content"])
    ran = F.when(F.size(ran) == 0, F.array(F.lit(""))).otherwise(ran)
    return F.transform(ran, lambda p, i: F.when((i == 0) & (F.size(imports) > 0), F.concat(F.array_join(imports, "\n"), F.lit("\n"), p)).otherwise(p))


def chat_text(message: Column, thinking: bool | str | None) -> Column:
    """The text of a message (reasoning_content, reasoning, content) under a policy of three states.

    ``omit``, null and false give the content; true puts reasoning and content into their marks, unless the content has
    them already. Without content and reasoning, or without a message, it is null.
    """
    omitted = thinking is None or isinstance(thinking, str) and thinking.strip().lower() == "omit"
    if not omitted and not isinstance(thinking, bool):
        raise TypeError("thinking is true, false, omit or None")
    content = message["content"]
    if omitted or not thinking:
        return content
    reasoning = F.coalesce(F.nullif(message["reasoning_content"], F.lit("")), F.nullif(message["reasoning"], F.lit("")))
    said = F.coalesce(content, F.lit(""))
    wrapped = F.concat(F.lit("<think>"), F.coalesce(reasoning, F.lit("")), F.lit("</think>\n<answer>"), said, F.lit("</answer>"))
    return F.when(content.isNull() & reasoning.isNull(), None).when(said.rlike(r"(?s)<think>.*?</think>.*?<answer>.*?</answer>"), said).otherwise(wrapped)
