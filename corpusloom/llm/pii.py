"""Personal data by bootstrapped contextual extraction, in DataFrame operations only.

Seeds are what four fixed patterns find (e-mail, IP address, payment card, phone number). The words beside a seed are
its lexical patterns: the last one, two and three before it, and the first one and two after it. Identifier-like strings
that no seed covers are candidates; they hang on patterns in the same way. So patterns and instances (distinct values)
form a graph. In each round a pattern's precision for a kind is the share of places in the corpus, among all where its
words stand beside anything at all, at which a known instance of that kind stands there, each by its weight; both sides
count every place, so copies of a text change neither against the other. A place with an unknown string of fitting form
is no proof against a pattern and counts half. Patterns with ``MIN_SUPPORT`` distinct known
instances and ``MIN_PRECISION`` are trusted. A candidate of fitting form becomes known if its trusted patterns together
(noisy-or, each kind apart, only the best pattern of each side, as longer patterns repeat shorter ones) reach
``MIN_SCORE``, and supports further patterns in the next of ``ROUNDS`` rounds. All documents enter; sums are
pre-aggregated per task.

Places are counted by words, summed within the tasks. A pattern of one word that stands at so many places that its spans
could never be the share of them that is asked for goes no further. Wider patterns are sought by the two words next to the span.

Null and empty texts have no spans. Rows with the same id are told apart by their text; repeated rows get equal
results. Positions count code points, ends are exclusive. Very long runs of digits or letters are matched without
backtracking. Columns besides id and text are not read, but redact() keeps them, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
ROUNDS, MIN_SUPPORT, MIN_PRECISION, MIN_SCORE = 3, 3, 0.6, 0.75
BROADCAST_BYTES = 8 << 20
BEFORE, AFTER = 3, 2  # words of the longest patterns

# Possessive forms of the contract's patterns. A run that fails at its start fails at all later starts, so a search may
# begin only where a run begins or the last match ended.
_LOCAL, _HOST = r"[A-Za-z0-9._%+-]", r"[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@{_HOST}++(?:\.{_HOST}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_NEEDS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
CANDIDATE = r"(?:(?<![A-Za-z0-9])|\G)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{0,4}){2,7}+|[(+]?[0-9][0-9().\x20-]{5,}[0-9]|" + rf"{_LOCAL}++(?:@|\x20?[(\[]at[)\]]\x20?){_HOST}++(?:\.{_HOST}++)*+)"
# A place inside a word where something may follow a cue without a space, with what stands before it.
_GLUED = r"(?s)(?:(?<=[^\p{L}\p{N}\s])(?=[A-Za-z0-9._%+(-])|(?<=\p{L})(?=[0-9])|(?<=[\p{L}\p{N}])(?=\+[0-9]))(?<=(\A.{1,63}|.{64}))"
_CANDIDATE_NEEDS = r"[0-9][0-9().\x20-]{5}|@|[(\[]at[)\]]|:[0-9A-Fa-f]{0,4}:"


def _found(text: Column, pattern: str, needs: str) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>>."""
    lazy = F.lit(rf"(?s)\G(.*?)(?:{pattern})")  # anchored: no search starts twice
    pairs = F.zip_with(F.regexp_extract_all(text, lazy, F.lit(1)), F.regexp_extract_all(text, lazy, F.lit(0)), lambda gap, whole: F.struct(F.length(gap).alias("skip"), F.length(whole).alias("all"), whole.alias("whole")))
    empty = F.array().cast("array<struct<start:int,end:int,value:string>>")

    def step(state, x):
        value = F.substr(x["whole"], x["skip"] + 1, x["all"] - x["skip"])
        one = F.struct((state["at"] + x["skip"]).alias("start"), (state["at"] + x["all"]).alias("end"), value.alias("value"))
        return F.struct((state["at"] + x["all"]).alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    spans = F.aggregate(pairs, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda state: state["out"])
    return F.when(text.rlike(needs), spans).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        plain = lambda x: F.regexp_replace(x, r"^0+(?=[0-9])", "")
        return F.forall(F.split(value, r"\."), lambda x: (F.length(plain(x)) <= 3) & (F.substring(plain(x), 1, 3).cast("int") <= 255))
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(12, 19) & F.call_function("luhn_check", _digits(value))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


def _fits(kind: Column, value: Column) -> Column:
    """Whether a candidate has the form of a kind."""
    n, numeric = F.length(_digits(value)), value.rlike(r"^[(+]?[0-9().\x20-]+$")
    return (
        F.when(kind == "email", value.rlike(r"@|[(\[]at[)\]]"))
        .when(kind == "ip", value.rlike("^[0-9A-Fa-f:]+$") & value.contains(":"))
        .when(kind == "card", numeric & n.between(12, 19))
        .otherwise(numeric & n.between(7, 15) & ~value.rlike(r"^[0-9]+(\.[0-9]+){3}$"))
    )


def _seeds_of(text: Column, number: int, kind: str) -> Column:
    good = F.filter(_found(text, PATTERNS[kind], _NEEDS[kind]), lambda x: _valid(kind, x["value"]))
    return F.transform(good, lambda x: F.struct(x["start"], F.lit(number).alias("kind"), x["end"], x["value"]))


def _base(text: Column) -> Column:
    """Seed spans of all kinds, by start, then kind."""
    return F.array_sort(F.concat(*[_seeds_of(text, number, kind) for number, kind in enumerate(KINDS)]))


def _contexts(text: Column, start: Column, end: Column) -> Column:
    """The lexical patterns beside a span: its last words before it, and its first words after it."""
    before = F.lower(F.substr(text, F.greatest(F.lit(1), start - 63), F.least(start, F.lit(64))))
    after = F.lower(F.substr(text, end + 1, F.lit(64)))
    # the last of 64 characters may cut a word; a word of more is no cue
    return F.concat(_before(before), _after(F.when(F.length(after) == 64, F.regexp_replace(after, r"\S+$", "")).otherwise(after)))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def _runs(words: Column, side: str, most: int) -> Column:
    """Patterns of 1 to ``most`` words at the end (side <) or at the start (side >) of ``words``."""
    size = F.size(words)
    run = lambda n: F.slice(words, size - n + 1, n) if side == "<" else F.slice(words, F.lit(1), n)
    wide = F.transform(F.sequence(F.lit(1), F.least(F.greatest(size, F.lit(1)), F.lit(most))), lambda n: F.concat(F.lit(side), F.array_join(run(n), " ")))
    return F.when(size > 0, wide).otherwise(F.array().cast("array<string>"))


def _before(text: Column) -> Column:
    return _bound(_words(text), lambda w: _runs(w, "<", BEFORE))


def _after(text: Column) -> Column:
    return _bound(_words(text), lambda w: _runs(w, ">", AFTER))


def _bound(value: Column, use) -> Column:
    """use(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("text_key", F.xxhash64("text"))


def _places(docs: DataFrame) -> DataFrame:
    """Per document its seed spans, and the other identifier-like spans; both with the patterns before them."""
    text = F.col("text")
    rows = docs.select("doc_id", "text_key", "text", _base(text).alias("base"))
    free = lambda x: ~F.exists("base", lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"]))
    rows = rows.withColumn("more", F.filter(_found(text, CANDIDATE, _CANDIDATE_NEEDS), free))
    seen = lambda c: F.transform(c, lambda x: F.struct(x["start"], x["end"], F.lower(x["value"]).alias("value"), _contexts(text, x["start"], x["end"]).alias("patterns")))
    return rows.select("doc_id", "text_key", "base", F.when(F.size("base") > 0, seen("base")).alias("seeds"), F.when(F.size("more") > 0, seen("more")).alias("candidates"))


def _near(big: DataFrame, small: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join with a materialised table of strings, sent to all tasks only if its text is small."""
    size = small.agg(F.sum(sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 32 for c in small.columns), F.lit(0)))).first()[0] or 0
    return big.join(F.broadcast(small) if size <= BROADCAST_BYTES else small, on, how)


def _counted(docs: DataFrame, hopeful: DataFrame, n: int) -> DataFrame:
    """How often the words of each hopeful pattern stand anywhere in the texts: (pattern, places).

    ``hopeful`` has pattern and most, the places at which a known instance could stand at best. A pattern with so many
    places that these are no share of MIN_PRECISION is left out as soon as that is known.
    """
    line = hopeful.select("pattern", "most", F.substring("pattern", 1, 1).alias("side"), F.split(F.expr("substring(pattern, 2)"), " ").alias("w"))
    line = materialize(line.select("pattern", "most", F.size("w").alias("width"), F.when(F.col("side") == "<", F.element_at("w", -1)).otherwise(F.col("w")[0]).alias("word"), F.when(F.col("side") == "<", F.slice("w", -2, 2)).otherwise(F.col("w")).alias("pair")), n)
    words = _words(F.lower("text"))
    # All words are summed within their tasks, so what leaves them is words, not places.
    counts = docs.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("places"))
    counts = materialize(_near(counts, materialize(line.select("word").distinct(), n), "word"), n)
    line = materialize(line.join(counts, "word", "left").withColumn("places", F.coalesce("places", F.lit(0).cast("long"))), n)
    one = line.where((F.col("width") == 1) & _enough("most", "places"))
    # Of wide patterns the two words at the span are sought together, unless the one at the span never stands alone.
    wide = line.where("width > 1 and places > 0").select("pattern", F.array_join("pair", " ").alias("pair"))
    parts = [one.select("pattern", "places")]
    if not wide.isEmpty():
        none = F.array(F.lit(None).cast("string"))
        around = _bound(words, lambda w: F.arrays_zip(w.alias("word"), F.concat(none, w).alias("b1"), F.concat(none, none, w).alias("b2")))
        seen = docs.select(F.inline(around).alias("word", "b1", "b2")).where("word is not null and b1 is not null")
        seen = _near(seen.select(F.concat_ws(" ", "b1", "word").alias("pair"), "b2"), materialize(wide.select("pair").distinct(), n), "pair", "left_semi")
        patterns = F.array(F.concat(F.lit("<"), "pair"), F.concat(F.lit(">"), "pair"), F.when(F.col("b2").isNotNull(), F.concat(F.lit("<"), F.concat_ws(" ", "b2", "pair"))))
        places = _near(seen.select(F.explode(patterns).alias("pattern")).where("pattern is not null"), wide.select("pattern"), "pattern", "left_semi")
        parts.append(places.groupBy("pattern").agg(F.count("*").alias("places")))
    left = materialize(one.select("pattern", "most").unionByName(line.where("width > 1").select("pattern", "most")), n)
    if left.isEmpty():
        return left.select("pattern", F.col("most").alias("places"))
    glued = F.flatten(F.transform(F.regexp_extract_all(F.lower("text"), F.lit(_GLUED), F.lit(1)), _before))
    parts.append(_near(docs.select(F.explode(glued).alias("pattern")), left, "pattern", "left_semi").groupBy("pattern").agg(F.count("*").alias("places")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("pattern").agg(F.sum("places").alias("places"))
    return materialize(sums.join(left, "pattern").where(_enough("most", "places") & (F.col("places") > 0)).select("pattern", "places"), n)


def _enough(most: str, places: str) -> Column:
    """Whether a pattern could reach MIN_PRECISION: its precision is at most the share of its places that spans could prove,
    as each place that becomes known adds one to the sum above and takes away half a place of doubt."""
    return F.col(most) >= MIN_PRECISION * F.col(places) - 1e-6


def discover(docs: DataFrame, places: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(found, trusted): doc_id, text_key, start, end, kind (its number) of candidates that trusted patterns reach; and
    the patterns of the last round with kind, precision and support (distinct known instances)."""
    spark, n = docs.sparkSession, places.count()
    seeds = places.where("seeds is not null").select(F.explode(F.arrays_zip("base", "seeds")).alias("x"))
    seeds = seeds.select(F.col("x.base.kind").alias("kind"), F.col("x.seeds.value").alias("value"), F.explode("x.seeds.patterns").alias("pattern")).groupBy("kind", "value", "pattern").agg(F.count("*").alias("times"))
    other = places.where("candidates is not null").select("doc_id", "text_key", F.explode("candidates").alias("x")).select("doc_id", "text_key", "x.*")
    other = materialize(other)
    edges = materialize(other.select("value", F.explode("patterns").alias("pattern")).groupBy("value", "pattern").agg(F.count("*").alias("times")), n)
    known = materialize(seeds.withColumn("weight", F.lit(1.0)), n)
    nothing = spark.createDataFrame([], "doc_id long, text_key long, start int, end int, kind int"), spark.createDataFrame([], "pattern string, kind int, precision double, support long")
    if edges.isEmpty():
        return nothing
    # Patterns that could be trusted: enough seeds, or candidates beside enough seeds later on; and beside a candidate, or
    # they can teach nothing; and enough of both for one kind. Their places are counted once.
    enough = lambda df, *by: df.groupBy(*by).agg(F.count_distinct("value").alias("n")).where(f"n >= {MIN_SUPPORT}").select("pattern")
    hopeful = enough(known, "pattern", "kind").union(enough(edges, "pattern")).distinct()
    hopeful = hopeful.join(edges.select("pattern").distinct(), "pattern", "left_semi")
    names = F.array(*map(F.lit, KINDS))
    fitting = edges.withColumn("kind", F.explode(F.array(*map(F.lit, range(len(KINDS)))))).where(_fits(F.element_at(names, F.col("kind") + 1), F.col("value")))
    proofs = known.select("pattern", "kind", "value", "times").unionByName(fitting.select("pattern", "kind", "value", "times")).groupBy("pattern", "kind").agg(F.sum("times").alias("most"), F.count_distinct("value").alias("n"))
    hopeful = materialize(hopeful.join(proofs.where(f"n >= {MIN_SUPPORT}").groupBy("pattern").agg(F.max("most").alias("most")), "pattern"), n)
    if hopeful.isEmpty():
        return nothing
    common = _counted(docs, hopeful, n)
    if common.isEmpty():
        return nothing
    fitting = materialize(fitting.join(common, "pattern", "left_semi").groupBy("pattern", "kind").agg(F.sum("times").alias("fitting")), n)
    known = known.withColumn("settled", F.lit(0).cast("long"))
    answers = None
    for _ in range(rounds):
        support = known.groupBy("pattern", "kind").agg(F.sum(F.col("weight") * F.col("times")).alias("weight"), F.sum("times").alias("known"), F.sum("settled").alias("settled"), F.count_distinct("value").alias("support")).where(f"support >= {MIN_SUPPORT}")
        open_ = F.greatest(F.lit(0), F.coalesce("fitting", F.lit(0)) - F.col("settled"))
        trusted = support.join(common, "pattern").join(fitting, ["pattern", "kind"], "left")
        trusted = trusted.select("pattern", "kind", "support", F.least(F.lit(1.0), F.col("weight") / F.greatest(F.col("places") - open_ / 2, "known")).alias("precision"))
        trusted = materialize(trusted.where(f"precision >= {MIN_PRECISION}"), n)
        reached = _near(edges, trusted, "pattern").where(_fits(F.element_at(names, F.col("kind") + 1), F.col("value")))
        reached = reached.groupBy("value", "kind", F.substring("pattern", 1, 1).alias("side")).agg(F.max("precision").alias("precision"))
        reached = reached.groupBy("value", "kind").agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("precision"), F.lit(1e-9)))))).alias("weight"))
        best = reached.groupBy("value").agg(F.max(F.struct("weight", (-F.col("kind")).alias("o"))).alias("b"))
        answers = materialize(best.where(f"b.weight >= {MIN_SCORE}").select("value", (-F.col("b.o")).alias("kind"), F.col("b.weight").alias("weight")), n)
        if answers.isEmpty():
            return nothing[0], trusted.select("pattern", "kind", "precision", "support")
        first = seeds.withColumn("weight", F.lit(1.0)).withColumn("settled", F.lit(0).cast("long"))
        known = materialize(first.unionByName(edges.join(answers, "value").select("kind", "value", "pattern", "times", "weight", F.col("times").alias("settled"))), n)
    # A known value counts where a trusted pattern of its kind stands beside it.
    held = _near(other.join(answers.select("value", "kind"), "value").withColumn("pattern", F.explode("patterns")), trusted.select("pattern", F.col("kind").alias("k")), "pattern")
    return held.where("kind = k").select("doc_id", "text_key", "start", "end", "kind").distinct(), trusted.select("pattern", "kind", "precision", "support")


def learned_patterns(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pattern (< stands before a span, > after it), kind, precision and support of what the last round trusts."""
    rows = _rows(docs, id_col, text_col)
    trusted = discover(rows, materialize(_places(rows)))[1]
    return trusted.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind") + 1))


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_key, base and spans of every row: array<struct<start, kind, end, value>>, kind as number in KINDS."""
    rows = _rows(docs, id_col, text_col)
    places = materialize(_places(rows))
    more = discover(rows, places)[0].groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("start", "kind", "end", F.lit("").alias("value"))).alias("found"))
    same = (F.col("p.text_key") == F.col("m.text_key")) & F.col("p.doc_id").eqNullSafe(F.col("m.doc_id"))
    joined = places.alias("p").join(more.alias("m"), same, "left")
    nothing = F.array().cast("array<struct<start:int,kind:int,end:int,value:string>>")
    spans = F.array_sort(F.concat("base", F.coalesce("found", nothing)))
    return joined.select("p.doc_id", "p.text_key", "base", spans.alias("spans"))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def spans_report(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts and digest of the seed spans, and all spans as kind:start:end, of every row."""
    found = find(docs, id_col=id_col, text_col=text_col)
    of_kind = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k))
    counts = [of_kind(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(_written(F.col("base")), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))


def redact(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with each span of personal data replaced by its kind in angle brackets; overlapping spans by one."""
    found = find(docs, id_col=id_col, text_col=text_col).where(F.size("spans") > 0)
    found = found.select(F.col("doc_id").alias("id"), F.col("text_key").alias("key"), "spans").dropDuplicates(["id", "key"])
    text, names = F.col("old"), F.array(*map(F.lit, KINDS))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("row_id"), F.col(text_col).alias("old"))
    rows = rows.join(found, (F.xxhash64(F.coalesce(text, F.lit(""))) == F.col("key")) & F.col("row_id").eqNullSafe(F.col("id")), "left")

    def step(state, x):
        fresh = x["start"] >= state["at"]
        piece = F.concat(F.substr(text, state["at"] + 1, x["start"] - state["at"]), F.lit("<"), F.element_at(names, x["kind"] + 1), F.lit(">"))
        return F.struct(F.greatest(state["at"], x["end"]).alias("at"), F.when(fresh, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"))

    clean = F.aggregate("spans", F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s["out"], F.substr(text, s["at"] + 1, F.length(text) - s["at"])))
    columns = [F.when(F.col("spans").isNull(), text).otherwise(clean).alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns]
    return rows.select(*columns)
