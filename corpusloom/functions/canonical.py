r"""Answers of mathematics in one canonical form, and their equality without a symbolic step.

All are column expressions. ``canonical_answer`` rewrites LaTeX, units, fractions, roots and matrices to one form.
``answers_equal`` compares text, choices, numbers (relative 1e-4, also as a hundredth and a hundredfold), bracketed lists
and matrices by position, and the right side of ``k = ...``. Where only algebra could tell, it says false.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a unit behind or between other words, each also with an s, as patterns and in this order.
UNITS = (
    "east", "degree", "mph", "kmph", "ft", "m sqaure", " m east", "sq m", "deg", "mile", "q .", "monkey", "prime", "ratio", "profit of rs", "rd", "o", "gm", "p . m", "lb", "tile", "per", "dm", "lt", "gain", "ab", "way", "west",
    "a .", "b .", "c .", "d .", "e .", "f .", "g .", "h .", "t", "a", "h", "no change", "men", "soldier", "pie", "bc", "excess", "st", "inches", "noon", "percent", "by", "gal", "kmh", "c", "acre", "rise", "a . m", "th", "π r 2", "sq",
    "mark", "l", "toy", "coin", "sq . m", "gallon", "° f", "profit", "minw", "yr", "women", "feet", "am", "pm", "hr", "cu cm", "square", "v â € ™", "are", "rupee", "rounds", "cubic", "cc", "mtr", "s", "ohm", "number", "kmph", "day",
    "hour", "minute", "min", "second", "man", "woman", "sec", "cube", "mt", "sq inch", "mp", "∏ cm ³", "hectare", "more", "sec", "unit", "cu . m", "cm 2", "rs .", "rs", "kg", "g", "month", "km", "m", "cm", "mm", "apple", "liter",
    "loss", "yard", "pure", "year", "increase", "decrease", "d", "less", "Surface", "litre", "pi sq m", "s .", "metre", "meter", "inch",
)
# Text that is dropped, or replaced, in this order.
_BEFORE_UNITS = (("\n", ""), ("\\!", ""))
_NAMES = (("bmatrix", "pmatrix"), ("tfrac", "frac"), ("dfrac", "frac"), ("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge"), ("\\left", ""), ("\\right", ""), ("\\{", "{"), ("\\}", "}"))
_SIGNS = (("^{\\circ}", ""), ("^\\circ", ""), ("\\$", ""), ("$", ""), ("\\(", ""), ("\\)", ""))
_AFTER_TEXT = (("x=", ""), ("y=", ""), ("z=", ""), ("x\\in", ""), ("y\\in", ""), ("z\\in", ""), ("x\\to", ""), ("y\\to", ""), ("z\\to", ""), ("\\emptyset", "{}"), ("(-\\infty,\\infty)", "\\mathbb{R}"), ("\\%", ""), ("%", ""), (" .", " 0."), ("{.", "{0."))
# Number words.
_SMALL = {w: k for k, w in enumerate("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split())} | {w: 10 * k for k, w in enumerate("twenty thirty forty fifty sixty seventy eighty ninety".split(), 2)}
_LARGE = {"thousand": 10**3, "million": 10**6, "billion": 10**9}
# Fixed value: numbers that are their own canonical form, as no step below finds anything in them.
_SETTLED = r"^-?(?:0|[1-9]\d*)(?:\.\d*[1-9])?\z"
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value worked out once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def replaced(text: Column, pairs: tuple[tuple[str, str], ...]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def _unslashed(pairs: tuple[tuple[str, str], ...]) -> tuple[tuple[str, str], ...]:
    """The replacements that texts without a backslash can need."""
    return tuple(p for p in pairs if "\\" not in p[0])


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+\z", "")


def _any_of(words: Iterable[str]) -> str:
    """One pattern for all of the words, in which what they begin with alike is read once; a dot stands for any character."""
    first: dict[str, list[str]] = {}
    for w in words:
        first.setdefault(w[:1], []).append(w[1:])
    ends = "" in first
    parts = [k + _any_of(rest) for k, rest in first.items() if k]
    found = parts[0] if len(parts) == 1 and not ends else f"(?:{'|'.join(parts)})"
    return (found + "?" if ends else found) if parts else ""


def _sought(unit: str) -> str:
    """What a text must contain if a unit is ever to come up in it: the unit, or its first word if dropping others could put it together."""
    # what is dropped leaves the marks on both its sides, so only two marks side by side can be new
    return re.match(r"[^ .]*", unit.strip())[0] if re.search(r"[\W_]{2}|\.", unit) else unit


def without_units(text: Column) -> Column:
    """Unit words that stand apart are dropped, one unit after the other and twice over, unless nothing would be left."""
    units = [*UNITS, *(u + "s" for u in UNITS)]
    # each list is one literal, so the analyser does not go through hundreds of them
    listed = lambda texts: F.split(F.lit("\n".join(texts)), "\n")
    words = listed(map(_sought, units))
    patterns = F.filter(listed(rf"(?U)(^|\W){u}($|\W)" for u in units), lambda p, i: F.contains(text, words[i]))

    def drop(held: Column, pattern: Column) -> Column:
        return once(F.regexp_replace(held, pattern, F.lit("$1$2")), lambda left: F.when(left != "", left).otherwise(held))

    # most texts have none, and are read once
    apart = rf"(?U)(?:^|\W){_any_of(dict.fromkeys(units))}(?:$|\W)"
    return F.when(text.rlike(apart), F.aggregate(once(patterns, lambda p: F.concat(p, p)), text, drop)).otherwise(text)


def number_words(text: Column) -> Column:
    """The number that the number words of a text make, other words aside; digits alone lose leading zeros; texts without any stay as they are."""
    names, large = (F.str_to_map(F.lit(",".join(f"{w}:{k}" for w, k in known.items()))).cast("map<string,bigint>") for known in (_SMALL, _LARGE))
    words = F.filter(F.split(F.lower(F.replace(text, F.lit("-"), F.lit(" "))), r"\s+"), lambda w: F.map_contains_key(names, w) | F.map_contains_key(large, w) | w.isin("hundred", "point"))
    start = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("part"))

    def step(s: Column, w: Column) -> Column:
        whole = F.greatest(s["part"], F.lit(1))
        total = s["total"] + F.when(F.map_contains_key(large, w), whole * large[w]).otherwise(0)
        part = F.when(F.map_contains_key(large, w), 0).when(w == "hundred", whole * 100).otherwise(s["part"] + F.coalesce(names[w], F.lit(0)))
        return F.struct(total.alias("total"), part.cast("long").alias("part"))

    def made(found: Column) -> Column:
        number = F.aggregate(found, start, step, lambda s: s["total"] + s["part"]).cast("string")
        return F.when((F.size(found) == 0) | F.array_contains(found, "point"), text).otherwise(number)

    # every number word has three letters in a row
    return F.when(text.rlike(r"^\d+$"), F.regexp_replace(text, r"^0+(?=\d)", "")).when(text.rlike("[A-Za-z]{3}"), once(words, made)).otherwise(text)


def _fractions(text: Column) -> Column:
    r"""``\frac12`` and the like with braces; a text that ends in the middle of one stays as it is."""
    parts = F.split(text, r"\\frac", -1)
    later = lambda p: F.slice(p, 2, 1 << 30)

    def braced(p: Column) -> Column:
        first, second, rest = F.substring(p, 1, 1), F.substring(p, 2, 1), F.substring(p, 3, 1 << 30)
        b = F.when(second == "{", second).otherwise(F.concat(F.lit("{"), second, F.lit("}")))
        return F.when(p.startswith("{"), p).otherwise(F.concat(F.lit("{"), first, F.lit("}"), b, rest))

    cut = lambda p: F.exists(later(p), lambda x: ~x.startswith("{") & (F.length(x) < 2))
    return once(parts, lambda p: F.when(cut(p), text).otherwise(F.array_join(F.concat(F.slice(p, 1, 1), F.transform(later(p), braced)), "\\frac")))


def _slash(text: Column) -> Column:
    side = r"(?:0|-?[1-9]\d*|[^/]*sqrt[^/]*)"
    return F.regexp_replace(text, rf"^({side})/({side})\z", r"\\frac{$1}{$2}")


def canonical_answer(text: Column, skip_unit: bool = False) -> Column:
    """The canonical form of an answer; null stays null."""
    # most answers are numbers or have no LaTeX, and need few of the steps
    return once(_stripped(text), lambda t: F.when(t.rlike(_SETTLED), t).when(t.contains("\\"), _of_latex(t, skip_unit)).otherwise(_of_plain(t, skip_unit)))


def _of_latex(text: Column, skip_unit: bool) -> Column:
    """The canonical form of a text without white space at its ends, by all steps."""
    out = F.regexp_replace(replaced(text, _BEFORE_UNITS[:1]), r"\.+\z", "")
    out = replaced(out, _BEFORE_UNITS[1:])
    out = F.regexp_replace(F.regexp_replace(out, r"\\begin\{array\}\{.*?\}", r"\\begin{pmatrix}"), r"\\end\{array\}", r"\\end{pmatrix}")
    out = replaced(out, _NAMES)
    out = once(out, lambda t: once(_stripped(F.regexp_replace(t, r"\\text\{.*?\}\z", "")), lambda u: F.when(u != "", u).otherwise(t)))
    if not skip_unit:
        out = once(out, without_units)
    out = once(replaced(out, _SIGNS), number_words)
    out = replaced(F.regexp_replace(out, r"\\text\{(.*?)\}", "$1"), _AFTER_TEXT)
    out = F.replace(out, F.lit("infinity"), F.lit("\\infty"))
    out = once(out, lambda t: F.when(t.contains("\\infty"), t).otherwise(F.replace(t, F.lit("inf"), F.lit("\\infty"))))
    out = replaced(out, (("+\\inity", "\\infty"), ("and", ""), ("\\mathbf", "")))
    out = F.regexp_replace(out, r"\\mbox\{.*?\}", "")
    out = once(out, lambda t: F.when(t.contains("j") & ~t.contains("i"), F.replace(t, F.lit("j"), F.lit("i"))).otherwise(t))
    out = F.regexp_replace(F.regexp_replace(out, r"(\d+)\.0*([^\d])", "$1$2"), r"(\d+)\.0*\z", "$1")
    out = F.regexp_replace(out, r"^\.", "0.")
    out = F.regexp_replace(out, r"(?s)^[^=]{0,2}=([^=]*)\z", "$1")
    out = F.replace(F.regexp_replace(out, r"(?U)\\sqrt(\w+)", r"\\sqrt{$1}"), F.lit(" "), F.lit(""))
    return once(once(out, _fractions), _slash)


def _of_plain(text: Column, skip_unit: bool) -> Column:
    """What the steps come to for such a text without a backslash: none is in it until infinity gets one."""
    out = F.regexp_replace(replaced(text, _BEFORE_UNITS[:1]), r"\.+\z", "")
    out = _stripped(replaced(out, _unslashed(_NAMES)))
    if not skip_unit:
        out = once(out, without_units)
    out = replaced(once(replaced(out, _unslashed(_SIGNS)), number_words), _unslashed(_AFTER_TEXT))
    out = F.replace(out, F.lit("infinity"), F.lit("\\infty"))
    out = once(out, lambda t: F.when(t.contains("\\infty"), t).otherwise(F.replace(t, F.lit("inf"), F.lit("\\infty"))))
    out = F.replace(out, F.lit("and"), F.lit(""))

    def marked(t: Column) -> Column:
        out = F.when(t.contains("j") & ~t.contains("i"), F.replace(t, F.lit("j"), F.lit("i"))).otherwise(t)
        out = F.regexp_replace(F.regexp_replace(out, r"(\d+)\.0*([^\d])", "$1$2"), r"(\d+)\.0*\z", "$1")
        out = F.regexp_replace(F.regexp_replace(out, r"^\.", "0."), r"(?s)^[^=]{0,2}=([^=]*)\z", "$1")
        return _slash(F.replace(out, F.lit(" "), F.lit("")))

    return once(out, lambda t: F.when(t.rlike("[j.= /]"), marked(t)).otherwise(t))


def clean_units(text: Column) -> Column:
    """Pi as 3.14, a percent sign as a division, money and degree signs dropped."""
    out = F.replace(text, F.lit("\\pi"), F.lit("π"))
    for pattern, new in ((r"(?<![\d}])\\?π", "3.14"), (r"(\d)(\\?π)", "$1*3.14"), (r"\{(\\?π)\}", "3.14"), (r"\*(\\?π)", "*3.14")):
        out = F.regexp_replace(out, pattern, new)
    return replaced(out, (("%", "/100"), ("$", ""), ("¥", ""), ("°C", ""), (" C", ""), ("°", "")))


def chosen_choice(text: Column) -> Column:
    """The letter A to E that a text chooses: after "choice is" or "answer is" the first, else the last; without one, the text freed of marks around it."""
    out = F.regexp_replace(text, r"^\n+|\n+\z", "")
    many = (F.size(F.split(out, "choice is", -1)) > 2) | (F.size(F.split(out, "answer is", -1)) > 2)
    out = once(out, lambda t: F.when(many, F.split(t, "\n\n", 2)[0]).otherwise(t))
    marked = out.rlike("choice is|answer is")
    tail = F.regexp_replace(F.regexp_replace(F.element_at(F.split(out, "choice is|answer is", -1), -1), r"^\n+|\n+\z", ""), r"\.+\z", "")
    tail = F.regexp_replace(F.regexp_replace(F.regexp_replace(tail, r"/+\z", ""), r"^ +| +\z", ""), "^:+", "")
    letters = F.regexp_extract_all(F.upper(tail), F.lit(r"(?U)\b(A|B|C|D|E)\b"), F.lit(1))
    plain = F.regexp_replace(_stripped(tail), r"^\.+|\.+\z", "")
    chosen = once(letters, lambda found: F.when(F.size(found) == 0, plain).when(marked, found[0]).otherwise(F.element_at(found, -1)))
    return F.regexp_replace(F.regexp_replace(chosen, r"\.+\z", ""), r"/+\z", "")


def number(text: Column) -> Column:
    """The number of a text, commas aside; one with a percent sign is a hundredth; null if it is none."""
    plain = F.replace(text, F.lit(","), F.lit(""))
    cut = F.regexp_replace(plain, r"\\?%\z", "")
    as_double = lambda t: F.when(t.rlike(_NUMBER), F.trim(t).try_cast("double"))
    return F.coalesce(as_double(plain), F.when(plain.endswith("%"), as_double(cut) / 100))


def _close(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-4 * F.greatest(F.abs(a), F.abs(b))


def _bare(text: Column) -> Column:
    return F.regexp_replace(text, r"[{}()]", "")


def _same(a: Column, b: Column) -> Column:
    """Equality of two answers that are not taken apart. Two numbers are equal or not by their values alone."""
    letter = b.isin("A", "B", "C", "D", "E") & (chosen_choice(a) == b)
    x, y = number(a), number(b)
    values = _close(x, y) | _close(x, y / 100) | _close(x, y * 100)
    square = (a.rlike(r"(?s)^\[.*\]\z") & ~b.startswith("(")) | (a.rlike(r"(?s)^\(.*\)\z") & ~b.startswith("["))
    shed = lambda t: F.when(square, F.regexp_replace(t, r"^[\[\]()]+|[\[\]()]+\z", "")).otherwise(t)
    texts = (_stripped(a) != "") & (F.lower(_bare(shed(_stripped(a)))) == F.lower(_bare(shed(_stripped(b)))))
    return F.coalesce((F.lower(_stripped(a)) == F.lower(_stripped(b))) | letter, F.lit(False)) | F.coalesce(F.when(x.isNotNull() & y.isNotNull(), values).otherwise(texts), F.lit(False))


def _all_same(a: Column, b: Column) -> Column:
    """Whether two arrays are equal place by place."""
    return once(F.struct(a.alias("a"), b.alias("b")), lambda s: (F.size(s["a"]) == F.size(s["b"])) & F.forall(F.arrays_zip(s["a"], s["b"]), lambda p: _same(p["a"], p["b"])))


def _matrix(text: Column) -> Column:
    """The rows of a matrix, each an array of entries."""
    inner = F.regexp_replace(text, r"^\\begin\{[pb]matrix\}|\\end\{[pb]matrix\}\z", "")
    rows = F.filter(F.transform(F.split(inner, r"\\\\", -1), _stripped), lambda r: r != "")
    return F.transform(rows, lambda r: F.split(r, "&", -1))


def _apart(a: Column, b: Column) -> Column:
    """Equality as lists in brackets or as matrices, entry by entry."""
    is_list = lambda t: t.rlike(r"(?s)^[(\[].+[)\]]\z")
    entries = lambda t: F.split(F.substr(t, F.lit(2), F.length(t) - 2), ",", -1)
    is_matrix = lambda t: t.rlike(r"(?s)^\\begin\{[pb]matrix\}.*\\end\{[pb]matrix\}\z")
    shapes = lambda m: F.transform(m, lambda r: F.size(r))
    matrices = once(F.struct(_matrix(a).alias("a"), _matrix(b).alias("b")), lambda s: (shapes(s["a"]) == shapes(s["b"])) & _all_same(F.flatten(s["a"]), F.flatten(s["b"])))
    return F.when(is_list(a) & is_list(b), _all_same(entries(a), entries(b))).when(is_matrix(a) & is_matrix(b), matrices).otherwise(False)


def answers_equal(prediction: Column, truth: Column) -> Column:
    """Whether two canonical answers are equal as far as text, choice, numbers and places can tell; null is equal to nothing."""
    sides = lambda t: F.split(t, "=", -1)
    named = lambda t: (F.size(sides(t)) == 2) & (F.length(_stripped(sides(t)[0])) <= 2)
    whole = lambda a, b: _same(a, b) | _apart(_stripped(a), _stripped(b))

    def compared(s: Column) -> Column:
        a, b = s["a"], s["b"]
        right = F.when(named(a) & ~b.contains("="), whole(sides(a)[1], b)).when(named(b) & ~a.contains("="), whole(a, sides(b)[1])).otherwise(False)
        return F.when(a.isNotNull() & b.isNotNull(), whole(a, b) | right).otherwise(False)

    return once(F.struct(prediction.alias("a"), truth.alias("b")), compared)
