"""Canonical answers and their equality on literals."""

import re

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import canonical as C

FORMS = {
    " 5. ": "5",
    "\\dfrac12": "\\frac{1}{2}",
    "\\tfrac{3}{4}": "\\frac{3}{4}",
    "\\frac1{72}": "\\frac{1}{72}",
    "\\frac": "\\frac",
    "\\frac1": "\\frac1",
    "3/4": "\\frac{3}{4}",
    "03/4": "03/4",
    "-3/sqrt2": "\\frac{-3}{sqrt2}",
    "1/2/3": "1/2/3",
    "\\sqrt3": "\\sqrt{3}",
    "x=\\sqrt 2": "\\sqrt2",
    "k = 7": "7",
    "abc=7": "abc=7",
    "12.000": "12",
    "12.50": "12.50",
    "3.0x": "3x",
    ".5": "0.5",
    "50\\%": "50",
    "\\$1,234": "1,234",
    "10\\text{ miles}": "10",
    "\\text{ miles}": "",
    "45^\\circ": "45",
    "90^{\\circ}": "90",
    "7 km": "7",
    "5 sq. meters": "50",
    "km": "km",
    "twenty-one": "21",
    "one hundred five": "105",
    "two thousand three hundred": "2300",
    "three apples": "3",
    "007": "7",
    "\\left(1, 2\\right)": "(1,2)",
    "\\begin{array}{cc}1&2\\end{array}": "\\begin{pmatrix}1&2\\end{pmatrix}",
    "\\begin{bmatrix}1\\end{bmatrix}": "\\begin{pmatrix}1\\end{pmatrix}",
    "(-\\infty,\\infty)": "\\mathbb{R}",
    "infinity": "\\infty",
    "x\\in[1,2]": "[1,2]",
    "2j": "2i",
    "a \\neq b": "\\neb",
    "\\emptyset": "{}",
    "\\mathbf{v}": "{v}",
    "3\\mbox{ cm}": "3",
    "": "",
}

EQUAL = [
    ("1,000", "1000.0"), ("50%", "0.5"), ("50", "0.5"), ("0.5", "50"), ("0.33333", "0.33334"), ("(A)", "A"), ("the answer is B or C", "B"), ("x=5", "5"), ("5", "x=5.0"), ("(1, 2)", "(1,2.0)"), ("[1,2]", "[1.0, 2]"),
    ("{1,2}", "1,2"), ("(3)", "3"), ("\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", "\\begin{pmatrix}1.0 & 2\\\\ 3&4\\\\\\end{pmatrix}"), ("\\frac{1}{2}", "\\frac12"[:5] + "{1}{2}"), (" Yes", "yes "), ("-0.5", "-50%"),
]
UNEQUAL = [
    ("1", "2"), ("1", "1.001"), ("(1,2)", "(2,1)"), ("(1,2)", "(1,2,3)"), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2\\end{pmatrix}"), ("", ""[:0] + "0"), (None, "1"), ("1", None), (None, None),
    ("B", "C"), ("abc=5", "5"), ("1/3", "0.333"), ("-5", "5"), ("1d", "1"),
]


def test_forms(spark):
    rows = spark.createDataFrame([(t,) for t in [*FORMS, None]], "t string").select("t", C.canonical_answer(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == FORMS | {None: None}


def test_units_can_stay(spark):
    assert spark.range(1).select(C.canonical_answer(F.lit("7 km"), skip_unit=True)).first()[0] == "7km"


@pytest.mark.parametrize(("pairs", "want"), [(EQUAL, True), (UNEQUAL, False)])
def test_equality(spark, pairs, want):
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", C.answers_equal(F.col("a"), F.col("b")).alias("e")).collect()
    assert [(r.a, r.b) for r in rows if r.e is not want] == []


def test_choices_and_units(spark):
    said = {"\nchoice is (b).\n": "B", "answer is A\n\nanswer is C": "A", "maybe A, rather D": "D", "none / ": "none ", "x.": "x", "": ""}
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", C.chosen_choice(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == said
    units = {"3\\pi": "3*3.14", "\\pi": "3.14", "5%": "5/100", "$3": "3", "20°C": "20", "7°": "7", "{π}": "{3.14}"}
    rows = spark.createDataFrame([(t,) for t in units], "t string").select("t", C.clean_units(F.col("t")).alias("c")).collect()
    assert {r.t: r.c for r in rows} == units


def test_units_are_sought_at_little_cost():
    """All units make one pattern that reads their beginnings once, and a unit is only tried where its words can come up."""
    units = [*C.UNITS, *(u + "s" for u in C.UNITS)]
    found = C._any_of(dict.fromkeys(units))
    assert C._any_of(["ab", "ac", "a"]) == "a(?:b|c)?"
    for text in [*units, *(u + "x" for u in units), *(u[1:] for u in units), "", "q ;", "p x m"]:
        assert bool(re.fullmatch(found, text)) == any(re.fullmatch(u, text) for u in units), text
    assert [C._sought(u) for u in ("sq m", "m sqaure", "q .", "p . m", "v â € ™")] == ["sq m", "m sqaure", "q", "p", "v"]


def test_few_steps_give_the_form_of_all(spark):
    """Numbers stay as they are, and texts without a backslash get by few steps what they get by all."""
    texts = [*FORMS, "0", "-12", "0.5", "-30.05", "1" * 40, "x = j", "inf", "infinity and 1.0", "- 1 / 2", "1.50 .", "{.5", "tfrac", "dfrac12", "xsqrt2/3", "a.0b", "-0.50", "+1", "1\n", "and", ". ."]
    t = F.regexp_replace("t", r"(?U)^\s+|\s+\z", "")
    rows = spark.createDataFrame([(t,) for t in texts if "\\" not in t], "t string").select(t.alias("t"))
    got = rows.select("t", C._of_latex(F.col("t"), False).alias("all"), C._of_plain(F.col("t"), False).alias("few"), C.canonical_answer(F.col("t")).alias("c")).collect()
    assert [r.t for r in got if not r.all == r.few == r.c] == []
    assert [r.t for r in got if re.fullmatch(C._SETTLED[1:-2], r.t) and r.c != r.t] == [] and re.fullmatch(C._SETTLED[1:-2], "-30.05")
