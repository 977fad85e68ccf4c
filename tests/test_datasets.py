"""Records of evaluation sets and answers of model output on literals."""

import json

from pyspark.sql import functions as F

from corpusloom.functions import datasets as D
from corpusloom.plans import catalog

TRUTHS = [
    ("math", {"solution": "We get \\boxed{\\frac12}."}, "We get \\boxed{\\frac12}.", "\\frac{1}{2}"),
    ("minerva_math", {"solution": "So $\\boxed{5 m}$"}, "So $\\boxed{5 m}$", "5m"),
    ("gsm8k", {"answer": "2+2=4 \n#### 1,004"}, "2+2=4", "1,004"),
    ("svamp", {"Equation": "( 1 + 2 )", "Answer": "3.0"}, "( 1 + 2 )", "3"),
    ("asdiv", {"formula": "1+1=2", "answer": "2 (apples)"}, "1+1=2", "2"),
    ("mawps", {"target": "7.0"}, None, "7"),
    ("tabmwp", {"solution": "s", "answer": "1/4", "ans_type": "decimal_number"}, "s", "0.25"),
    ("tabmwp", {"solution": "s", "answer": "12,345,678.50", "ans_type": "decimal_number"}, "s", "12345678.5"),
    ("tabmwp", {"solution": "s", "answer": "35%", "ans_type": "decimal_number"}, "s", "0.35"),
    ("tabmwp", {"solution": "s", "answer": "blue", "ans_type": "extractive_text"}, "s", "blue"),
    ("carp_en", {"steps": " x ", "answer": "a \\neq b"}, "x", "a \\ne b"),
    ("mmlu_stem", {"answer": 2}, None, "C"),
    ("sat_math", {"Answer": "B"}, None, "B"),
    ("college_math", {"answer": " $3/4$ "}, None, "\\frac{3}{4}"),
    ("gaokao2024_mix", {"choice_answer": "", "answer": "9"}, None, "9"),
    ("gaokao2024_mix", {"choice_answer": "C", "answer": "9"}, None, "C"),
    ("olympiadbench", {"final_answer": ["$2n$", "x"]}, None, "2n"),
    ("aime24", {"answer": "033"}, None, "33"),
    ("unknown", {"answer": "1"}, None, None),
]

QUESTIONS = [
    ("asdiv", {"body": "A. ", "question": " B?"}, "A. B?"),
    ("svamp", {"Body": "He has 2", "Question": "How many?"}, "He has 2. How many?"),
    ("tabmwp", {"table_title": "T", "table": "a|b", "question": "Q?", "choices": ["x", "y"]}, 'Read the following table regarding "T" and answer a question:\na|b\nQ? Please select from the following options: ["x","y"]'),
    ("tabmwp", {"table_title": None, "table": "a|b", "question": "Q?", "choices": None}, "Read the following table and answer a question:\na|b\nQ?"),
    ("mmlu_stem", {"question": "Q? ", "choices": ["a ", 2, "c", "d"], "answer": 0}, "Q?\nAnswer Choices: (A) a (B) 2 (C) c (D) d"),
    ("sat_math", {"question": "Q", "options": "A) 1 B) 2 C) 3 D) 4", "Answer": "A"}, "Q\nAnswer Choices: (A) 1 (B) 2 (C) 3 (D) 4"),
    ("aqua", {"question": "Q", "options": ["A)1", "B)2"], "correct": "A"}, "Q\nAnswer Choices: (A) 1 (B) 2"),
    ("gaokao_math_qa", {"question": "Q", "options": {"A": "1", "B": "2"}, "label": "A"}, "Q\n选项: (A) 1 (B) 2"),
    ("aime24", {"problem": "P ", "answer": "Yes"}, "P  (Yes or No)"),
    ("aime24", {"input": "I", "answer": "false"}, "I (True or False)"),
]

ANSWERS = [("aqua", "The answer is (B).", "B"), ("math", "so \\boxed{ 7 km }", "7"), ("minerva_math", "The final answer is $5 m$. I hope it is correct.", "5m"), ("mmlu_x", "The answer is c, surely", "C"), ("math", "it is 1,234", "1234"), ("math", "none", ""), ("math", None, None)]


def test_truths(spark):
    rows = spark.createDataFrame([(k, d, json.dumps(r)) for k, (d, r, _, _) in enumerate(TRUTHS)], "k int, d string, r string")
    got = {r.k: (r.t.solution, r.t.answer) for r in rows.select("k", D.ground_truth(F.col("r"), F.col("d")).alias("t")).collect()}
    assert {k: (TRUTHS[k], v) for k, v in got.items() if v != TRUTHS[k][2:]} == {}


def test_questions(spark):
    rows = spark.createDataFrame([(k, d, json.dumps(r)) for k, (d, r, _) in enumerate(QUESTIONS)], "k int, d string, r string")
    got = {r.k: r.q for r in rows.select("k", D.question_text(F.col("r"), F.col("d")).alias("q")).collect()}
    assert {k: v for k, v in got.items() if v != QUESTIONS[k][2]} == {}


def test_answers(spark):
    rows = spark.createDataFrame([(k, d, t) for k, (d, t, _) in enumerate(ANSWERS)], "k int, d string, t string")
    got = {r.k: r.a for r in rows.select("k", D.extracted_answer(F.col("t"), F.col("d")).alias("a")).collect()}
    assert {k: v for k, v in got.items() if v != ANSWERS[k][2]} == {}


def test_records_are_parsed_and_answered_once(spark):
    """All three texts of a record come from one parse and one answer, and are those that are asked for alone."""
    rows = [(d, json.dumps(r)) for d, r, *_ in TRUTHS + QUESTIONS] + [("gsm8k", "{"), ("svamp", "[1]"), ("math", None), (None, "{}")]
    texts = spark.createDataFrame([(k, *x) for k, x in enumerate(rows)], "k int, d string, r string").select("k", "r", "d", D.record_texts(F.col("r"), F.col("d")).alias("t"))
    alone = texts.select("k", "t", D.ground_truth(F.col("r"), F.col("d")).alias("truth"), D.question_text(F.col("r"), F.col("d")).alias("question"))
    assert [r.k for r in alone.collect() if r.t != (*r.truth, r.question)] == []
    plan = catalog.queries()["dataset_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert (plan.count("parseJson("), plan.count("$.target")) == (1, 1)
