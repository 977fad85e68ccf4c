"""Questions, solutions and true answers of evaluation records, by the dataset that a record is of; and answers of model output.

A record is a JSON text. What a dataset's fields mean is a CASE on its name; all results are column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.answers import final_answer
from corpusloom.functions.canonical import canonical_answer, chosen_choice, once, replaced
from corpusloom.functions.text import stripped

# Names of datasets and the fields in which they keep solutions and answers.
CHOICES = ("mmlu_stem", "sat_math", "aqua", "gaokao2023")
KEEP_UNITS = ("carp_en", "minerva_math")
SOLVED = ("math", "minerva_math")
PLAIN = ("aime24", "aime25", "amc23", "cmath", "gaokao2024_I", "gaokao2024_II", "imo2024")
DOLLARS = ("gaokao2023en", "college_math", "gaokao_math_cloze")
CHOSEN = ("gaokao2024_mix", "cn_middle_school")
FIELDS = {"svamp": ("Equation", "Answer"), "carp_en": ("steps", "answer"), "mawps": (None, "target"), "sat_math": (None, "Answer"), "aqua": (None, "correct"), "gaokao_math_qa": (None, "label")}
QUESTIONS = ("question", "problem", "Question", "input")


def extracted_answer(text: Column, dataset: Column) -> Column:
    """The canonical answer that a model's text gives: a letter for sets of choices, else its final answer; blank if there is none."""
    text = F.replace(text, F.lit("ки"), F.lit(""))
    found = final_answer(text)
    letters = F.regexp_extract_all(F.upper(found), F.lit(r"(?U)\b(A|B|C|D|E)\b"), F.lit(1))
    lettered = once(letters, lambda x: F.when(F.size(x) > 0, F.element_at(x, -1)).otherwise(F.regexp_replace(stripped(found), r"^\.+|\.+\z", "")))
    found = F.when(dataset.contains("mmlu"), lettered).otherwise(found)
    canonical = F.when(dataset.isin(*KEEP_UNITS), canonical_answer(found, skip_unit=True)).otherwise(canonical_answer(found))
    return F.when(dataset.isin(*CHOICES), chosen_choice(text)).otherwise(canonical)


def _field(record: Column, name: str) -> Column:
    return F.try_variant_get(record, f"$.{name}", "string")


def _parted(text: Column, mark: str) -> tuple[Column, Column]:
    """What stands before the first mark, and between it and the next; split_part, which makes a pattern of its mark for every row, gives the same."""
    return F.substring_index(text, mark, 1), F.regexp_extract(text, rf"(?s){mark}(.*?)(?:{mark}|\z)", 1)


def _as_number(text: Column) -> Column:
    """A number as its shortest text: quotients of whole numbers, commas, percents."""
    top, bottom = (part.try_cast("bigint") for part in _parted(text, "/"))
    decimal = lambda t, by: F.regexp_replace((t.try_cast("decimal(30,12)") / by).cast("decimal(38,14)").cast("string"), r"\.?0+\z", "")
    plain = F.when(text.contains(","), decimal(F.replace(text, F.lit(","), F.lit("")), 1)).when(text.contains("%"), decimal(_parted(text, "%")[0], 100)).otherwise(decimal(text, 1))
    return F.when(text.contains("/"), F.try_divide(top, bottom).cast("string")).otherwise(plain)


def ground_truth(record: Column, dataset: Column) -> Column:
    """struct(solution, answer) of a JSON record; the answer is canonical. Null for a dataset or a record that is not known."""
    return once(F.try_parse_json(record), lambda v: _truth(v, dataset))


def question_text(record: Column, dataset: Column) -> Column:
    """The question of a JSON record with its choices, and a hint for questions of true or false and of yes or no."""
    return once(F.try_parse_json(record), lambda v: once(_truth(v, dataset)["answer"], lambda answer: _question(v, dataset, answer)))


def record_texts(record: Column, dataset: Column) -> Column:
    """struct(solution, answer, question) of a JSON record, which is parsed once, and whose answer is worked out once."""

    def texts(v: Column) -> Column:
        return once(_truth(v, dataset), lambda t: F.struct(t["solution"].alias("solution"), t["answer"].alias("answer"), _question(v, dataset, t["answer"]).alias("question")))

    return once(F.try_parse_json(record), texts)


def _truth(v: Column, dataset: Column) -> Column:
    get = lambda name: _field(v, name)
    none = F.lit(None).cast("string")
    letter = F.get(F.array(*map(F.lit, "ABCD")), get("answer").try_cast("int"))
    numeric = get("ans_type").isin("integer_number", "decimal_number")
    answers = {
        ("gsm8k",): _parted(get("answer"), "####"),
        ("asdiv",): (get("formula"), F.regexp_replace(get("answer"), r"\(.*?\)", "")),
        ("tabmwp",): (get("solution"), F.when(numeric, once(get("answer"), _as_number)).otherwise(get("answer"))),
        ("mmlu_stem",): (none, letter),
        ("olympiadbench",): (none, F.regexp_replace(F.try_variant_get(v, "$.final_answer[0]", "string"), r"^\$+|\$+\z", "")),
        SOLVED: (get("solution"), once(get("solution"), lambda t: extracted_answer(t, dataset))),
        DOLLARS: (none, stripped(F.replace(get("answer"), F.lit("$"), F.lit("")))),
        CHOSEN: (none, F.when(F.length(get("choice_answer")) > 0, get("choice_answer")).otherwise(get("answer"))),
        PLAIN: (none, get("answer")),
        **{(name,): (get(cot) if cot else none, get(answer)) for name, (cot, answer) in FIELDS.items()},
    }
    # the names are told apart once for both
    found = None
    for names, (cot, gt) in answers.items():
        pair = F.struct(cot.alias("solution"), gt.alias("answer"))
        found = F.when(dataset.isin(*names), pair) if found is None else found.when(dataset.isin(*names), pair)

    def settled(p: Column) -> Column:
        signs = replaced(p["answer"], (("\\neq", "\\ne"), ("\\leq", "\\le"), ("\\geq", "\\ge")))
        return F.struct(stripped(p["solution"]).alias("solution"), F.when(dataset.isin(*KEEP_UNITS), signs).otherwise(canonical_answer(p["answer"])).alias("answer"))

    return once(found, settled)


def _question(v: Column, dataset: Column, answer: Column) -> Column:
    get = lambda name: _field(v, name)
    own = F.coalesce(*[get(name) for name in QUESTIONS])
    body = once(stripped(get("Body")), lambda t: F.concat(t, F.when(t.endswith("."), "").otherwise(".")))
    title = once(get("table_title"), lambda t: F.when(F.length(t) > 0, F.concat(F.lit('regarding "'), t, F.lit('" '))).otherwise(""))
    listed = F.to_json(F.try_variant_get(v, "$.choices", "array<string>"))
    pick = F.when(F.try_variant_get(v, "$.choices", "array<string>").isNotNull(), F.concat(F.lit(" Please select from the following options: "), listed)).otherwise("")
    four = F.array_join(F.transform(F.arrays_zip(F.array(*map(F.lit, "ABCD")).alias("l"), F.try_variant_get(v, "$.choices", "array<string>").alias("o")), lambda x: F.concat(F.lit("("), x["l"], F.lit(") "), stripped(x["o"]))), " ")
    sat = F.regexp_replace(F.concat(F.lit("("), stripped(get("options"))), r" ([BCD])\) ", " ($1) ")
    aqua = stripped(F.replace(F.replace(F.concat(F.lit("("), F.array_join(F.try_variant_get(v, "$.options", "array<string>"), "(")), F.lit("("), F.lit(" (")), F.lit(")"), F.lit(") ")))
    named = F.array_join(F.transform(F.map_entries(F.try_variant_get(v, "$.options", "map<string,string>")), lambda x: F.concat(F.lit("("), x["key"], F.lit(") "), x["value"])), " ")
    with_choices = lambda head, options: F.concat(stripped(get("question")), F.lit(f"\n{head}: "), options)
    found = (
        F.when(dataset == "asdiv", F.concat_ws(" ", stripped(get("body")), stripped(get("question"))))
        .when(dataset == "svamp", F.concat(body, F.lit(" "), stripped(get("Question"))))
        .when(dataset == "tabmwp", F.concat(F.lit("Read the following table "), title, F.lit("and answer a question:\n"), get("table"), F.lit("\n"), get("question"), pick))
        .when(dataset == "carp_en", get("content")).when(dataset == "mmlu_stem", with_choices("Answer Choices", four)).when(dataset == "sat_math", with_choices("Answer Choices", sat))
        .when(dataset.contains("aqua"), with_choices("Answer Choices", aqua)).when(dataset == "gaokao_math_qa", with_choices("选项", named)).otherwise(own)
    )
    truth = F.lower(answer)
    hint = F.when(truth.isin("true", "false"), " (True or False)").when(truth.isin("yes", "no"), " (Yes or No)").otherwise("")
    return stripped(F.concat(found, hint))
