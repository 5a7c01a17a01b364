"""Data quality of a task set: each check gives rows (task_id, rule, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.extract import ANSWER_TYPES, answers_match, extract_answer
from tallyforge.functions.prompts import cot_prompt
from tallyforge.functions.text import normalize_text, parse_number, strip

REQUIRED = ("id", "category", "difficulty", "answer_type", "prompt", "few_shot_prefix", "gold_answer")
DIFFICULTIES = ("easy", "medium", "hard")


def _found(df: DataFrame, rule: str, message: Column) -> DataFrame:
    return df.select(F.col("id").alias("task_id"), F.lit(rule).alias("rule"), message.alias("message"))


def expected_count(tasks: DataFrame, n: int) -> DataFrame:
    counted = tasks.agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") != n)
    return counted.select(F.lit(None).cast("long").alias("task_id"), F.lit("expected_count").alias("rule"), F.format_string("expected %d tasks, found %d", F.lit(n), "n").alias("message"))


def unique_ids(tasks: DataFrame) -> DataFrame:
    return _found(tasks.groupBy("id").count().filter("count > 1"), "unique_ids", F.lit("task id is not unique"))


def missing_fields(tasks: DataFrame) -> DataFrame:
    gaps = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in REQUIRED]))
    return _found(tasks.withColumn("gaps", F.array_sort(gaps)).filter(F.size("gaps") > 0), "missing_fields", F.concat(F.lit("missing fields "), F.array_join("gaps", ", ")))


def complete(tasks: DataFrame) -> DataFrame:
    """Tasks with all required fields; only these get the other checks."""
    return tasks.dropna(subset=list(REQUIRED))


def known_values(tasks: DataFrame) -> DataFrame:
    kinds = _found(tasks.filter(~F.col("answer_type").isin(*ANSWER_TYPES)), "known_values", F.concat(F.lit("unknown answer_type "), "answer_type"))
    return kinds.unionByName(_found(tasks.filter(~F.col("difficulty").isin(*DIFFICULTIES)), "known_values", F.concat(F.lit("unknown difficulty "), "difficulty")))


def label_gold(tasks: DataFrame) -> DataFrame:
    labels = tasks.filter("answer_type = 'label'")
    none = F.coalesce(F.size("labels"), F.lit(0)) < 1
    given = F.exists(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.lower(x) == F.lower("gold_answer"))
    return _found(labels.filter(none), "label_gold", F.lit("label task needs labels")).unionByName(_found(labels.filter(~given), "label_gold", F.concat(F.lit("gold not in labels: "), "gold_answer")))


def code_tests(tasks: DataFrame) -> DataFrame:
    spec = F.from_json("code_tests", "fn string, tests array<string>")
    bad = F.col("code_tests").isNull() | spec["fn"].isNull() | (F.coalesce(F.size(spec["tests"]), F.lit(0)) < 1)
    return _found(tasks.filter(F.col("answer_type") == "code").filter(bad), "code_tests", F.lit("code task needs fn and tests"))


def duplicate_prompts(tasks: DataFrame) -> DataFrame:
    """Tasks whose prompt an earlier task has, with the one before. A task set is small; the window is over one prompt."""
    before = F.lag("id").over(Window.partitionBy("prompt").orderBy("id"))
    return _found(tasks.withColumn("before", before).filter("before IS NOT NULL"), "duplicate_prompts", F.concat(F.lit("duplicate prompt of task "), F.col("before").cast("string")))


def gold_format(tasks: DataFrame) -> DataFrame:
    numbers = tasks.filter((F.col("answer_type") == "number") & parse_number(F.col("gold_answer")).isNull())
    words = tasks.filter((F.col("answer_type") == "yesno") & ~F.lower("gold_answer").isin("yes", "no"))
    return _found(numbers, "gold_format", F.concat(F.lit("numeric gold does not parse: "), "gold_answer")).unionByName(_found(words, "gold_format", F.lit("yesno gold must be yes or no")))


def self_extraction(tasks: DataFrame) -> DataFrame:
    """``Answer: <gold>`` must parse and match the gold."""
    some = tasks.filter(F.col("answer_type").isin("number", "yesno") | (F.col("answer_type") == "label") & (F.coalesce(F.size("labels"), F.lit(0)) > 0))
    answer = extract_answer(F.concat(F.lit("Answer: "), "gold_answer"), F.col("answer_type"), F.lit("full"), F.col("labels"), F.col("gold_answer"))
    checked = some.withColumn("e", answer)
    return _found(checked.filter(~answers_match(F.col("e"), F.col("gold_answer"), F.col("answer_type"))), "self_extraction", F.concat(F.lit("gold self-extraction failed: "), "e.status"))


def leaks(tasks: DataFrame) -> DataFrame:
    """Demonstration answers equal to the gold of their task; yes/no, label and code answers cannot leak this way."""
    answers = F.explode(F.regexp_extract_all("few_shot_prefix", F.lit(r"(?i)answer\s*:\s*(.+)"), F.lit(1)))
    rows = tasks.filter(F.col("answer_type").isin("number", "name", "string")).withColumn("shown", answers)
    same = F.when(F.col("answer_type") == "number", parse_number(strip(F.col("shown"))) == parse_number(F.col("gold_answer"))).otherwise(normalize_text(F.col("shown")) == normalize_text(F.col("gold_answer")))
    return _found(rows.filter(same), "leaks", F.concat(F.lit("gold is a demonstration answer: "), "gold_answer"))


CHECKS = (known_values, label_gold, code_tests, duplicate_prompts, gold_format, self_extraction, leaks)


def validate_all(tasks: DataFrame, n: int | None = None) -> DataFrame:
    """All problems of a task set; no rows means it is valid."""
    found = [unique_ids(tasks), missing_fields(tasks), *[check(complete(tasks)) for check in CHECKS]]
    if n is not None:
        found.append(expected_count(tasks, n))
    return reduce(DataFrame.unionByName, found)


def frozen(digest: str, manifest_digest: str | None) -> str:
    """The digest to store; a task set that was frozen with another one may not change."""
    if manifest_digest is not None and manifest_digest != digest:
        raise ValueError("the task set differs from its frozen digest")
    return digest


def manifest(tasks: DataFrame) -> DataFrame:
    """Counts by category and by difficulty: (dimension, value, n)."""
    both = tasks.groupingSets([["category"], ["difficulty"]], "category", "difficulty").agg(F.count(F.lit(1)).cast("long").alias("n"), F.grouping("difficulty").alias("g"))
    return both.select(F.when(F.col("g") == 1, "category").otherwise("difficulty").alias("dimension"), F.coalesce("category", "difficulty").alias("value"), "n")


def cot_audit(tasks: DataFrame) -> DataFrame:
    """Tasks, those with a closing cue, and those to which the instruction is only appended."""
    cut = F.regexp_replace("prompt", r"\s+\z", "")
    cue = cut.endswith("Answer:") | cut.endswith("Code:")
    appended = F.startswith(cot_prompt(F.col("prompt")), F.concat(cut, F.lit("\n")))
    return tasks.agg(F.count(F.lit(1)).cast("long").alias("n"), F.count_if(cue).cast("long").alias("n_had_cue"), F.count_if(appended).cast("long").alias("n_append_only"))
