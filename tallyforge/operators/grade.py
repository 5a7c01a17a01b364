"""Grading drivers: generations under the current rule set, and the older experiments."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.extract import answers_match, extract_answer, result, scope_for_condition
from tallyforge.functions.legacy import audit_class, audit_fingerprint, audit_judge, grade_ablation, grade_eval20
from tallyforge.operators.runs import succeeded
from tallyforge.schemas import unused_name
from tallyforge.operators.sandbox import grade_code_rows

TYPED = "extraction_version string"
#: Answer types of the first experiment's twenty tasks, with labels or, for code, the function and its tests. Fixed values.
TASK_SPECS: dict[int, dict] = {
    1: {"type": "number"},
    2: {"type": "number"},
    3: {"type": "number"},
    4: {"type": "number"},
    5: {"type": "name"},
    6: {"type": "yesno"},
    7: {"type": "yesno"},
    8: {"type": "name"},
    9: {"type": "label", "labels": ["negative", "positive", "neutral"]},
    10: {"type": "label", "labels": ["negative", "positive", "neutral"]},
    11: {"type": "label", "labels": ["not spam", "spam"]},
    12: {"type": "label", "labels": ["biology", "physics", "history"]},
    13: {"type": "string"},
    14: {"type": "string"},
    15: {"type": "string"},
    16: {"type": "code", "fn": "add", "tests": [[[2, 3], 5], [[-1, 4], 3], [[0, 0], 0]]},
    17: {"type": "code", "fn": "is_even", "tests": [[[4], True], [[7], False], [[0], True]]},
    18: {"type": "code", "fn": "max_of_two", "tests": [[[3, 9], 9], [[10, 5], 10], [[-2, -3], -2]]},
    19: {"type": "code", "fn": "reverse_list", "tests": [[[[1, 2, 3]], [3, 2, 1]], [[[]], []], [[["a"]], ["a"]]]},
    20: {"type": "number"},
}
CONDITIONS = ("base_zero_shot", "base_few_shot", "instruct_zero_shot", "instruct_few_shot")


def checked_join(rows: DataFrame, tasks: DataFrame, key: str = "problem_id", task_key: str = "id") -> DataFrame:
    """Rows with their tasks; a row whose task does not exist is an error. ``tasks`` is the task table, whose size a benchmark bounds."""
    mark, task = (unused_name(f"_{n}", rows.columns, tasks.columns) for n in ("known", "task"))
    marked = tasks.withColumn(mark, F.lit(True)).withColumnRenamed(task_key, task)
    joined = rows.join(marked, rows[key] == marked[task], "left")
    known = F.when(F.col(mark), F.col(task)).otherwise(F.raise_error(F.concat(F.lit("unknown task id "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast("long"))
    return joined.withColumn(task, known).filter(F.col(task).isNotNull()).drop(mark, task)


def grade_generations(generations: DataFrame, tasks: DataFrame, *, run_code: bool = False) -> DataFrame:
    """Predictions: extraction of the answer by type and scope, and whether it matches the gold.

    Records with an error are unparsed with the flag generation_error. Code
    answers are executed only with ``run_code``; else they are unparsed with
    the flag code_not_run. A ``log_position`` of the records is handed on.
    """
    facts = tasks.select("id", "category", "answer_type", "labels", "code_tests", "gold_answer")
    rows = checked_join(generations.drop("category"), facts)
    failed, is_code = ~succeeded(F.col("error")), F.col("answer_type") == "code"
    flags = lambda name: F.array(F.lit(name))
    text = extract_answer(F.coalesce("completion_text", F.lit("")), F.col("answer_type"), scope_for_condition(F.col("condition")), F.col("labels"), F.col("gold_answer"))
    if run_code:
        # text answers do not enter the sandbox: they carry no tests, and their text is left behind
        shown = rows.withColumn("_text", F.col("completion_text")).withColumn("completion_text", F.when(is_code & ~failed, F.col("completion_text")).otherwise(F.lit("")))
        rows = grade_code_rows(shown.withColumn("code_tests", F.coalesce("code_tests", F.lit('{"fn": "", "tests": []}'))), enabled=True).withColumn("completion_text", F.col("_text")).drop("_text")
        code = result(F.when(F.col("code_grade.extracted").isNotNull(), "parsed").otherwise("unparsed"), string=F.col("code_grade.extracted"), strategy="exec", flags=F.col("code_grade.flags"))
        code_right = F.coalesce(F.col("code_grade.correct"), F.lit(False))
    else:
        code, code_right = result("unparsed", strategy="exec", flags=flags("code_not_run")), F.lit(False)
    graded = rows.withColumn("extraction", F.when(failed, result("unparsed", flags=flags("generation_error"))).when(is_code, code).otherwise(text))
    correct = F.when(failed, False).when(is_code, code_right).otherwise(answers_match(F.col("extraction"), F.col("gold_answer"), F.col("answer_type")))
    placed = [c for c in ("log_position",) if c in generations.columns]
    kept = [*placed, "problem_id", "model_id", "condition", "sample_index", "seed", "gold_answer", "answer_type", "n_output_tokens", "category", "completion_text"]
    return graded.withColumn("correct", correct).select(*kept, "extraction.*", "correct")


def parse_failures(predictions: DataFrame) -> DataFrame:
    return predictions.filter("status <> 'parsed'")


def unpivot_conditions(wide: DataFrame, conditions: Sequence[str] = CONDITIONS, value: str = "output") -> DataFrame:
    """One row for each task and condition of a wide table."""
    ids = [c for c in wide.columns if c not in conditions]
    return wide.unpivot(ids, list(conditions), "condition", value)


def _spec_columns(task: Column, specs: Mapping[int, Mapping]) -> tuple[Column, Column, Column]:
    import json

    kind = F.create_map(*[F.lit(x) for i, s in specs.items() for x in (i, s["type"])])
    labels = F.create_map(*[x for i, s in specs.items() for x in (F.lit(i), F.array(*map(F.lit, s.get("labels", ["-"]))))])
    tests = F.create_map(*[F.lit(x) for i, s in specs.items() for x in (i, json.dumps({"fn": s.get("fn", ""), "tests": s.get("tests", [])}))])
    return F.try_element_at(kind, task), F.try_element_at(labels, task), F.try_element_at(tests, task)


def grade_legacy(cells: DataFrame, rule_set: str, *, specs: Mapping[int, Mapping] = TASK_SPECS, run_code: bool = False, overrides: DataFrame | None = None) -> DataFrame:
    """Cells (task_id, category, difficulty, gold_answer, condition, output) graded by ``eval20`` or ``ablation``.

    Adds answer_type, auto_correct, extracted_num, extracted_str, flags, and
    final_correct and overridden after human corrections.
    """
    grade = {"eval20": grade_eval20, "ablation": grade_ablation}[rule_set]
    task = F.col("task_id").cast("int")
    kind, labels, tests = _spec_columns(task, specs)
    rows = cells.withColumns({"answer_type": kind, "_labels": labels, "code_tests": tests})
    text = F.coalesce("output", F.lit(""))
    rows = rows.withColumn("g", grade(text, F.col("gold_answer"), F.col("answer_type"), F.col("_labels"), F.col("condition")))
    if run_code:
        is_code = F.col("answer_type") == "code"
        rows = grade_code_rows(rows.withColumn("completion_text", F.when(is_code, text).otherwise(F.lit(""))), enabled=True, review=True)
        coded = F.struct(F.coalesce("code_grade.correct", F.lit(False)).alias("correct"), F.lit(None).cast("double").alias("extracted_num"), F.col("code_grade.extracted").alias("extracted_str"), F.col("code_grade.flags").alias("flags"))
        rows = rows.withColumn("g", F.when(is_code, coded).otherwise(F.col("g"))).drop("completion_text", "code_grade")
    graded = rows.select(*cells.columns, "answer_type", F.coalesce("g.correct", F.lit(False)).alias("auto_correct"), "g.extracted_num", "g.extracted_str", "g.flags")
    return apply_overrides(graded, overrides)


def apply_overrides(graded: DataFrame, overrides: DataFrame | None) -> DataFrame:
    """final_correct, overridden and override_reason: a correction wins over the automatic verdict; two of one cell are an error when rows are read."""
    if overrides is None:
        return graded.withColumns({"final_correct": F.col("auto_correct"), "overridden": F.lit(False), "override_reason": F.lit(None).cast("string")})
    twice = F.raise_error(F.concat(F.lit("several corrections of task "), F.col("task_id").cast("string"), F.lit(" "), F.col("condition")))
    one = F.max(F.struct("correct", "reason"))
    given = overrides.groupBy("task_id", "condition").agg(F.count(F.lit(1)).alias("n"), one.alias("one"))
    fixed = given.select("task_id", "condition", F.when(F.col("n") > 1, twice.cast("boolean")).otherwise(F.col("one.correct")).alias("_fixed"), F.col("one.reason").alias("override_reason"))
    joined = graded.join(fixed, ["task_id", "condition"], "left")
    return joined.withColumns({"final_correct": F.coalesce("_fixed", "auto_correct"), "overridden": F.col("_fixed").isNotNull()}).select(*graded.columns, "final_correct", "overridden", "override_reason")


def needs_review(graded: DataFrame) -> DataFrame:
    return graded.filter(F.array_contains("flags", "needs_review") & ~F.col("overridden"))


def audit_candidates(wide: DataFrame, few_shot: str, zero_shot: str) -> tuple[DataFrame, DataFrame]:
    """Tasks that few-shot gets wrong and zero-shot right; code tasks apart, for review by hand."""
    judged = wide.withColumns({
        "few_verdict": audit_judge(F.col(few_shot), F.col("gold_answer"), F.col("category"), F.lit(True)),
        "zero_verdict": audit_judge(F.col(zero_shot), F.col("gold_answer"), F.col("category"), F.lit(False)),
    })
    return judged.filter("few_verdict = 'wrong' AND zero_verdict = 'correct'"), judged.filter("category = 'code'")


def audit_samples(samples: DataFrame, keys: Sequence[str] = ("task_id",)) -> DataFrame:
    """Stability of failures from resampled outputs (keys, category, gold_answer, output): n_samples, n_correct, unique_wrong_answers, verdict."""
    judged = samples.withColumns({
        "sample_verdict": audit_judge(F.col("output"), F.col("gold_answer"), F.col("category"), F.lit(True)),
        "fingerprint": audit_fingerprint(F.col("output"), F.col("gold_answer"), F.lit(True)),
    })
    wrong = F.collect_set(F.when(F.col("sample_verdict") == "wrong", F.col("fingerprint")))
    summed = judged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_samples"), F.count_if(F.col("sample_verdict") == "correct").alias("n_correct"), F.array_sort(wrong).alias("unique_wrong_answers"))
    return summed.withColumn("verdict", audit_class(F.col("n_correct"), F.col("n_samples"), F.size("unique_wrong_answers")))
