"""Accuracy, intervals, behaviour and paired tests as aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.legacy import drifted, refused, repetition_score
from tallyforge.functions.stats import accuracy, mcnemar_exact_p, wilson_bounds
from tallyforge.functions.text import is_blank


def accuracy_columns(correct: str = "correct") -> list[Column]:
    return [F.count(F.lit(1)).cast("long").alias("n"), F.count_if(F.col(correct)).cast("long").alias("n_correct")]


def with_rates(counts: DataFrame) -> DataFrame:
    """Adds accuracy and the Wilson interval to n and n_correct."""
    low, high = wilson_bounds(F.col("n_correct"), F.col("n"))
    return counts.withColumns({"accuracy": accuracy(F.col("n_correct"), F.col("n")), "ci_low": low, "ci_high": high})


def model_summary(predictions: DataFrame, keys: Sequence[str] = ("model_id",)) -> DataFrame:
    """n, n_correct, accuracy, interval, parsed counts and mean output tokens; a missing token count is 0."""
    parsed = F.count_if(F.col("status") == "parsed").cast("long")
    counted = predictions.groupBy(*keys).agg(*accuracy_columns(), parsed.alias("n_parsed"), F.round(F.avg(F.coalesce(F.col("n_output_tokens"), F.lit(0))), 1).alias("mean_output_tokens"))
    return with_rates(counted.withColumn("n_unparsed_or_failed", F.col("n") - F.col("n_parsed")))


def model_category_rollup(predictions: DataFrame) -> DataFrame:
    """n and n_correct by model, and by model and category; the level tells total rows from null categories."""
    rolled = predictions.rollup("model_id", "category").agg(*accuracy_columns(), F.grouping_id().alias("g"))
    return rolled.filter("g < 3").select("model_id", "category", F.when(F.col("g") == 0, "category").otherwise("model").alias("level"), "n", "n_correct")


def accuracy_by(cells: DataFrame, key: str, dimensions: Sequence[str], correct: str = "final_correct") -> DataFrame:
    """Accuracy by ``key`` over all cells and over each dimension's values, in one pass: (key, dimension, value, n, n_correct, accuracy, ci_low, ci_high)."""
    levels = F.explode(F.array(F.struct(F.lit("overall").alias("dimension"), F.lit(None).cast("string").alias("value")), *[F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions]))
    # partial aggregation folds the few groups before anything moves
    return with_rates(cells.select(key, correct, levels.alias("l")).groupBy(key, "l.dimension", "l.value").agg(*accuracy_columns(correct)))


def behavior(cells: DataFrame, key: str = "condition", task: str = "task_id", output: str = "output", *, lists: bool = True) -> DataFrame:
    """Drift, repetition, refusals, empty outputs and lengths by ``key``; lists of tasks in their order, or without ``lists`` how many they hold (their rows: ``behavior_tasks``)."""
    marked = cells.select(key, task, drifted(F.col(output)).alias("drift"), repetition_score(F.col(output)).alias("repetition"), refused(F.col(output)).alias("refusal"), is_blank(F.col(output)).alias("blank"), F.length(output).alias("chars"))
    listed = (lambda c: F.array_sort(F.collect_list(F.when(F.col(c), F.col(task))))) if lists else (lambda c: F.count_if(F.col(c)).cast("long"))
    names = ("drift_tasks", "refusals", "empty_outputs") if lists else ("n_drift", "n_refusals", "n_empty_outputs")
    drift, refusals, empty = (listed(c).alias(n) for c, n in zip(("drift", "refusal", "blank"), names, strict=True))
    return marked.groupBy(key).agg(
        F.round(F.avg(F.col("drift").cast("int")), 3).alias("drift_rate"), drift, F.round(F.avg("repetition"), 3).alias("mean_repetition"),
        refusals, empty, F.round(F.avg("chars"), 1).alias("mean_chars"), F.median("chars").alias("median_chars"),
    )


def behavior_tasks(cells: DataFrame, key: str = "condition", task: str = "task_id", output: str = "output") -> DataFrame:
    """The lists of ``behavior`` as rows (key, list, task), one for each entry, for tables whose lists no single row can hold."""
    text = F.col(output)
    found = F.array(*[F.when(when, F.lit(name)) for name, when in (("drift_tasks", drifted(text)), ("refusals", refused(text)), ("empty_outputs", is_blank(text)))])
    return cells.select(key, F.explode(F.array_compact(found)).alias("list"), task)


def _paired_tasks(cells: DataFrame, conditions: Sequence[str], task: str, condition: str, correct: str) -> tuple[DataFrame, Column, Column]:
    """(a row for each task and pair of conditions, only the first is right, only the second is)."""
    wide = cells.groupBy(task).pivot(condition, list(conditions)).agg(F.max(F.col(correct).cast("int")))
    pairs = [(a, b) for i, a in enumerate(conditions) for b in conditions[i + 1 :]]
    rows = wide.select(task, F.explode(F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(f"`{a}`").alias("x"), F.col(f"`{b}`").alias("y")) for a, b in pairs])).alias("p")).select(task, "p.*")
    return rows, (F.col("x") == 1) & (F.col("y") == 0), (F.col("x") == 0) & (F.col("y") == 1)


def discordant(cells: DataFrame, conditions: Sequence[str], *, task: str = "task_id", condition: str = "condition", correct: str = "final_correct") -> DataFrame:
    """The lists of ``pairwise`` as rows (first, second, list, task)."""
    rows, only_first, only_second = _paired_tasks(cells, conditions, task, condition, correct)
    return rows.select("first", "second", F.when(only_first, "only_first_correct").when(only_second, "only_second_correct").alias("list"), task).filter("list IS NOT NULL")


def pairwise(cells: DataFrame, conditions: Sequence[str], *, task: str = "task_id", condition: str = "condition", correct: str = "final_correct", lists: bool = True) -> DataFrame:
    """Discordant tasks and exact p for every pair of the named conditions, by a pivot on the task instead of a self-join."""
    rows, only_first, only_second = _paired_tasks(cells, conditions, task, condition, correct)
    counts = [F.count_if(only_first).cast("long").alias("n_only_first"), F.count_if(only_second).cast("long").alias("n_only_second")]
    if lists:
        counts += [F.array_sort(F.collect_list(F.when(only_first, F.col(task)))).alias("only_first_correct"), F.array_sort(F.collect_list(F.when(only_second, F.col(task)))).alias("only_second_correct")]
    summed = rows.groupBy("first", "second").agg(*counts)
    return summed.withColumns({"pair": F.concat_ws("__vs__", "first", "second"), "mcnemar_exact_p": mcnemar_exact_p(F.col("n_only_first"), F.col("n_only_second"))})


def truncation_summary(log: DataFrame, key: str = "model_id") -> DataFrame:
    """Mean and most output tokens and truncated records of records without error."""
    cut = F.coalesce(F.col("n_output_tokens") >= F.col("max_new_tokens"), F.lit(False))
    return log.filter("error IS NULL OR error = ''").groupBy(key).agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.round(F.avg(F.coalesce(F.col("n_output_tokens"), F.lit(0))), 1).alias("mean_tokens"),
        F.max("n_output_tokens").cast("long").alias("max_tokens"), F.count_if(cut).cast("long").alias("n_truncated"),
    )


def majority_vote(samples: DataFrame, keys: Sequence[str], answer: str) -> DataFrame:
    """The most frequent answer of each key, the least of equals, with its votes. An addition: self-consistency over samples."""
    votes = samples.filter(F.col(answer).isNotNull()).groupBy(*keys, answer).agg(F.count(F.lit(1)).cast("long").alias("votes"))
    best = votes.groupBy(*keys).agg(F.min(F.struct((-F.col("votes")).alias("v"), F.col(answer).alias("a"))).alias("b"), F.sum("votes").cast("long").alias("n_samples"))
    return best.select(*keys, F.col("b.a").alias("answer"), (-F.col("b.v")).alias("votes"), "n_samples")


def ranked(summary: DataFrame, conditions: Sequence[str], key: str = "condition") -> DataFrame:
    """Conditions by falling accuracy, equals in the order given."""
    place = F.array_position(F.array(*map(F.lit, conditions)), F.col(key))
    return summary.orderBy(F.desc("accuracy"), place)
