"""Comparison of two runs over the same tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.stats import mcnemar_exact_p
from tallyforge.operators.metrics import accuracy_columns, model_summary
from tallyforge.operators.runs import dedup

KEY = ["model_id", "problem_id"]


def cell_table(predictions: DataFrame, position: str = "log_position") -> DataFrame:
    """The last record of each model and problem in the log, whatever its sample index.

    ``position`` orders the records: ``grade_run`` hands the log's order on
    under this name (see ``sources.files.log_position``).
    """
    return dedup(predictions, KEY, position, policy="last")


def last_records(predictions: DataFrame) -> DataFrame:
    """One record of each model and problem: the last by ``log_position``, else by ``sample_index``.

    Predictions with neither column have one record a cell; a second one is an
    error, raised when rows are read.
    """
    for position in ("log_position", "sample_index"):
        if position in predictions.columns:
            return cell_table(predictions, position)
    picked = predictions.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(KEY)]).agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct(*predictions.columns)).alias("_row"))
    twice = F.raise_error(F.concat(F.lit("several records of one cell and nothing to order them by: "), F.col("_k0").cast("string"), F.lit(" "), F.col("_k1").cast("string"))).cast("long")
    return picked.filter(F.when(F.col("_n") > 1, twice).otherwise(F.col("_n")) == 1).select("_row.*")


def paired(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """Both runs side by side, the last record of each cell; a problem that one of them lacks is an error, raised when rows are read."""
    sides = []
    for name, run in (("b", last_records(baseline)), ("t", last_records(treatment))):
        sides.append(run.select(*KEY, F.struct("correct", "status", "category", "n_output_tokens").alias(name)))
    both = sides[0].join(sides[1], KEY, "full")
    missing = F.concat(F.lit("predictions missing in one run: "), F.coalesce(F.col("model_id").cast("string"), F.lit("null")), F.lit(" "), F.coalesce(F.col("problem_id").cast("string"), F.lit("null")))
    guard = F.when(F.col("b").isNull() | F.col("t").isNull(), F.raise_error(missing).cast("string"))
    flip = F.when(F.col("b.correct") & ~F.col("t.correct"), "regression").when(~F.col("b.correct") & F.col("t.correct"), "fix")
    return both.select(*KEY, F.coalesce("t.category", "b.category").alias("category"), F.col("b.correct").alias("b_correct"), F.col("t.correct").alias("t_correct"), F.coalesce(guard, flip).alias("flip"))


def flips(pairs: DataFrame) -> DataFrame:
    return pairs.filter("flip IS NOT NULL").select(*KEY, "category", "flip")


def flip_lists(pairs: DataFrame) -> DataFrame:
    """Regressions and fixes of each model in the order of problem ids, with their counts and exact p.

    A model's row carries its lists, as the report wants them, so it grows with
    the flips; ``flips`` gives them as rows.
    """
    listed = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("flip") == kind, F.struct("problem_id", "category")))), lambda s: s)
    counted = pairs.groupBy("model_id").agg(
        listed("regression").alias("regressions"), listed("fix").alias("fixes"),
        F.count_if(F.col("flip") == "regression").cast("long").alias("n_regressions"), F.count_if(F.col("flip") == "fix").cast("long").alias("n_fixes"),
    )
    return counted.withColumn("mcnemar_exact_p", mcnemar_exact_p(F.col("n_regressions"), F.col("n_fixes")))


def by_category(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("model_id", "category").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.count_if("b_correct").cast("long").alias("baseline_correct"), F.count_if("t_correct").cast("long").alias("treatment_correct"), F.count_if(F.col("flip").isNotNull()).cast("long").alias("n_flips")
    )


def compare_runs(baseline: DataFrame, treatment: DataFrame) -> DataFrame:
    """Summaries of both runs by model, over the last record of each cell, with the difference of the rounded accuracies and its points."""
    sides = []
    for name, run in (("baseline", baseline), ("treatment", treatment)):
        summary = model_summary(last_records(run))
        sides.append(summary.select("model_id", *[F.col(c).alias(f"{name}_{c}") for c in summary.columns if c != "model_id"]))
    delta = F.col("treatment_accuracy") - F.col("baseline_accuracy")
    return sides[0].join(sides[1], "model_id", "full").withColumns({"delta_accuracy": F.round(delta, 3), "delta_percentage_points": F.round(delta * 100, 1)})


def inspect_records(log: DataFrame, predictions: DataFrame) -> DataFrame:
    """Records with their predictions, if there are any, and whether they are cut off or failed."""
    found = predictions.select("model_id", "problem_id", "sample_index", F.col("status").alias("prediction_status"), F.col("correct").alias("prediction_correct"))
    cut = F.coalesce(F.col("n_output_tokens") >= F.col("max_new_tokens"), F.lit(False))
    return log.join(found, ["model_id", "problem_id", "sample_index"], "left").withColumn("truncated", cut)


__all__ = ["accuracy_columns", "by_category", "cell_table", "compare_runs", "flip_lists", "flips", "inspect_records", "last_records", "paired"]
