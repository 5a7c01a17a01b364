"""Reports at the edge: small result tables as Markdown on the driver."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def md_table(header: Sequence[str], rows: Iterable[Sequence[object]]) -> str:
    lines = [f"| {' | '.join(header)} |", f"|{'|'.join('---' for _ in header)}|"]
    lines += [f"| {' | '.join(map(str, row))} |" for row in rows]
    return "\n".join(lines)


def pivot_accuracy(cells: DataFrame, rows: str, conditions: Sequence[str], *, correct: str = "final_correct") -> DataFrame:
    """``k/n`` of every value of ``rows`` under every condition."""
    cell = F.format_string("%d/%d", F.count_if(F.col(correct)), F.count(F.lit(1)))
    return cells.groupBy(rows).pivot("condition", list(conditions)).agg(cell)


def head_to_head(pairs: DataFrame, named: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Rows of ``metrics.pairwise`` for (title, first, second), in the order given and turned round where needed."""
    spark = pairs.sparkSession
    wanted = spark.createDataFrame([(i, *n) for i, n in enumerate(named)], "place int, title string, a string, b string")
    counts = pairs.select("first", "second", "n_only_first", "n_only_second", "mcnemar_exact_p")
    turned = counts.select(F.col("second").alias("first"), F.col("first").alias("second"), F.col("n_only_second").alias("n_only_first"), F.col("n_only_first").alias("n_only_second"), "mcnemar_exact_p")
    both = counts.unionByName(turned)
    return wanted.join(both, (wanted["a"] == both["first"]) & (wanted["b"] == both["second"])).orderBy("place").select("title", "first", "second", "n_only_first", "n_only_second", "mcnemar_exact_p")


def _results_head(summary: DataFrame, pivots: Iterable[tuple[str, DataFrame]], pairs: DataFrame) -> list[str]:
    """The results page up to the cells to review, of small aggregates."""
    percent = lambda x: f"{x:.0%}"
    parts = ["# Results", "", "## Accuracy", ""]
    parts.append(md_table(["Condition", "Accuracy", "95% CI", "Correct"], [(r["condition"], f"{r['accuracy']:.2f}", f"{percent(r['ci_low'])}-{percent(r['ci_high'])}", f"{r['n_correct']}/{r['n']}") for r in summary.collect()]))
    for title, table in pivots:
        parts += ["", f"## {title}", "", md_table(table.columns, ([("-" if v is None else v) for v in r] for r in table.collect()))]
    return [*parts, "", "## Paired comparisons", "", md_table(pairs.columns, pairs.collect()), "", "## Cells to review", ""]


def results_markdown(summary: DataFrame, pivots: Iterable[tuple[str, DataFrame]], pairs: DataFrame, review: DataFrame) -> str:
    """The results page: accuracies, tables by dimension, paired tests, cells to review. All inputs are small; for more cells than the driver holds see ``results_lines``."""
    parts = [*_results_head(summary, pivots, pairs), md_table(review.columns, review.collect()) if review.columns else ""]
    return "\n".join(parts) + "\n"


def results_lines(summary: DataFrame, pivots: Iterable[tuple[str, DataFrame]], pairs: DataFrame, review: DataFrame) -> DataFrame:
    """The same page as sorted rows ``value``, for any number of cells to review, which stand in the order of their columns and do not pass the driver."""
    head = "\n".join([*_results_head(summary, pivots, pairs), md_table(review.columns, [])])
    shown = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in review.columns]), F.lit(" |"))
    cells = review.select(F.lit(1).alias("part"), F.struct(*review.columns).alias("at"), shown.alias("value"))
    first = review.sparkSession.range(1).select(F.lit(0).alias("part"), F.lit(None).cast(cells.schema["at"].dataType).alias("at"), F.lit(head).alias("value"))
    return first.union(cells).orderBy("part", "at").select("value")


def comparison_markdown(comparison: DataFrame, categories: DataFrame) -> str:
    head = ["Model", "Baseline", "Treatment", "Points"]
    rows = [(r["model_id"], f"{r['baseline_n_correct']}/{r['baseline_n']}", f"{r['treatment_n_correct']}/{r['treatment_n']}", f"{r['delta_percentage_points']:+.1f}") for r in comparison.orderBy("model_id").collect()]
    by = [(r["model_id"], r["category"], r["n"], r["baseline_correct"], r["treatment_correct"]) for r in categories.orderBy("model_id", "category").collect()]
    return "\n\n".join(["# Comparison", md_table(head, rows), "## By category", md_table(["Model", "Category", "n", "Baseline", "Treatment"], by)]) + "\n"


def comparison_page(names: tuple[str, str], comparison: DataFrame, categories: DataFrame, flips: DataFrame, parse_failures: tuple[int, int]) -> str:
    """The whole comparison of two named runs: parse failures, and for each model accuracy with interval, tokens, categories and flips.

    ``comparison``, ``categories`` and ``flips`` are ``compare.compare_runs``, ``compare.by_category`` and ``compare.flips``.
    """
    first, second = names
    parts = [f"# Comparison of {first} and {second}", f"Parse failures: {first} {parse_failures[0]}, {second} {parse_failures[1]}"]
    by, changed, models = categories.orderBy("model_id", "category").collect(), flips.orderBy("model_id", "problem_id").collect(), comparison.orderBy("model_id").collect()
    parts.append(md_table(["Model", first, second, "Points"], [(r["model_id"], f"{r['baseline_n_correct']}/{r['baseline_n']}", f"{r['treatment_n_correct']}/{r['treatment_n']}", f"{r['delta_percentage_points']:+.1f}") for r in models]))
    for r in models:
        sides = [{c: r[f"{s}_{c}"] for c in ("n", "n_correct", "accuracy", "ci_low", "ci_high", "mean_output_tokens")} for s in ("baseline", "treatment")]
        rows = [
            ("accuracy", *(f"{x['accuracy']:.1%}" for x in sides)), ("95% interval", *(f"{x['ci_low']:.3f}-{x['ci_high']:.3f}" for x in sides)),
            ("correct", *(f"{x['n_correct']}/{x['n']}" for x in sides)), ("mean output tokens", *(x["mean_output_tokens"] for x in sides)),
        ]
        parts += [f"## {r['model_id']}", md_table(["", first, second], rows)]
        parts.append(md_table(["Category", "n", first, second], [(c["category"], c["n"], c["baseline_correct"], c["treatment_correct"]) for c in by if c["model_id"] == r["model_id"]]))
        for kind, title in (("regression", "Regressions"), ("fix", "Fixes")):
            found = [f"- task {c['problem_id']} ({c['category']})" for c in changed if c["model_id"] == r["model_id"] and c["flip"] == kind]
            parts.append("\n".join([f"{title}: {len(found)}", *found]))
    return "\n\n".join(parts) + "\n"


def verdict_marks(graded: DataFrame, keys: Sequence[str], position: str, correct: str = "correct") -> DataFrame:
    """One line of ``C`` and ``.`` for each key, in order of position."""
    marks = F.array_sort(F.collect_list(F.struct(F.col(position), F.when(F.col(correct), "C").otherwise(".").alias("m"))))
    return graded.groupBy(*keys).agg(F.array_join(F.transform(marks, lambda s: s["m"]), "").alias("marks"))


def chart_data(summary: DataFrame, behavior: DataFrame) -> DataFrame:
    """Accuracy with its interval and drift rate by condition, for plotting elsewhere."""
    return summary.select("condition", "accuracy", "ci_low", "ci_high").join(behavior.select("condition", "drift_rate"), "condition")
