"""End-to-end jobs over run folders: generate, clean up, grade, compare, validate, and the older experiments.

A run folder holds ``config.json``, the log ``generations`` (a file or folder of
JSONL, with a folder for each slice that was committed), its lock and plans, and, once graded, the Parquet tables ``predictions`` and
``parse_failures`` and the report ``metrics.json``. Only reports, which are
small aggregates, pass through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import prompts
from tallyforge.operators import compare, durable, grade, metrics, report, runs, validate
from tallyforge.sources import files

PAIRS = (("Tuning, zero-shot", "base_zero_shot", "instruct_zero_shot"), ("Few-shot, base", "base_zero_shot", "base_few_shot"), ("Few-shot, instruct", "instruct_zero_shot", "instruct_few_shot"), ("Best base and best instruct", "base_few_shot", "instruct_zero_shot"))


def rows_of(df: DataFrame) -> list[dict]:
    """A small result as plain objects."""
    return [r.asDict(recursive=True) for r in df.collect()]


def generate_run(
    spark: SparkSession, tasks_path: str, run_dir: str, options: runs.RunOptions, *, ids: Sequence[int] | None = None, adapter: runs.Adapter = runs.echo_adapter, log_exists: bool | None = None,
    slice_cells: int = durable.SLICE_CELLS, owner: str | None = None, lease: float = durable.LEASE, after_slice: Callable[[int], None] | None = None,
) -> dict:
    """Generates the cells that the log lacks or has only failures of, and returns the run's counters.

    Answers are committed in slices of about ``slice_cells``; a run that ends
    early keeps them, and the next call generates the rest. One writer at a
    time: see ``durable.RunLock``. The lock is given back however the run ends.
    """
    tasks = runs.select_tasks(files.read_tasks(spark, tasks_path), ids)
    path = f"{run_dir}/generations"
    with durable.RunLock(spark, run_dir, owner, lease) as lock:
        log = files.read_generations(spark, path) if (files.exists(spark, path) if log_exists is None else log_exists) else None
        n_cells = tasks.count() * len(options.models) * options.n_samples
        durable.generate_slices(spark, runs.plan_run(spark, tasks, options, log), run_dir, options, lock, n_slices=max(1, -(-n_cells // slice_cells)), adapter=adapter, after_slice=after_slice)
    written = files.read_generations(spark, path) if files.exists(spark, path) else spark.createDataFrame([], schemas.GENERATION)
    return rows_of(runs.run_summary(runs.plan_run(spark, tasks, options), written))[0]


def clean_log(spark: SparkSession, run_dir: str, *, policy: str = "first") -> tuple[DataFrame, DataFrame]:
    """(one record for each cell, with its ``log_position``, counts). Resuming leaves a failed record before its retry; see ``policy``."""
    log = files.read_generations(spark, f"{run_dir}/generations", position="log_position")
    return runs.dedup(log, schemas.CELL, "log_position", policy=policy), runs.duplicate_counts(log, schemas.CELL)


def grade_run(spark: SparkSession, run_dir: str, tasks_path: str, *, run_code: bool = False, policy: str = "first") -> dict:
    """Grades a run's cleaned log, writes predictions and parse failures, and returns what is written to ``metrics.json``."""
    log, _ = clean_log(spark, run_dir, policy=policy)
    graded = grade.grade_generations(log, files.read_tasks(spark, tasks_path), run_code=run_code)
    graded.write.mode("overwrite").parquet(f"{run_dir}/predictions")
    predictions = spark.read.parquet(f"{run_dir}/predictions")
    grade.parse_failures(predictions).write.mode("overwrite").parquet(f"{run_dir}/parse_failures")
    found = {"models": rows_of(metrics.model_summary(predictions).orderBy("model_id")), "by_category": rows_of(metrics.model_category_rollup(predictions).filter("level = 'category'").orderBy("model_id", "category"))}
    files.write_json(spark, f"{run_dir}/metrics.json", found)
    return found


def inspect_run(spark: SparkSession, run_dir: str, problem: int) -> DataFrame:
    """A run's records of one problem, with their predictions where the run is graded."""
    log = files.read_generations(spark, f"{run_dir}/generations").filter(F.col("problem_id") == problem)
    graded = files.exists(spark, f"{run_dir}/predictions")
    predictions = spark.read.parquet(f"{run_dir}/predictions") if graded else spark.createDataFrame([], schemas.PREDICTION)
    return compare.inspect_records(log, predictions.filter(F.col("problem_id") == problem)).orderBy("model_id", "sample_index")


def compare_run_folders(spark: SparkSession, baseline: str, treatment: str) -> tuple[dict, str]:
    """(report, Markdown) of two graded runs, with their names and parse failures."""
    sides, names, failures = [], [], []
    for folder in (baseline, treatment):
        if not files.exists(spark, f"{folder}/predictions"):
            raise FileNotFoundError(f"{folder}: grade the run first")
        sides.append(spark.read.parquet(f"{folder}/predictions"))
        names.append(folder.rstrip("/").rpartition("/")[2])
        failures.append(grade.parse_failures(sides[-1]).count())
    pairs, summary = compare.paired(*sides), compare.compare_runs(*sides)
    categories = compare.by_category(pairs)
    found = {"baseline": names[0], "treatment": names[1], "baseline_parse_failures": failures[0], "treatment_parse_failures": failures[1]}
    found |= {"models": rows_of(summary.orderBy("model_id")), "by_category": rows_of(categories.orderBy("model_id", "category")), "flips": rows_of(compare.flip_lists(pairs).orderBy("model_id"))}
    return found, report.comparison_page((names[0], names[1]), summary, categories, compare.flips(pairs), (failures[0], failures[1]))


def _eval20_graded(spark: SparkSession, outputs_path: str, overrides_path: str | None, run_code: bool) -> tuple[DataFrame, DataFrame]:
    """(cells, graded cells)."""
    cells = grade.unpivot_conditions(files.read_outputs_wide(spark, outputs_path))
    overrides = files.read_overrides(spark, overrides_path) if overrides_path else None
    return cells, grade.grade_legacy(cells, "eval20", run_code=run_code, overrides=overrides)


def _eval20_tables(cells: DataFrame, graded: DataFrame, *, lists: bool) -> dict[str, DataFrame]:
    """The metrics of graded cells; with ``lists`` the tasks of behaviours and pairs are arrays, else rows of tables of their own."""
    review = grade.needs_review(graded).select("task_id", "condition", F.coalesce(F.col("extracted_num").cast("string"), "extracted_str").alias("extracted"))
    tables = {
        "conditions": metrics.accuracy_by(graded, "condition", ["category", "difficulty"]), "behavior": metrics.behavior(cells, lists=lists), "pairwise": metrics.pairwise(graded, grade.CONDITIONS, lists=lists),
        "needs_review": review, "overrides_applied": graded.filter("overridden").select("task_id", "condition", "auto_correct", "final_correct", "override_reason"),
    }
    return tables if lists else tables | {"behavior_tasks": metrics.behavior_tasks(cells), "discordant": metrics.discordant(graded, grade.CONDITIONS)}


def _eval20_page(graded: DataFrame, tables: dict[str, DataFrame]) -> tuple[DataFrame, list[tuple[str, DataFrame]], DataFrame]:
    """What the results page shows before the cells to review."""
    overall = metrics.ranked(tables["conditions"].filter("dimension = 'overall'"), grade.CONDITIONS)
    pivots = [(title, report.pivot_accuracy(graded, key, grade.CONDITIONS).orderBy(key)) for title, key in (("By category", "category"), ("By difficulty", "difficulty"))]
    return overall, pivots, report.head_to_head(tables["pairwise"], PAIRS)


def eval20(spark: SparkSession, outputs_path: str, overrides_path: str | None = None, *, run_code: bool = False) -> tuple[DataFrame, dict, str]:
    """(graded cells, metrics, results page) of the first experiment's wide outputs, for as many as the driver holds; ``eval20_run`` takes any number."""
    cells, graded = _eval20_graded(spark, outputs_path, overrides_path, run_code)
    tables = _eval20_tables(cells, graded, lists=True)
    tables["needs_review"] = tables["needs_review"].orderBy("task_id", "condition", "extracted")
    return graded, {name: rows_of(t) for name, t in tables.items()}, report.results_markdown(*_eval20_page(graded, tables), tables["needs_review"])


def eval20_run(spark: SparkSession, outputs_path: str, run_dir: str, overrides_path: str | None = None, *, run_code: bool = False) -> dict[str, DataFrame]:
    """The job of ``eval20`` over any number of outputs: the tables as they are written to a run folder.

    ``graded`` holds the graded cells, ``conditions``, ``behavior`` and
    ``pairwise`` are small, ``behavior_tasks`` and ``discordant`` are their
    lists of tasks as rows, and ``needs_review`` and ``overrides_applied`` have
    a row a cell. ``results`` is the results page as text files that follow one
    another by name. Cells are graded once; only small aggregates pass the driver.
    """
    def stored(name: str, table: DataFrame) -> DataFrame:
        table.write.mode("overwrite").parquet(f"{run_dir}/{name}")
        return spark.read.schema(table.schema).parquet(f"{run_dir}/{name}")

    graded = stored("graded", _eval20_graded(spark, outputs_path, overrides_path, run_code)[1])
    tables = {name: stored(name, t) for name, t in _eval20_tables(graded, graded, lists=False).items()}
    report.results_lines(*_eval20_page(graded, tables), tables["needs_review"]).write.mode("overwrite").text(f"{run_dir}/results")
    return {"graded": graded, **tables}


def ablation(spark: SparkSession, path: str, *, run_code: bool = False, all_samples: bool = False) -> tuple[DataFrame, DataFrame]:
    """(graded cells, accuracy and review counts by condition) of the prompt-format ablation."""
    graded = grade.grade_legacy(files.read_ablation(spark, path, all_samples=all_samples), "ablation", run_code=run_code)
    review = F.count_if(F.array_contains("flags", "needs_review")).cast("long").alias("n_review")
    return graded, metrics.with_rates(graded.groupBy("condition").agg(*metrics.accuracy_columns("final_correct"), review)).orderBy("condition")


def _generate_cells(spark: SparkSession, grid: DataFrame, run_dir: str, options: runs.RunOptions, adapter: runs.Adapter, slice_cells: int, owner: str | None) -> DataFrame:
    """The log of a run folder after the cells of a grid that it lacks were generated into it."""
    path = f"{run_dir}/generations"
    with durable.RunLock(spark, run_dir, owner) as lock:
        todo = runs.resume(grid, files.read_generations(spark, path)) if files.exists(spark, path) else grid
        durable.generate_slices(spark, todo, run_dir, options, lock, n_slices=max(1, -(-grid.count() // slice_cells)), adapter=adapter)
    return clean_log(spark, run_dir, policy="prefer_success")[0] if files.exists(spark, path) else spark.createDataFrame([], schemas.GENERATION)


def ablation_run(
    spark: SparkSession, tasks_path: str, run_dir: str, options: runs.RunOptions, *, ids: Sequence[int] | None = None, adapter: runs.Adapter = runs.echo_adapter, run_code: bool = False,
    slice_cells: int = durable.SLICE_CELLS, owner: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Generates the four prompt formats of the ablation for tasks, samples and models, and grades them: (graded cells, accuracy by model and condition).

    A cell's seed is the base seed, plus 10,000 for each task before it in
    order of ``ids`` (else of the task ids), 1,000 for each format and 1 for
    each sample. Answers are committed and resumed as in ``generate_run``.
    """
    tasks = runs.select_tasks(files.read_tasks(spark, tasks_path), ids)
    order = list(ids) if ids is not None else sorted(r.id for r in tasks.select("id").collect())  # the experiment's tasks
    place = spark.createDataFrame([(t, i) for i, t in enumerate(order)], "id long, task_index long")
    models = spark.createDataFrame(list(options.models), "model_id string, model_mode string")
    formats = tasks.join(F.broadcast(place), "id").select(
        "benchmark_version", F.col("id").alias("problem_id"), "task_index", F.posexplode(F.map_entries(prompts.ablation_prompts(F.col("few_shot_prefix"), F.col("prompt")))).alias("format_index", "f"),
    ).withColumns({"condition": F.col("f.key"), "prompt_text": F.col("f.value")})
    grid = runs.expected_grid(models, formats.drop("f"), options.n_samples)
    seed = prompts.ablation_seed(F.lit(options.base_seed), F.col("task_index"), F.col("format_index"), F.col("sample_index")).cast("long")
    cells = grid.withColumn("seed", seed).drop("task_index", "format_index")
    log = _generate_cells(spark, cells, run_dir, options, adapter, slice_cells, owner)
    facts = tasks.select(F.col("id").alias("task_id"), "category", "difficulty", "gold_answer")
    said = log.select("model_id", F.col("problem_id").alias("task_id"), "condition", "sample_index", "seed", F.coalesce("completion_text", F.lit("")).alias("output"))
    graded = grade.grade_legacy(said.join(facts, "task_id"), "ablation", run_code=run_code)
    review = F.count_if(F.array_contains("flags", "needs_review")).cast("long").alias("n_review")
    return graded, metrics.with_rates(graded.groupBy("model_id", "condition").agg(*metrics.accuracy_columns("final_correct"), review, F.count_if("overridden").cast("long").alias("n_override")))


def audit_run(
    spark: SparkSession, tasks_path: str, outputs_path: str, run_dir: str, options: runs.RunOptions, *, few_shot: str = "instruct_few_shot", zero_shot: str = "instruct_zero_shot",
    reclassify: bool = False, adapter: runs.Adapter = runs.echo_adapter, slice_cells: int = durable.SLICE_CELLS, owner: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(audit, code tasks to review by hand): tasks that few-shot got wrong and zero-shot right are sampled again, and judged by how stable their failure is.

    Samples are kept in the run folder's log; with ``reclassify`` those that it
    holds are judged again and nothing is generated. The audit is written to
    ``audit`` in the run folder and holds the task, the greedy output, the
    verdict over its samples and the distinct wrong answers.
    """
    tasks = files.read_tasks(spark, tasks_path)
    chosen, by_hand = grade.audit_candidates(files.read_outputs_wide(spark, outputs_path), few_shot, zero_shot)
    path = f"{run_dir}/generations"
    if reclassify:
        if not files.exists(spark, path):
            raise FileNotFoundError(f"{path}: there are no samples to judge again")
        log = clean_log(spark, run_dir, policy="prefer_success")[0]
    else:
        wanted = tasks.join(chosen.select(F.col("task_id").alias("id")).distinct(), "id", "left_semi")
        log = _generate_cells(spark, runs.plan_run(spark, wanted, options), run_dir, options, adapter, slice_cells, owner)
    facts = tasks.select(F.col("id").alias("task_id"), "category", "gold_answer")
    samples = log.filter(runs.succeeded(F.col("error"))).select(F.col("problem_id").alias("task_id"), "model_id", F.col("completion_text").alias("output")).join(facts, "task_id")
    greedy = chosen.groupBy("task_id").agg(F.any_value(few_shot).alias("greedy_output"))
    audit = grade.audit_samples(samples, ["task_id", "model_id"]).join(facts, "task_id").join(greedy, "task_id", "left")
    audit.write.mode("overwrite").parquet(f"{run_dir}/audit")
    return spark.read.schema(audit.schema).parquet(f"{run_dir}/audit"), by_hand.select("task_id")


def validate_tasks(spark: SparkSession, tasks_path: str, *, expected: int | None = None, manifest_path: str | None = None) -> dict:
    """Problems, digest and counts of a task file; a digest that differs from a stored manifest is an error. A valid set's manifest is stored."""
    tasks = files.read_tasks(spark, tasks_path)
    problems = rows_of(validate.validate_all(tasks, expected).orderBy("task_id", "rule"))
    digest = files.file_digests(spark, tasks_path).first()["sha256"]
    stored = None
    if manifest_path and files.exists(spark, manifest_path):
        stored = files.read_document(spark, manifest_path)["sha256"]
    found = {"sha256": validate.frozen(digest, stored), "counts": rows_of(validate.manifest(tasks).orderBy("dimension", "value")), "problems": problems}
    if manifest_path and not problems:
        files.write_json(spark, manifest_path, found)
    return found
