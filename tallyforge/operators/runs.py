"""Run logs: the grid of expected cells, resume, duplicates, counters, generation."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions.prompts import CONDITIONS, SYSTEM_PROMPT, sample_seed
from tallyforge.shipping import ship


@dataclass(frozen=True)
class RunOptions:
    """What a generation run asks for, checked on construction."""

    models: tuple[tuple[str, str], ...]
    condition: str = "direct"
    n_samples: int = 1
    do_sample: bool = False
    temperature: float | None = None
    max_new_tokens: int = 200
    base_seed: int = 42
    system_prompt: str = SYSTEM_PROMPT

    def __post_init__(self):
        if self.condition not in CONDITIONS:
            raise ValueError(f"unknown condition {self.condition!r}")
        if self.n_samples < 1 or self.max_new_tokens < 1:
            raise ValueError("n_samples and max_new_tokens are at least 1")
        if self.n_samples > 1 and not self.do_sample:
            raise ValueError("several samples need do_sample")
        if self.do_sample and not (self.temperature and self.temperature > 0):
            raise ValueError("sampling needs a temperature above 0")


def parse_model_spec(spec: str) -> tuple[str, str]:
    """(model, mode) of ``model:mode``; the mode is raw if it is left out."""
    model, colon, mode = spec.rpartition(":")
    if not colon:
        model, mode = spec, "raw"
    if not model or mode not in ("raw", "chat"):
        raise ValueError(f"bad model spec {spec!r}: model or model:raw or model:chat")
    return model, mode


def parse_ids(value: str, *, allow_all: bool = True) -> list[int] | None:
    """Unique comma-separated ids, or None for ``all``."""
    if allow_all and value.strip() == "all":
        return None
    try:
        ids = [int(x) for x in value.split(",") if x.strip()]
    except ValueError as error:
        raise ValueError("ids are comma-separated integers") from error
    if not ids or len(set(ids)) != len(ids):
        raise ValueError("ids must be given, each once")
    return ids


def select_tasks(tasks: DataFrame, ids: Sequence[int] | None) -> DataFrame:
    """The tasks with these ids; an id that no task has is an error."""
    if ids is None:
        return tasks
    known = {r.id for r in tasks.filter(F.col("id").isin(list(ids))).select("id").distinct().collect()}  # at most as many as asked for
    if missing := sorted(set(ids) - known):
        raise ValueError(f"unknown task ids {missing}")
    return tasks.filter(F.col("id").isin(list(ids)))


def succeeded(error: Column) -> Column:
    return error.isNull() | (error == "")


def expected_grid(models: DataFrame, problems: DataFrame, n_samples: int) -> DataFrame:
    """Every model with every problem and sample index: the definition of a run, so the pairs are all wanted."""
    sample = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_samples - 1).cast("long")))
    return models.crossJoin(problems).withColumn("sample_index", sample)


def resume(grid: DataFrame, log: DataFrame, keys: Sequence[str] = schemas.CELL, error: str = "error") -> DataFrame:
    """Cells of the grid without a successful record; cells that only failed are run again."""
    return grid.join(log.filter(succeeded(F.col(error))).select(*keys).distinct(), list(keys), "left_anti")


def dedup(log: DataFrame, keys: Sequence[str], position: str | Sequence[str], *, policy: str = "first", error: str = "error") -> DataFrame:
    """One record for each key: the first in the log, the last, or with ``prefer_success`` the first that succeeded if any did.

    Picked by an aggregate with partial sums before the shuffle, so a key with
    a third of the log is no longer than others.
    """
    order = [F.col(position)] if isinstance(position, str) else [F.col(p) for p in position]
    row = F.struct(*[F.col(c) for c in log.columns])
    if policy == "first":
        pick = F.min_by(row, F.struct(*order))
    elif policy == "last":
        pick = F.max_by(row, F.struct(*order))
    elif policy == "prefer_success":
        pick = F.min_by(row, F.struct((~succeeded(F.col(error))).alias("failed"), *order))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    return log.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick.alias("_row")).select("_row.*")


def duplicate_counts(log: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Records, distinct keys and records beyond one for each key."""
    per_key = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = per_key.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_records"), F.count(F.lit(1)).cast("long").alias("n_keys"))
    return total.withColumn("n_duplicates", F.col("n_records") - F.col("n_keys"))


def run_summary(grid: DataFrame, log: DataFrame, keys: Sequence[str] = schemas.CELL) -> DataFrame:
    """expected_records, n_records_written, n_errors and n_missing of a grid and its log, from one scan of each."""
    one = F.lit(1).cast("long")
    per_cell = log.groupBy(*keys).agg(F.count(F.lit(1)).alias("_written"), F.count_if(~succeeded(F.col("error"))).alias("_errors"))
    both = grid.select(*keys, one.alias("_wanted")).join(per_cell, list(keys), "full")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    lacks = F.coalesce(F.col("_written"), F.lit(0)) == F.coalesce(F.col("_errors"), F.lit(0))
    return both.agg(
        total("_wanted").alias("expected_records"), total("_written").alias("n_records_written"), total("_errors").alias("n_errors"), total(F.when(F.col("_wanted").isNotNull() & lacks, one)).alias("n_missing"),
    )


def truncated(n_output: Column, most: Column) -> Column:
    return F.coalesce(n_output >= most, F.lit(False))


def with_seeds(cells: DataFrame, base_seed: int) -> DataFrame:
    parts = [F.lit(base_seed), *[F.col(c) for c in ("benchmark_version", "model_id", "condition", "problem_id", "sample_index")]]
    return cells.withColumn("seed", sample_seed(*parts))


#: A model adapter gets an iterator of (prompt_text, seed) and yields (completion_text, n_input_tokens, n_output_tokens) for each, in order.
#: It may take several before it answers. It is started once for a partition, and again for what is left after a prompt fails.
Adapter = Callable[[Iterator[tuple[str, int]]], Iterator[tuple[str, int, int]]]


def echo_adapter(rows: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int, int]]:
    """A stand-in model without weights: answers with a number drawn from the seed."""
    for prompt, seed in rows:
        yield f"The answer is {seed % 100}.", len(prompt.split()), 4


def answers(adapter: Adapter, rows: Iterator[tuple]) -> Iterator[tuple]:
    """(row, answer or None, error or None, seconds) for rows that end in (prompt_text, seed), in order.

    If the adapter fails, the first row that it has not answered has the error;
    it is started anew with the other rows that it had taken, and goes on.
    """
    source = iter(rows)
    taken: deque[tuple] = deque()  # handed out and not answered
    again: deque[tuple] = deque()  # to be handed out once more

    def asked() -> Iterator[tuple[str, int]]:
        while True:
            row = again.popleft() if again else next(source, None)
            if row is None:
                return
            taken.append(row)
            yield row[-2], row[-1]

    model: Iterator | None = None
    while True:
        began = time.time()
        answer, error = None, "RuntimeError: the adapter gave no answer"
        try:
            model = iter(adapter(asked())) if model is None else model
            answer, error = tuple(next(model)), None
        except StopIteration:
            pass
        except Exception as failure:  # noqa: BLE001  error rows are data
            error = f"{type(failure).__name__}: {failure}"
        row = taken.popleft() if taken else again.popleft() if again else next(source, None)
        if row is None:
            return
        yield row, answer, error, round(time.time() - began, 3)
        if error:
            again.extendleft(reversed(taken))
            taken.clear()
            model = None


def generate(cells: DataFrame, options: RunOptions, adapter: Adapter = echo_adapter) -> DataFrame:
    """Generation records for cells with ``prompt_text`` and ``seed``; a failing prompt gives an error record with null counts."""
    names = ["benchmark_version", "problem_id", "model_id", "model_mode", "condition", "sample_index", "seed", "prompt_text"]

    def run(batches):
        import pandas as pd

        given = (tuple(row) for batch in batches for row in batch[names].astype(object).itertuples(index=False))
        asked = ((*row, row[7], row[6]) for row in given)
        columns = [*names, "completion_text", "n_input_tokens", "n_output_tokens", "elapsed_seconds", "error"]
        made = ((*row[:8], *(("", None, None) if answer is None else answer), seconds, error) for row, answer, error, seconds in answers(adapter, asked))
        while some := list(islice(made, 500)):
            yield pd.DataFrame(some, columns=columns).astype({"n_input_tokens": "Int64", "n_output_tokens": "Int64"})

    types = {f.name: f.dataType.simpleString() for f in cells.schema}
    ddl = ", ".join(f"{n} {types[n]}" for n in names) + ", completion_text string, n_input_tokens long, n_output_tokens long, elapsed_seconds double, error string"
    ship(cells.sparkSession)
    made = cells.select(*names).mapInPandas(run, ddl)
    constants = {"do_sample": F.lit(options.do_sample), "temperature": F.lit(options.temperature).cast("double"), "max_new_tokens": F.lit(options.max_new_tokens).cast("long")}
    order = [c.split(" ")[0] for c in schemas.GENERATION.split(", ")]
    return made.withColumns(constants).select(*order)


def plan_run(spark: SparkSession, tasks: DataFrame, options: RunOptions, log: DataFrame | None = None) -> DataFrame:
    """The cells a run still has to generate, with prompts and seeds."""
    models = spark.createDataFrame(list(options.models), "model_id string, model_mode string")
    prompts = tasks.select("benchmark_version", F.col("id").alias("problem_id"), CONDITIONS[options.condition](tasks).alias("prompt_text"))
    grid = expected_grid(models, prompts, options.n_samples).withColumn("condition", F.lit(options.condition))
    return with_seeds(grid if log is None else resume(grid, log), options.base_seed)
