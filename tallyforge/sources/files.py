"""JSON, JSONL and binary files as DataFrames, and the sinks of a run folder."""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.shipping import ship
from tallyforge.sources import documents


def exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """The tasks of a task file, one row each, with the file's version."""
    return documents.read_objects(spark, path, schemas.TASK, key="prompts", head="version string").withColumnRenamed("version", "benchmark_version")


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one array of objects, of any size: see ``documents``."""
    return documents.read_objects(spark, path, schema)


def read_outputs_wide(spark: SparkSession, path: str) -> DataFrame:
    return read_json_array(spark, path, schemas.OUTPUTS_WIDE)


def log_position() -> Column:
    """Where a line of a text scan stands in its log, to be ordered by: time of its file, file, block of the file, place in the block.

    Every append of a log writes files of its own, so a later append comes
    later whatever its files' sizes and names are. Files that were copied
    without their times stand in the order of their names.
    """
    return F.struct(
        F.col("_metadata.file_modification_time").alias("time"), F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"),
    )


def read_jsonl(spark: SparkSession, path: str, schema: str, *, position: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, lines that are no record) of a file or of a folder and the folders in it; blank lines are neither. With ``position`` the records have a column of that name: see ``log_position``."""
    schema = f"{schema}, _corrupt_record string"
    placed = [] if position is None else [log_position().alias(position)]
    kept = [] if position is None else [position]
    lines = spark.read.option("recursiveFileLookup", True).text(path).select("value", *placed).filter(F.regexp_like("value", F.lit(r"\S")))
    parsed = lines.select("value", *kept, F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    bad = F.col("r._corrupt_record").isNotNull() | F.col("r").isNull()
    return parsed.filter(~bad).select("r.*", *kept).drop("_corrupt_record"), parsed.filter(bad).select("value")


def read_generations(spark: SparkSession, path: str, *, position: str | None = None) -> DataFrame:
    return read_jsonl(spark, path, schemas.GENERATION, position=position)[0]


def append_jsonl(records: DataFrame, path: str) -> None:
    """Appends records to a folder of JSONL files."""
    records.write.mode("append").json(path)


def write_array(rows: DataFrame, path: str, *, head: str = "[", tail: str = "]") -> str:
    """Writes a table, in no order, as one JSON document that is one array of objects, or that holds it between ``head`` and ``tail``.

    Objects are made by all tasks, a line each; one task lays them out as they
    come, so that a document of any size takes bounded memory.
    """
    none = rows.sparkSession.range(1).select(F.lit(None).cast("string").alias("value"))  # so that an empty table has its task, too
    lines = rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).union(none).repartition(1)

    def lay(batches):
        import pandas as pd

        yield pd.DataFrame({"value": [head]})
        first = True
        for batch in batches:
            found = "," + batch["value"].dropna()
            if first and len(found):
                found.iloc[0], first = found.iloc[0][1:], False
            yield pd.DataFrame({"value": found})
        yield pd.DataFrame({"value": [tail]})

    ship(rows.sparkSession)
    lines.mapInPandas(lay, "value string").write.text(path)
    return path


def write_json(spark: SparkSession, path: str, data: object) -> None:
    """A report document, wherever Spark can write: two spaces, characters as they are, a closing line end."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    try:
        out.write(bytearray((json.dumps(data, indent=2, ensure_ascii=False) + "\n").encode()))
    finally:
        out.close()


def read_document(spark: SparkSession, path: str) -> object:
    """A report document as plain objects."""
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """The predictions of a graded run; an ungraded run is an error that says what to do."""
    if not exists(spark, path):
        raise FileNotFoundError(f"{path}: grade the run first")
    return read_predictions_or_none(spark, path)


def read_predictions_or_none(spark: SparkSession, path: str) -> DataFrame:
    """As ``read_predictions``; a missing file gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.PREDICTION)
    return documents.read_objects(spark, path, schemas.PREDICTION, key="predictions")


def count_parse_failures(spark: SparkSession, path: str) -> int:
    """The stored number of parse failures; 0 without the file or the field."""
    if not exists(spark, path):
        return 0
    row = spark.read.schema("n long").option("multiLine", True).json(path).first()
    return int(row.n or 0) if row else 0


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.RUN_CONFIG).option("multiLine", True).json(path)


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Human corrections (task_id, condition, correct, reason); a missing file has none."""
    if not exists(spark, path):
        return spark.createDataFrame([], schemas.OVERRIDES)
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,map<string,struct<correct:boolean,reason:string>>>").alias("m"))
    by_task = whole.select(F.explode("m").alias("task_id", "cells")).select(F.col("task_id").cast("long").alias("task_id"), F.explode("cells").alias("condition", "c"))
    return by_task.select("task_id", "condition", "c.correct", "c.reason")


def read_ablation(spark: SparkSession, path: str, *, all_samples: bool = False) -> DataFrame:
    """Ablation outputs as rows (task_id, category, difficulty, gold_answer, condition, sample_index, seed, output); by default the first sample of each cell."""
    tasks = documents.read_objects(spark, path, schemas.ABLATION_TASK, key="tasks")
    cells = tasks.select("task_id", "category", "difficulty", "gold_answer", F.explode("conditions").alias("condition", "c"))
    rows = cells.select("task_id", "category", "difficulty", "gold_answer", "condition", F.posexplode("c.samples").alias("sample_index", "s"))
    kept = rows if all_samples else rows.filter("sample_index = 0")
    return kept.select("task_id", "category", "difficulty", "gold_answer", "condition", F.col("sample_index").cast("long").alias("sample_index"), "s.seed", "s.output")


def file_digests(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(path, sha256) of files."""
    found = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return found.select("path", F.sha2("content", 256).alias("sha256"))


def changed_files(spark: SparkSession, paths: str | Iterable[str], manifest: DataFrame) -> DataFrame:
    """(path, sha256, changed) of files as they are now; ``changed`` where the manifest has another digest or none for the path."""
    stored = manifest.select("path", F.col("sha256").alias("_stored"))
    return file_digests(spark, paths).join(stored, "path", "left").select("path", "sha256", (~F.col("sha256").eqNullSafe(F.col("_stored"))).alias("changed"))


def utc_now() -> Column:
    """The time to the second with a closing Z, in a session whose zone is UTC."""
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
