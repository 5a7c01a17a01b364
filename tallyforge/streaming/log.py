"""The generation log as a stream: tolerant reading, deduplication, cells with state and timers, grading as it arrives."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from tallyforge import schemas
from tallyforge.shipping import ship


def read_log_stream(spark: SparkSession, path: str, schema: str = schemas.GENERATION, *, files_per_trigger: int = 1000) -> DataFrame:
    """Records of a folder of JSONL files as they come; lines that are no record and blank lines are passed over."""
    lines = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("recursiveFileLookup", True).text(path)
    parsed = lines.select(F.from_json("value", f"{schema}, _corrupt_record string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r"))
    return parsed.filter("r IS NOT NULL AND r._corrupt_record IS NULL").select("r.*").drop("_corrupt_record")


def dedup_stream(stream: DataFrame, keys: Sequence[str], *, arrival: str | None = None, delay: str = "1 day") -> DataFrame:
    """One record for each key. With an arrival time, state is dropped after ``delay``; without, the keys of the whole log are kept."""
    if arrival is None:
        return stream.dropDuplicates(list(keys))
    return stream.withWatermark(arrival, delay).dropDuplicatesWithinWatermark(list(keys))


#: Bytes of rows from which a task reduces them to one for each key as it reads.
HELD_BYTES = 64 << 20


def _least(keys: Sequence[str], position: str) -> Callable[[Iterator], Iterator]:
    """The row of the least position (nulls last) of each key that a task gets, over whole Arrow batches."""
    keys = list(keys)

    def firsts(batches: list) -> list:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.Table.from_batches(batches)
        rows = rows.take(pc.sort_indices(rows.select([position]), sort_keys=[(position, "ascending")]))
        places = pa.table([*(rows[k] for k in keys), pa.array(np.arange(len(rows)))], names=[*map(str, range(len(keys))), "place"])
        return rows.take(places.group_by(places.column_names[:-1], use_threads=False).aggregate([("place", "min")])["place_min"]).to_batches()

    def run(batches: Iterator) -> Iterator:
        held, size, kept = [], 0, 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > max(HELD_BYTES, 2 * kept):
                held = firsts(held)
                size = kept = sum(b.nbytes for b in held)
        if held:
            yield from firsts(held)

    return run


def first_in_log(stream: DataFrame, keys: Sequence[str], position: str) -> DataFrame:
    """The record of the least position of each key within its first batch; later batches of the key are dropped.

    The order of rows inside a micro-batch is not the log's, hence the keys are
    dealt out and each task reduces its rows to the least of each key; what is
    left is deduplicated with Spark's own state of the keys. A task holds one
    row for each of its keys. Keys are plain values, no structs or arrays.
    """
    return stream.repartition(*keys).mapInArrow(_least(keys, position), stream.schema).dropDuplicates(list(keys))


def run_available(stream: DataFrame, path: str, checkpoint: str, *, mode: str = "append", each: Callable[[DataFrame, int], None] | None = None) -> None:
    """Processes what is there and ends. The checkpoint names the run: a second call goes on where the first ended."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(each).start() if each else writer.format("parquet").option("path", path).start()
    query.awaitTermination()


def grade_stream(stream: DataFrame, grade: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> None:
    """Grades each micro-batch and appends it below ``path`` in a folder of its own, so that a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        grade(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_available(stream, path, checkpoint, each=write)


class _Cell(StatefulProcessor):
    """One cell of a run: its best record while it is open, then only that it is decided, until that is forgotten.

    Timers stand on event time. The first record of a cell sets one at its own
    time, which the watermark passes after the allowed delay; the decision sets
    another, after which nothing of the cell is left.
    """

    def __init__(self, policy: str, keep_ms: int):
        self.policy, self.keep_ms = policy, keep_ms

    def init(self, handle) -> None:
        self.handle = handle
        # one value and not two, as each call to the store is a round trip; a decided cell has no position and no body
        self.cell = handle.getValueState("cell", "succeeded boolean, position long, body string")

    def _rank(self, record: tuple) -> tuple:
        succeeded, position, _ = record
        return (self.policy == "prefer_success" and not succeeded, position)

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        held = self.cell.get()
        if held is not None and held[1] is None:
            return iter(())
        # by place, as names are lost on the way: the last four are time in milliseconds, succeeded, position and body
        found = [tuple(row)[-4:] for row in rows]
        best = min([(bool(s), int(p), b) for _, s, p, b in found] + ([] if held is None else [tuple(held)]), key=self._rank)
        if held is None:
            self.handle.registerTimer(int(min(row[0] for row in found)) + 1)
        if held is None or best != tuple(held):
            self.cell.update(best)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        succeeded, position, body = self.cell.get()
        if position is None:
            self.cell.clear()
            return
        self.cell.update((succeeded, None, None))
        self.handle.registerTimer(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        yield Row(_body=body, status="succeeded" if succeeded else "failed")

    def close(self) -> None:
        pass


def cell_stream(stream: DataFrame, keys: Sequence[str], position: str, arrival: str, *, policy: str = "first", delay: str = "1 hour", keep_seconds: int = 7 * 86_400, error: str = "error") -> DataFrame:
    """The record that stands for each cell, with its ``status`` (succeeded or failed), once the watermark has passed the cell's first record by ``delay``.

    ``policy`` is as in ``operators.runs.dedup``: ``first`` takes the least
    ``position`` (a whole number), ``prefer_success`` the least of those
    without an error if there is one. Within the delay the records of a cell
    may come in any order and in any number of batches, and the result is that
    of the batch. A pending cell holds its best record; a decided one holds one
    flag and passes over what comes for it for ``keep_seconds`` of event time;
    then its state is gone, so that state does not grow with the log. Needs the
    RocksDB state store: see ``run_cells``.
    """
    if policy not in ("first", "prefer_success"):
        raise ValueError(f"unknown policy {policy!r}")
    schema = stream.schema
    ship(stream.sparkSession)
    marked = stream.select(
        *keys, F.col(arrival).cast("timestamp").alias("_arrived"), F.unix_millis(F.col(arrival).cast("timestamp")).alias("_ms"), F.coalesce(F.col(error) == "", F.lit(True)).alias("_succeeded") if error in stream.columns else F.lit(True).alias("_succeeded"),
        F.col(position).cast("long").alias("_position"), F.to_json(F.struct(*stream.columns)).alias("_body"),
    ).withWatermark("_arrived", delay)
    chosen = marked.groupBy(*keys).transformWithState(_Cell(policy, keep_seconds * 1000), "_body string, status string", "append", "eventTime")
    return chosen.select(F.from_json("_body", schema).alias("r"), "status").select("r.*", "status")


#: The setting that names the state store, and the store that keeps lists and timers for processors with state.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def run_cells(stream: DataFrame, path: str, checkpoint: str) -> None:
    """``run_available`` for ``cell_stream``: the query starts with the RocksDB state store, and the session keeps its own settings.

    Each part of the state costs a Python worker and a commit in every batch
    and is not held in memory, so that there are at most two parts a core. The
    checkpoint keeps the number of its first run.
    """
    spark = stream.sparkSession
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    settings = dict([STATE_STORE, ("spark.sql.shuffle.partitions", str(parts))])
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        query = stream.writeStream.outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).format("parquet").start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value) if value else spark.conf.unset(name)
    query.awaitTermination()
