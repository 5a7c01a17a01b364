import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import runs
from tallyforge.streaming import log as streams

SCHEMA = "problem_id long, position long, completion_text string, error string"


def write(folder, name, records):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in records))


def test_log_is_read_on_and_bad_lines_are_passed_over(spark, tmp_path):
    log, out, checkpoint = tmp_path / "log", f"{tmp_path}/out", f"{tmp_path}/checkpoint"
    write(log, "a.jsonl", [{"problem_id": 1, "position": 1}, "", '{"problem_id": 2, "pos', {"problem_id": 1, "position": 2}])
    run = lambda: streams.run_available(streams.dedup_stream(streams.read_log_stream(spark, str(log), SCHEMA), ["problem_id"]), out, checkpoint)
    run()
    assert [r.problem_id for r in spark.read.parquet(out).collect()] == [1]
    write(log, "b.jsonl", [{"problem_id": 1, "position": 3}, {"problem_id": 2, "position": 4}])
    run()
    assert sorted(r.problem_id for r in spark.read.parquet(out).collect()) == [1, 2]


def test_first_in_log(spark, tmp_path):
    log = tmp_path / "log"
    write(log, "a.jsonl", [{"problem_id": 1, "position": 5, "completion_text": "late"}, {"problem_id": 1, "position": 2, "completion_text": "first"}, {"problem_id": 2, "position": 3}])
    stream = lambda: streams.first_in_log(streams.read_log_stream(spark, str(log), SCHEMA), ["problem_id"], "position")
    streams.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    write(log, "b.jsonl", [{"problem_id": 1, "position": 9, "completion_text": "again"}])
    streams.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert sorted((r.problem_id, r.completion_text) for r in spark.read.parquet(f"{tmp_path}/out").collect() if r.problem_id == 1) == [(1, "first")]


def test_first_in_log_reduces_whole_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "HELD_BYTES", 100)  # reduced many times
    rng = random.Random(7)
    big = 2**53  # doubles would not tell these positions and keys apart
    rows = [(rng.choice([None, big, big + 1, 3]), big + p if p % 9 else None, rng.choice([None, "a", "b"])) for p in rng.sample(range(3000), 600)]
    frame = spark.createDataFrame(rows, "problem_id long, position long, kind string")
    frame.repartition(7).write.parquet(f"{tmp_path}/log")
    stream = streams.first_in_log(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/log"), ["problem_id", "kind"], "position")
    streams.run_available(stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    want = {}
    for r in rows:
        key = r[0], r[2]
        if r[1] is not None and (key not in want or r[1] < want[key]):
            want[key] = r[1]
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(got) == len(want) == 12 and {(r.problem_id, r.kind): r.position for r in got} == want
    assert "InPandas" not in stream._jdf.queryExecution().toString()


def test_watermark(spark, tmp_path):
    log = tmp_path / "log"
    write(log, "a.jsonl", [{"problem_id": 1, "position": 1}, {"problem_id": 1, "position": 2}])
    stream = streams.read_log_stream(spark, str(log), SCHEMA).withColumn("arrived", F.timestamp_seconds("position"))
    streams.run_available(streams.dedup_stream(stream, ["problem_id"], arrival="arrived", delay="1 hour"), f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def test_batch_equals_stream(spark, tmp_path):
    log = tmp_path / "log"
    write(log, "a.jsonl", [{"problem_id": i, "completion_text": str(i)} for i in range(20)])
    grade = lambda df: df.select("problem_id", (F.col("completion_text").cast("long") % 2 == 0).alias("correct"))
    streams.grade_stream(streams.read_log_stream(spark, str(log), SCHEMA), grade, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    got = sorted((r.problem_id, r.correct) for r in spark.read.parquet(f"{tmp_path}/out").collect())
    assert got == sorted(tuple(r) for r in grade(spark.read.schema(SCHEMA).json(str(log))).collect())


def feed(spark, folder, batches, **options):
    """Runs the cell stream after each batch of (problem_id, position, error, seconds), as a log that grows."""
    for i, rows in enumerate(batches):
        frame = spark.createDataFrame([(*r[:3], r[3]) for r in rows], "problem_id long, position long, error string, at long").withColumn("arrived", F.timestamp_seconds("at"))
        frame.coalesce(1).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(frame.schema).parquet(f"{folder}/log")
        streams.run_cells(streams.cell_stream(stream, ["problem_id"], "position", "arrived", **options), f"{folder}/out-{i // 99}", f"{folder}/checkpoint")
    return [(r.problem_id, r.position, r.status) for r in spark.read.parquet(f"{folder}/out-0").collect()]


@pytest.mark.parametrize("policy", ["first", "prefer_success"])
def test_cells_equal_the_batch(spark, tmp_path, policy):
    rng = random.Random(5)
    rows = [(rng.randrange(25), i, rng.choice([None, "", "failed", "failed"]), 1000 + rng.randrange(600)) for i in range(120)]
    rng.shuffle(rows)
    got = feed(spark, tmp_path, [rows[:50], rows[50:90], rows[90:], [(-1, 999, None, 10**6)]], policy=policy, delay="1 hour")
    batch = runs.dedup(spark.createDataFrame(rows, "problem_id long, position long, error string, at long"), ["problem_id"], "position", policy=policy).collect()
    assert sorted(got) == sorted((r.problem_id, r.position, "failed" if r.error else "succeeded") for r in batch)


def test_decided_cells_are_passed_over_and_then_forgotten(spark, tmp_path):
    before = spark.conf.get(streams.STATE_STORE[0], None)
    moves = lambda at: [(-1, 0, None, at)]  # noqa: E731  another cell that moves the watermark
    batches = [[(1, 5, None, 0)], moves(1000), [(1, 4, None, 1000)], moves(2000), moves(9000), [(1, 9, None, 9000)], moves(20_000)]
    batches = [[(*r[:3], r[3] + 10**6) for r in rows] for rows in batches]  # a time of 0 is not after the first watermark
    got = feed(spark, tmp_path, batches, delay="10 seconds", keep_seconds=5000)
    assert sorted(g for g in got if g[0] == 1) == [(1, 5, "succeeded"), (1, 9, "succeeded")]
    assert spark.conf.get(streams.STATE_STORE[0], None) == before
    with pytest.raises(ValueError, match="policy"):
        streams.cell_stream(spark.readStream.schema("a long").parquet(str(tmp_path / "log")), ["a"], "a", "a", policy="last")


def test_parts_of_the_cells_state_are_bounded(spark, tmp_path):
    name = "spark.sql.shuffle.partitions"
    before, most = spark.conf.get(name), 2 * spark.sparkContext.defaultParallelism
    spark.conf.set(name, str(most + 5))
    try:
        got = feed(spark, tmp_path, [[(k, k, "failed" if k % 2 else None, 1000) for k in range(9)], [(-1, 0, None, 10**6)]])
        assert spark.conf.get(name) == str(most + 5)
    finally:
        spark.conf.set(name, before)
    assert sorted(got) == [(k, k, "failed" if k % 2 else "succeeded") for k in range(9)]
    assert len([p for p in (tmp_path / "checkpoint/state/0").iterdir() if p.name.isdigit()]) == most
