import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import drivers, durable, runs
from tallyforge.sources import files

OPTIONS = runs.RunOptions((("a", "raw"), ("b", "raw")), "direct", n_samples=3, do_sample=True, temperature=0.7)


@pytest.fixture
def tasks_path(tmp_path):
    prompts = [{"id": i, "category": "c", "difficulty": "easy", "answer_type": "number", "prompt": f"What is {i}?", "few_shot_prefix": "", "gold_answer": str(i)} for i in range(20)]
    (tmp_path / "tasks.json").write_text(json.dumps({"version": "v1", "prompts": prompts}))
    return str(tmp_path / "tasks.json")


def cells(spark, folder):
    return Counter((r.model_id, r.problem_id, r.sample_index) for r in files.read_generations(spark, f"{folder}/generations").collect())


def test_a_run_that_dies_keeps_its_slices(spark, tmp_path, tasks_path):
    plan = runs.plan_run(spark, files.read_tasks(spark, tasks_path), OPTIONS)
    last = plan.orderBy(F.pmod(F.xxhash64(*schemas.CELL), F.lit(20)).desc()).first().seed  # a cell of the last slice

    class Killed(BaseException):
        pass

    def dying(rows):  # takes its process down on one prompt
        for prompt, seed in rows:
            if seed == last:
                raise Killed
            yield f"{seed}", 1, 1

    run = lambda **more: drivers.generate_run(spark, tasks_path, f"{tmp_path}/run", OPTIONS, slice_cells=6, **more)
    with pytest.raises(Exception, match="Killed"):
        run(adapter=dying)
    kept = cells(spark, f"{tmp_path}/run")
    assert 0 < len(kept) < 120 and set(kept.values()) == {1}
    found = run()
    assert set(cells(spark, f"{tmp_path}/run").values()) == {1}
    assert found == {"expected_records": 120, "n_records_written": 120, "n_errors": 0, "n_missing": 0}
    assert run()["n_records_written"] == 120  # nothing is left to do


def test_errors_are_generated_again(spark, tmp_path, tasks_path):
    def failing(rows):
        for prompt, seed in rows:
            if "What is 5?" in prompt:
                raise ValueError("no")
            yield f"{seed}", 1, 1

    found = drivers.generate_run(spark, tasks_path, f"{tmp_path}/run", OPTIONS, adapter=failing)
    assert found == {"expected_records": 120, "n_records_written": 120, "n_errors": 6, "n_missing": 6}
    found = drivers.generate_run(spark, tasks_path, f"{tmp_path}/run", OPTIONS)
    assert found == {"expected_records": 120, "n_records_written": 126, "n_errors": 6, "n_missing": 0}


def test_lock(spark, tmp_path):
    now = [1000.0]
    lock = lambda owner: durable.RunLock(spark, f"{tmp_path}/run", owner, lease=60, clock=lambda: now[0])
    first, second = lock("one"), lock("two")
    assert first.claim() == 1
    with pytest.raises(durable.RunLocked, match="held by one"):
        second.claim()
    first.renew()
    now[0] += 61  # the lease has ended
    assert second.claim() == 2
    with pytest.raises(durable.RunFenced):
        first.renew()
    first.release()  # changes nothing
    with pytest.raises(durable.RunLocked):
        lock("three").claim()
    second.release()
    assert lock("three").claim() == 3
    (tmp_path / "run/_lock/claim-4").touch()  # claimed, and nothing written yet
    with pytest.raises(durable.RunLocked):
        durable.RunLock(spark, f"{tmp_path}/run", "four").claim()


def test_records_of_an_old_owner_are_refused(spark, tmp_path):
    record = spark.createDataFrame([], schemas.GENERATION)
    folder, now = f"{tmp_path}/run", [0.0]
    old, new = (durable.RunLock(spark, folder, o, lease=10, clock=lambda: now[0]) for o in ("old", "new"))
    old.claim()
    record.write.json(f"{folder}/_staging/1-0")
    now[0] = 11.0
    new.claim()
    with pytest.raises(durable.RunFenced):
        durable.commit(spark, f"{folder}/_staging/1-0", f"{folder}/generations/slice-1-0", old)
    assert not files.exists(spark, f"{folder}/generations") and not files.exists(spark, f"{folder}/_staging/1-0")
    record.write.json(f"{folder}/_staging/2-0")
    durable.commit(spark, f"{folder}/_staging/2-0", f"{folder}/generations/slice-2-0", new)
    record.write.json(f"{folder}/_staging/2-0")
    durable.commit(spark, f"{folder}/_staging/2-0", f"{folder}/generations/slice-2-0", new)  # once more changes nothing
    assert files.exists(spark, f"{folder}/generations/slice-2-0") and not files.exists(spark, f"{folder}/_staging/2-0")
