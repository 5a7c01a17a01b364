import json

import pytest

from tallyforge import __main__ as cli
from tallyforge.operators import drivers, runs

TASKS = {"version": "v1", "prompts": [
    {"id": 1, "category": "math", "difficulty": "easy", "answer_type": "number", "prompt": "1+1?\nAnswer:", "few_shot_prefix": "Q\nAnswer: 5\n\n", "gold_answer": "2"},
    {"id": 2, "category": "logic", "difficulty": "hard", "answer_type": "yesno", "prompt": "ok?", "few_shot_prefix": "Q\nAnswer: no\n\n", "gold_answer": "yes"},
]}


def test_a_run_from_start_to_comparison(spark, tmp_path):
    def answers(rows):  # defined here, so that it travels by value
        for prompt, seed in rows:
            if "ok?" in prompt and seed % 2:
                raise RuntimeError("out of memory")
            yield ("The answer is 2." if "1+1" in prompt else "Yes."), 3, 4

    tasks = f"file://{tmp_path}/tasks.json"
    (tmp_path / "tasks.json").write_text(json.dumps(TASKS))
    options = runs.RunOptions((("m", "raw"), ("n", "chat")), n_samples=1)
    folders = [f"file://{tmp_path}/{n}" for n in ("one", "two")]
    summary = drivers.generate_run(spark, tasks, folders[0], options, adapter=answers)
    assert (summary["expected_records"], summary["n_records_written"]) == (4, 4)
    again = drivers.generate_run(spark, tasks, folders[0], options, log_exists=True)
    assert again["n_missing"] == 0 and again["n_records_written"] == 4 + summary["n_missing"]
    drivers.generate_run(spark, tasks, folders[1], options)
    with pytest.raises(FileNotFoundError, match="grade the run"):
        drivers.compare_run_folders(spark, *folders)
    for folder in folders:
        found = drivers.grade_run(spark, folder, tasks, policy="prefer_success")
        assert [m["n"] for m in found["models"]] == [2, 2]
    assert json.loads((tmp_path / "one/metrics.json").read_text())["models"][0]["n_correct"] >= 1
    found, text = drivers.compare_run_folders(spark, *folders)
    assert len(found["models"]) == 2 and text.startswith("# Comparison")
    assert "| m |" in cli.run(spark, cli.parser().parse_args(["compare", "--baseline", folders[0], "--treatment", folders[1]]))
    [counts] = json.loads(cli.run(spark, cli.parser().parse_args(["dedup", "--run", folders[0]])))
    assert counts["n_keys"] == 4


def test_validate_and_freeze(spark, tmp_path):
    path, manifest = tmp_path / "tasks.json", f"file://{tmp_path}/manifest.json"
    path.write_text(json.dumps(TASKS))
    found = drivers.validate_tasks(spark, f"file://{path}", expected=2, manifest_path=manifest)
    assert found["problems"] == [] and (tmp_path / "manifest.json").exists()
    assert drivers.validate_tasks(spark, f"file://{path}", manifest_path=manifest)["sha256"] == found["sha256"]
    path.write_text(json.dumps(TASKS) + " ")
    with pytest.raises(ValueError, match="frozen"):
        drivers.validate_tasks(spark, f"file://{path}", manifest_path=manifest)


def test_eval20_page(spark, tmp_path):
    rows = [{"task_id": 1, "category": "math", "difficulty": "easy", "gold_answer": "10", "base_zero_shot": "10", "base_few_shot": "10", "instruct_zero_shot": "answer is 10", "instruct_few_shot": ""}, {"task_id": 6, "category": "logic", "difficulty": "hard", "gold_answer": "yes", "base_zero_shot": "x", "base_few_shot": "Yes", "instruct_zero_shot": "no", "instruct_few_shot": "yes"}]
    (tmp_path / "wide.json").write_text(json.dumps(rows))
    graded, found, page = drivers.eval20(spark, f"file://{tmp_path}/wide.json")
    assert graded.filter("final_correct").count() == 5
    assert [r["condition"] for r in found["needs_review"]] == ["base_zero_shot"]
    assert "| base_few_shot | 1.00 |" in page and "| math | 1/1 | 1/1 | 1/1 | 0/1 |" in page
    data = {"metadata": {}, "tasks": [{"task_id": 1, "category": "math", "difficulty": "easy", "gold_answer": "10", "conditions": {c: {"user_prompt": "u", "samples": [{"seed": 1, "output": o}]} for c, o in (("A_original", "10\n\n3"), ("B_delimiters", "9 or 10"))}}]}
    (tmp_path / "ablation.json").write_text(json.dumps(data))
    summary = drivers.ablation(spark, f"file://{tmp_path}/ablation.json")[1].collect()
    assert [(r.condition, r.n_correct) for r in summary] == [("A_original", 1), ("B_delimiters", 0)]


def test_eval20_run_holds_what_eval20_does(spark, tmp_path):
    said = [("10", "10", "answer is 10", ""), ("10", "Answer: 11", "no number", "\nwords"), ("x", "", "I'm sorry.\n\n4", "It is.\nReview: a\nb")]
    facts = [(1, "math", "easy", "10"), (6, "logic", "hard", "yes"), (6, "logic", "hard", "yes"), (9, "labels", "easy", "positive"), (1, None, "easy", "10")]
    rows = [dict(zip(("task_id", "category", "difficulty", "gold_answer", *drivers.grade.CONDITIONS), (*f, *s), strict=True)) for f in facts for s in said]
    fixes = {"6": {"base_zero_shot": {"correct": True, "reason": "by hand"}}}
    for name, overrides, data in (("some", fixes, rows), ("none", None, [])):
        (tmp_path / f"{name}.json").write_text(json.dumps(data))
        (tmp_path / "fixes.json").write_text(json.dumps(overrides))
        paths = f"file://{tmp_path}/{name}.json", f"file://{tmp_path}/fixes.json" if overrides else None
        _, found, page = drivers.eval20(spark, *paths)
        tables = {k: drivers.rows_of(t) for k, t in drivers.eval20_run(spark, paths[0], f"file://{tmp_path}/{name}", paths[1]).items()}
        assert "".join(f.read_text() for f in sorted((tmp_path / name / "results").glob("part-*"))) == page
        plain = lambda rows: sorted(map(str, rows))
        for same in ("conditions", "needs_review", "overrides_applied"):
            assert plain(tables[same]) == plain(found[same])
        lists = [(r["condition"], k, t) for r in found["behavior"] for k in ("drift_tasks", "refusals", "empty_outputs") for t in r[k]]
        assert plain((r["condition"], r["list"], r["task_id"]) for r in tables["behavior_tasks"]) == plain(lists)
        assert plain((r["condition"], r["n_drift"], r["n_refusals"], r["n_empty_outputs"], r["mean_chars"]) for r in tables["behavior"]) == plain((r["condition"], *(len(r[k]) for k in ("drift_tasks", "refusals", "empty_outputs")), r["mean_chars"]) for r in found["behavior"])
        flips = [(r["first"], r["second"], k, t) for r in found["pairwise"] for k in ("only_first_correct", "only_second_correct") for t in r[k]]
        assert plain((r["first"], r["second"], r["list"], r["task_id"]) for r in tables["discordant"]) == plain(flips)
        assert len(tables["graded"]) == 4 * len(data) and (not data or lists and flips and found["needs_review"])


def test_eval20_metrics_sends_only_small_results_to_the_driver(spark, sf_dir, monkeypatch):
    from tallyforge.plans import catalogue

    sizes, frame = [], type(spark.range(1))
    collect = frame.collect

    def counted(self):
        rows = collect(self)
        sizes.append(sum(1 + sum(len(v) for v in r if isinstance(v, list)) for r in rows))
        return rows

    monkeypatch.setattr(frame, "collect", counted)
    catalogue.QUERIES["eval20_metrics"](spark, sf_dir)
    assert sizes and max(sizes) < 50 < spark.read.parquet(f"{sf_dir}/part.parquet").count()


def test_eval20_run_on_the_command_line(spark, tmp_path):
    (tmp_path / "wide.json").write_text(json.dumps([{"task_id": 1, "category": "math", "difficulty": "easy", "gold_answer": "10", **dict.fromkeys(drivers.grade.CONDITIONS, "10")}]))
    found = json.loads(cli.run(spark, cli.parser().parse_args(["eval20", "--outputs", f"file://{tmp_path}/wide.json", "--run", f"file://{tmp_path}/run"])))
    assert [r["n"] for r in found["conditions"]] == [1] * 12 and len(found["pairwise"]) == 6
    assert (tmp_path / "run/results/_SUCCESS").exists()


def test_ablation_audit_and_inspect(spark, tmp_path):
    path, outputs, run = tmp_path / "tasks.json", tmp_path / "wide.json", f"{tmp_path}/run"
    prompts = [{"id": i, "category": "math", "difficulty": "easy", "answer_type": "number", "prompt": f"What is {i}?\nAnswer:", "few_shot_prefix": "Q: 1+1\nAnswer: 2\n\n", "gold_answer": str(i)} for i in (1, 2, 3)]
    path.write_text(json.dumps({"version": "v1", "prompts": prompts}))
    outputs.write_text(json.dumps([{"task_id": i, "category": "math", "difficulty": "easy", "gold_answer": str(i), "base_zero_shot": "", "base_few_shot": "", "instruct_zero_shot": f"{i}", "instruct_few_shot": "99" if i < 3 else "3"} for i in (1, 2, 3)]))
    call = lambda *more: cli.run(spark, cli.parser().parse_args([*more]))
    found = json.loads(call("ablation", "--tasks", str(path), "--run", f"{run}-ablation", "--model", "m:chat", "--problems", "3,1"))
    assert [(r["condition"][0], r["n"], r["n_override"]) for r in found] == [("A", 2, 0), ("B", 2, 0), ("C", 2, 0), ("D", 2, 0)]
    audit = ["audit", "--tasks", str(path), "--outputs", str(outputs), "--run", run, "--model", "m:chat"]
    with pytest.raises(FileNotFoundError, match="no samples"):
        call(*audit, "--reclassify")
    first = json.loads(call(*audit))
    assert [(r["task_id"], r["n_samples"], r["greedy_output"]) for r in first["audit"]] == [(1, 5, "99"), (2, 5, "99")]
    assert json.loads(call(*audit, "--reclassify")) == first
    assert [(r["problem_id"], r["sample_index"], r["prediction_status"]) for r in json.loads(call("inspect", "--run", run, "--problem", "2"))] == [(2, i, None) for i in range(5)]
