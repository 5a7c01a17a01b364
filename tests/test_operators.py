import itertools
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import prompts
from tallyforge.operators import compare, contain, grade, metrics, report, runs, sandbox, validate
from tallyforge.sources import files

TASKS = [
    (1, "math", "easy", "number", None, None, None, "1+1?\nAnswer:", "Q\nAnswer: 5\n\n", "2"), (2, "logic", "hard", "yesno", None, None, None, "ok?", "Q\nAnswer: no\n\n", "yes"),
    (3, "classification", "medium", "label", None, ["spam", "not spam"], None, "c?", "Q\nAnswer: spam\n\n", "not spam"),
    (4, "code", "easy", "code", None, None, '{"fn": "add", "tests": [[[2, 3], 5]]}', "Write add.\nCode:", "Q\nCode: x\n\n", "def add"),
    (5, "extraction", "easy", "string", None, None, None, "date?", "Q\nAnswer: May 1\n\n", "June 14, 2026"),
]


def tasks(spark, rows=TASKS):
    return spark.createDataFrame(rows, schemas.TASK)


def generations(spark, rows):
    """Rows (problem_id, model_id, sample_index, text, error, n_output)."""
    full = [("v1", p, m, "raw", "direct", s, 7, False, None, 200, "prompt", t, 5, n, 0.1, e) for p, m, s, t, e, n in rows]
    return spark.createDataFrame(full, schemas.GENERATION)


def test_grade_generations(spark):
    rows = [(1, "a", 0, "The answer is 2.", None, 4), (1, "b", 0, "no idea", None, None), (2, "a", 0, "Yes!", "", 4), (3, "a", 0, "It is not spam", None, 4), (4, "a", 0, "def add(a, b): return a + b", None, 4), (5, "a", 0, "on June 14, 2026 at noon", None, 4), (2, "b", 0, "", "OutOfMemory: x", None)]
    graded = grade.grade_generations(generations(spark, rows), tasks(spark), run_code=True)
    got = {(r.problem_id, r.model_id): r for r in graded.collect()}
    assert {k: r.correct for k, r in got.items()} == {(1, "a"): True, (1, "b"): False, (2, "a"): True, (3, "a"): True, (4, "a"): True, (5, "a"): True, (2, "b"): False}
    assert got[2, "b"].flags == ["generation_error"]
    assert (got[4, "a"].status, got[4, "a"].prediction_str, got[4, "a"].strategy) == ("parsed", "1/1 tests passed", "exec")
    off = {(r.problem_id, r.model_id): r for r in grade.grade_generations(generations(spark, rows), tasks(spark)).collect()}
    assert off[4, "a"].flags == ["code_not_run"] and not off[4, "a"].correct
    assert sorted((r.problem_id, r.model_id) for r in grade.parse_failures(graded).collect()) == [(1, "b"), (2, "b")]
    summary = {r.model_id: r for r in metrics.model_summary(graded).collect()}
    assert (summary["a"].n, summary["a"].n_correct, summary["a"].accuracy) == (5, 5, 1.0)
    assert summary["b"].mean_output_tokens == 0.0


def test_unknown_task_is_an_error(spark):
    with pytest.raises(Exception, match="unknown task id"):
        grade.grade_generations(generations(spark, [(99, "a", 0, "x", None, 1)]), tasks(spark)).collect()


def test_legacy_grading_and_overrides(spark):
    wide = spark.createDataFrame([(1, "math", "easy", "10", "The answer is 10.", "10\n\nQuestion: 3", "= 9", ""), (9, "classification", "easy", "positive", "Positive\nx", "none", "a\nb\npositive", "neutral"), (16, "code", "easy", "x", "def add(a, b):\n    return a + b", "", "zzz(", "x = 1")], schemas.OUTPUTS_WIDE)
    cells = grade.unpivot_conditions(wide)
    fixed = spark.createDataFrame([(1, "instruct_few_shot", True, "read by hand")], schemas.OVERRIDES)
    graded = grade.grade_legacy(cells, "eval20", run_code=True, overrides=fixed)
    got = {(r.task_id, r.condition): r for r in graded.collect()}
    assert [got[1, c].auto_correct for c in grade.CONDITIONS] == [True, True, False, False]
    assert got[1, "instruct_few_shot"].final_correct and got[1, "instruct_few_shot"].overridden
    assert [got[9, c].auto_correct for c in grade.CONDITIONS] == [True, False, False, False]
    assert got[9, "base_few_shot"].flags == ["needs_review"]
    assert [got[16, c].auto_correct for c in grade.CONDITIONS] == [True, False, False, False]
    assert got[16, "instruct_few_shot"].flags == ["function_not_defined", "needs_review"]
    assert {(r.task_id, r.condition) for r in grade.needs_review(graded).collect()} == {(9, "base_few_shot"), (9, "instruct_zero_shot"), (16, "instruct_few_shot")}
    table = report.pivot_accuracy(graded, "category", grade.CONDITIONS).orderBy("category").collect()
    assert [tuple(r)[1:] for r in table] == [("1/1", "0/1", "0/1", "0/1"), ("1/1", "0/1", "0/1", "0/1"), ("1/1", "1/1", "0/1", "1/1")]


def test_audit(spark):
    samples = spark.createDataFrame([(t, "math", "10", o) for t, os in {1: ["10", "10"], 2: ["10", "9"], 3: ["9", "9"], 4: ["8", "9"]}.items() for o in os], "task_id long, category string, gold_answer string, output string")
    got = {r.task_id: (r.n_correct, r.unique_wrong_answers, r.verdict.split()[0]) for r in grade.audit_samples(samples).collect()}
    assert got == {1: (2, [], "all"), 2: (1, ["9"], "mixed"), 3: (0, ["9"], "STABLE"), 4: (0, ["8", "9"], "UNSTABLE")}
    wide = spark.createDataFrame([(1, "math", "10", "9", "10"), (2, "math", "10", "10", "10"), (3, "code", "x", "a", "b")], "task_id long, category string, gold_answer string, few string, zero string")
    wrong, code = grade.audit_candidates(wide, "few", "zero")
    assert [r.task_id for r in wrong.collect()] == [1]
    assert [r.task_id for r in code.collect()] == [3]


def test_sandbox():
    tests = json.dumps({"fn": "f", "tests": [[[1], True], [[0], False]]})
    assert sandbox.grade_code("def f(x): return x", tests) == (True, "2/2 tests passed", [])
    assert sandbox.grade_code("import os\nos._exit(0)", tests)[2] == ["exec_error: SystemExit"]
    assert sandbox.grade_code("raise SystemExit", tests)[2] == ["exec_error: SystemExit"]
    assert sandbox.grade_code("while True: pass", tests, timeout=1)[2] == ["exec_error: TimeoutError"]
    assert sandbox.grade_code("x = 'a' * (1 << 33)\ndef f(x): return x", tests)[2] == ["exec_error: MemoryError"]
    assert sandbox.grade_code("def f(x): print(x); return x", tests)[0]
    with pytest.raises(PermissionError):
        sandbox.grade_code_rows(None)


ATTACKS = {
    "forged verdict": ("import os\nos.write(1, b'{\"passed\": 2}')\nos.write(3, b'{\"passed\": 2}')\nos._exit(0)", "OutputError|expected 0"),
    "forged values": ("import os, json\nos.write(3, json.dumps({'got': [[1], [1]]}).encode())\nos._exit(0)", "1/2"),
    "equal to everything": ("class A:\n    def __eq__(self, o): return True\n    def __hash__(self): return 1\ndef f(x): return A()", "0/2"),
    "subclass": ("class A(int):\n    def __eq__(self, o): return True\ndef f(x): return A(7)", "0/2"),
    "fork": ("import os\nwhile True:\n    os.fork()\n", "BlockingIOError|OSError"),
    "threads": ("import threading\ndef f(x):\n    threading.Thread(target=lambda: None).start()\n    return x", "0/2"),
    "large file": ("def f(x):\n    with open('/tmp/tallyforge-attack', 'wb') as out:\n        for _ in range(10_000):\n            out.write(b'x' * (1 << 20))\n    return x", "0/2"),
    "large answer": ("def f(x): return 'x' * (1 << 24)", "OutputError"),
    "many descriptors": ("import os\ndef f(x):\n    for _ in range(100): os.open('/dev/null', 0)\n    return x", "0/2"),
    "killing the parent": ("import os, signal\nos.kill(os.getppid(), signal.SIGKILL)\ndef f(x): return x", "PermissionError|SandboxLost"),
    "reads the tests": ("import sys\ndef f(x):\n    frame = sys._getframe()\n    while frame:\n        if 'job' in frame.f_locals: return frame.f_locals['job'].get('tests', [[0, 9]])[0][1]\n        frame = frame.f_back", "0/2"),
    "endless output": ("def f(x):\n    while True: print('x' * 1000)", "TimeoutError|0/2"),
}


@pytest.mark.parametrize("name", sorted(ATTACKS))
def test_sandbox_attacks(name):
    code, want = ATTACKS[name]
    tests = json.dumps({"fn": "f", "tests": [[[1], 1], [[0], 0]]})
    with sandbox.Sandbox(timeout=2) as box:
        correct, passed, flags = box.grade(code, tests)
        assert not correct
        assert any(w in f"{passed} {flags}" for w in want.split("|")), (passed, flags)
        assert box.grade("def f(x): return x", tests) == (True, "2/2 tests passed", [])  # the sandbox still serves


def test_sandbox_values():
    cases = [("(1, 2)", [1, 2]), ("[1, (2, 3)]", [1, [2, 3]]), ("{'a': [1.5, None, True]}", {"a": [1.5, None, True]}), ("1.0", 1), ("True", 1), ("'é'", "é"), ("{1, 2}", [1, 2]), ("float('nan')", 0)]
    with sandbox.Sandbox() as box:
        got = [box.grade(f"def f(): return {made}", json.dumps({"fn": "f", "tests": [[[], expected]]}))[0] for made, expected in cases]
    assert got == [True, False, True, True, True, True, False, False]


def test_last_record_of_a_cell(spark):
    schema = "model_id string, problem_id long, sample_index long, correct boolean, status string, category string, n_output_tokens long"
    run = lambda marks: spark.createDataFrame([("m", p, i, c == "C", "parsed", "cat", 5) for p, cell in enumerate(marks) for i, c in enumerate(cell)], schema)
    first, second = run(["C.", "CC", ".C"]), run(["..", "CC.", "C"])
    assert sorted((r.problem_id, r.b_correct, r.t_correct, r.flip) for r in compare.paired(first, second).collect()) == [(0, False, False, None), (1, True, False, "regression"), (2, True, True, None)]
    [row] = compare.compare_runs(first, second).collect()
    assert (row.baseline_n, row.baseline_n_correct, row.treatment_n, row.treatment_n_correct) == (3, 2, 3, 1)
    bare = lambda df: df.drop("sample_index")
    assert compare.paired(bare(run(["C"])), bare(run(["."]))).count() == 1
    with pytest.raises(Exception, match="several records of one cell"):
        compare.paired(bare(first), bare(second)).collect()
    pairs = compare.paired(first, second)
    page = report.comparison_page(("one", "two"), compare.compare_runs(first, second), compare.by_category(pairs), compare.flips(pairs), (0, 4))
    for part in ("# Comparison of one and two", "Parse failures: one 0, two 4", "| accuracy | 66.7% | 33.3% |", "| 95% interval |", "| mean output tokens | 5.0 | 5.0 |", "| cat | 3 | 2 | 1 |", "Regressions: 1\n- task 1 (cat)", "Fixes: 0"):
        assert part in page


def test_compare(spark):
    predictions = lambda marks: spark.createDataFrame([(p, "m", "direct", 0, 1, "g", "number", "v", p, "parsed", "1", "s", [], None, [], c == "C", "cat") for p, c in enumerate(marks)], schemas.PREDICTION)
    pairs = compare.paired(predictions("CC.."), predictions("C.C."))
    assert sorted((r.problem_id, r.flip) for r in compare.flips(pairs).collect()) == [(1, "regression"), (2, "fix")]
    [lists] = compare.flip_lists(pairs).collect()
    assert (lists.n_regressions, lists.n_fixes, lists.mcnemar_exact_p, lists.fixes[0].problem_id) == (1, 1, 1.0, 2)
    [row] = compare.compare_runs(predictions("CC.."), predictions("CCC.")).collect()
    assert (row.baseline_accuracy, row.treatment_accuracy, row.delta_accuracy, row.delta_percentage_points) == (0.5, 0.75, 0.25, 25.0)
    with pytest.raises(Exception, match="missing in one run"):
        compare.paired(predictions("CC"), predictions("C")).collect()
    twice = predictions("C").unionByName(predictions(".").withColumn("sample_index", F.lit(1).cast("long")))
    assert [r.correct for r in compare.cell_table(twice, "sample_index").collect()] == [False]
    text = report.comparison_markdown(compare.compare_runs(predictions("CC"), predictions("C.")), compare.by_category(pairs))
    assert "| m | 2/2 | 1/2 | -50.0 |" in text


def test_runs(spark):
    rows = [(1, "a", 0, "bad", "failed", None), (1, "a", 0, "good", None, 3), (1, "a", 0, "later", None, 3), (2, "a", 0, "x", "failed", None)]
    log = generations(spark, rows).withColumn("position", F.monotonically_increasing_id())
    pick = lambda policy: {r.problem_id: r.completion_text for r in runs.dedup(log, schemas.CELL, "position", policy=policy).collect()}
    assert pick("first") == {1: "bad", 2: "x"}
    assert pick("last") == {1: "later", 2: "x"}
    assert pick("prefer_success") == {1: "good", 2: "x"}
    with pytest.raises(ValueError, match="policy"):
        pick("odd")
    [counts] = runs.duplicate_counts(log, schemas.CELL).collect()
    assert tuple(counts) == (4, 2, 2)
    options = runs.RunOptions((("a", "raw"), ("b", "chat")))
    planned = runs.plan_run(spark, tasks(spark).withColumn("benchmark_version", F.lit("v1")), options, log)
    assert planned.count() == 9
    made = runs.generate(planned, options)
    assert made.columns == [f.split()[0] for f in schemas.GENERATION.split(", ")]
    assert made.filter("error IS NULL").count() == 9
    again = runs.plan_run(spark, tasks(spark).withColumn("benchmark_version", F.lit("v1")), options, log.drop("position").unionByName(made))
    assert again.count() == 0

    def broken(rows):
        raise RuntimeError("no model")

    assert {r.error for r in runs.generate(planned, options, broken).collect()} == {"RuntimeError: no model"}


def test_adapter_answers():
    """One start for a partition; a failure costs its row alone, also if the adapter takes rows ahead."""
    starts = []

    def adapter(size):
        def answer(rows):
            starts.append(1)
            rows = iter(rows)
            while some := list(itertools.islice(rows, size)):
                for prompt, seed in some:
                    if prompt == "bad":
                        raise ValueError("no")
                    yield f"{prompt}{seed}", 1, 2

        return answer

    rows = [(i, p, i) for i, p in enumerate(["a", "bad", "c", "d", "bad", "bad", "g"])]
    for size in (1, 2, 3, 10):
        starts.clear()
        got = [(r[0], a and a[0], e) for r, a, e, _ in runs.answers(adapter(size), iter(rows))]
        assert got == [(i, None if p == "bad" else f"{p}{i}", "ValueError: no" if p == "bad" else None) for i, p, _ in rows]
        assert len(starts) == 4
    assert [e for *_, e, _ in runs.answers(lambda r: iter([]), iter(rows))] == ["RuntimeError: the adapter gave no answer"] * 7
    assert list(runs.answers(adapter(3), iter([]))) == []


def test_log_order(spark, tmp_path):
    """The first record of a cell is that of the first append, whatever sizes and names its files have."""
    path = f"file://{tmp_path}/log"
    for turn, size in enumerate((10, 5000, 1)):
        rows = spark.range(60).selectExpr("'v' benchmark_version", "id problem_id", "'m' model_id", "'direct' condition", "0L sample_index", f"repeat('{turn}', {size}) completion_text", "0D elapsed_seconds")
        files.append_jsonl(rows.repartition(3 - turn), path)
    log = files.read_generations(spark, path, position="log_position")
    for policy, want in (("first", "0"), ("last", "2")):
        assert {r.completion_text[0] for r in runs.dedup(log, schemas.CELL, "log_position", policy=policy).collect()} == {want}
    (tmp_path / "one.jsonl").write_text("".join(f'{{"problem_id": {i % 7}, "completion_text": "{i}"}}\n\n' for i in range(70)))
    one = files.read_generations(spark, f"file://{tmp_path}/one.jsonl", position="log_position")
    assert sorted(int(r.completion_text) for r in runs.dedup(one, ["problem_id"], "log_position").collect()) == list(range(7))
    assert sorted(int(r.completion_text) for r in runs.dedup(one, ["problem_id"], "log_position", policy="last").collect()) == list(range(63, 70))


def test_two_corrections_are_an_error(spark):
    graded = spark.createDataFrame([(1, "c", True)], "task_id long, condition string, auto_correct boolean")
    fixed = spark.createDataFrame([(1, "c", True, "a"), (1, "c", False, "b")], "task_id long, condition string, correct boolean, reason string")
    with pytest.raises(Exception, match="several corrections of task 1 c"):
        grade.apply_overrides(graded, fixed).collect()


def test_clashing_names(spark):
    rows = spark.createDataFrame([(1, "mine", "own")], "problem_id long, _known string, _task string")
    [got] = grade.checked_join(rows, spark.createDataFrame([(1, "t")], "id long, kind string")).collect()
    assert (got._known, got._task, got.kind) == ("mine", "own", "t")


def test_random_labels_against_python(spark):
    """The permutation of demonstrations, against Python's seeded shuffle."""
    import random

    blocks = [f"Q{i}\nAnswer: a{i}" for i in range(4)]
    rows = spark.createDataFrame([(i, "\n\n".join(blocks) + "\n\n", "P?\nAnswer:") for i in range(40)], "id long, few_shot_prefix string, prompt string")
    for r in prompts.build_prompts(rows, "few_shot_random_label").collect():
        labels = [f"a{i}" for i in range(4)]
        random.Random(20260827 + r.id).shuffle(labels)
        assert r.prompt_text == "\n\n".join(f"Q{i}\nAnswer: {x}" for i, x in enumerate(labels)) + "\n\nP?\nAnswer:"


def test_options():
    assert runs.parse_model_spec("org/m:chat") == ("org/m", "chat")
    assert runs.parse_model_spec("m") == ("m", "raw")
    for bad in ("m:odd", ":raw"):
        with pytest.raises(ValueError):
            runs.parse_model_spec(bad)
    assert runs.parse_ids("all") is None
    assert runs.parse_ids("3, 1") == [3, 1]
    for bad in ("", "1,1", "x"):
        with pytest.raises(ValueError):
            runs.parse_ids(bad)
    for bad in ({"condition": "odd"}, {"n_samples": 2}, {"do_sample": True}):
        with pytest.raises(ValueError):
            runs.RunOptions((("a", "raw"),), **bad)


def test_select_tasks(spark):
    assert runs.select_tasks(tasks(spark), [1, 3]).count() == 2
    with pytest.raises(ValueError, match=r"\[9\]"):
        runs.select_tasks(tasks(spark), [1, 9])


def test_validation(spark):
    assert validate.validate_all(tasks(spark), 5).collect() == []
    bad = [
        (1, "math", "easy", "number", None, None, None, "p", "Answer: 2.0\n", "2"), (1, "math", "odd", "kind", None, None, None, "p", "", "2"), (3, "math", "easy", "label", None, None, None, "q", "", "x"),
        (4, "math", "easy", "code", None, None, None, "r", "", "x"), (5, "math", "easy", "yesno", None, None, None, "s", "", "maybe"), (6, None, "easy", "number", None, None, None, None, "", "z"), (7, "math", "easy", "string", None, None, None, "t", 'Answer:  "The END."\n', "the end"),
    ]
    found = {(r.task_id, r.rule) for r in validate.validate_all(tasks(spark, bad), 50).collect()}
    assert found == {
        (None, "expected_count"), (1, "unique_ids"), (6, "missing_fields"), (1, "known_values"), (3, "label_gold"), (4, "code_tests"), (1, "duplicate_prompts"), (5, "gold_format"), (5, "self_extraction"), (1, "leaks"), (7, "leaks"),
    }
    assert validate.frozen("a", None) == validate.frozen("a", "a") == "a"
    with pytest.raises(ValueError):
        validate.frozen("a", "b")
    [audit] = validate.cot_audit(tasks(spark)).collect()
    assert tuple(audit) == (5, 2, 3)


def test_files(spark, tmp_path):
    (tmp_path / "log.jsonl").write_text('{"problem_id": 1, "completion_text": "a"}\n\n{"problem_id": 2, "partial"\n{"problem_id": 3}\n')
    records, bad = files.read_jsonl(spark, f"file://{tmp_path}/log.jsonl", schemas.GENERATION)
    assert sorted(r.problem_id for r in records.collect()) == [1, 3]
    assert bad.count() == 1
    files.append_jsonl(records, f"file://{tmp_path}/out")
    files.append_jsonl(records, f"file://{tmp_path}/out")
    assert files.read_generations(spark, f"file://{tmp_path}/out").count() == 4
    files.write_json(spark, f"file://{tmp_path}/tasks.json", {"version": "v1", "prompts": [{"id": 1, "labels": ["é"], "gold_answer": "2"}]})
    assert (tmp_path / "tasks.json").read_text().endswith("}\n") and "é" in (tmp_path / "tasks.json").read_text()
    [task] = files.read_tasks(spark, f"file://{tmp_path}/tasks.json").collect()
    assert (task.benchmark_version, task.id, task.labels, task.category) == ("v1", 1, ["é"], None)
    with pytest.raises(FileNotFoundError, match="grade the run"):
        files.read_predictions(spark, f"file://{tmp_path}/none.json")
    assert files.read_predictions_or_none(spark, f"file://{tmp_path}/none.json").collect() == []
    assert files.count_parse_failures(spark, f"file://{tmp_path}/none.json") == 0
    assert files.read_overrides(spark, f"file://{tmp_path}/none.json").collect() == []
    (tmp_path / "o.json").write_text('{"3": {"base_zero_shot": {"correct": true, "reason": "r"}}}')
    assert [tuple(r) for r in files.read_overrides(spark, f"file://{tmp_path}/o.json").collect()] == [(3, "base_zero_shot", True, "r")]
    import hashlib

    [d] = files.file_digests(spark, f"file://{tmp_path}/o.json").collect()
    assert d.sha256 == hashlib.sha256((tmp_path / "o.json").read_bytes()).hexdigest()
    (tmp_path / "a.json").write_text('{"metadata": {}, "tasks": [{"task_id": 1, "gold_answer": "2", "conditions": {"A_original": {"user_prompt": "u", "samples": [{"seed": 1, "output": "x"}, {"seed": 2, "output": "y"}]}}}]}')
    assert [r.output for r in files.read_ablation(spark, f"file://{tmp_path}/a.json").collect()] == ["x"]
    assert files.read_ablation(spark, f"file://{tmp_path}/a.json", all_samples=True).count() == 2


def test_report_tables(spark):
    assert report.md_table(["a", "b"], [(1, None)]) == "| a | b |\n|---|---|\n| 1 | None |"
    cells = spark.createDataFrame([(t, c, f) for t in range(4) for c, f in (("x", t > 0), ("y", t > 2))], "task_id long, condition string, final_correct boolean")
    pairs = metrics.pairwise(cells, ["x", "y"])
    [p] = pairs.collect()
    assert (p.only_first_correct, p.only_second_correct, p.pair, p.mcnemar_exact_p) == ([1, 2], [], "x__vs__y", 0.5)
    [turned] = report.head_to_head(pairs, [("t", "y", "x")]).collect()
    assert (turned.n_only_first, turned.n_only_second) == (0, 2)
    summary = metrics.ranked(metrics.with_rates(cells.groupBy("condition").agg(*metrics.accuracy_columns("final_correct"))), ["x", "y"])
    text = report.results_markdown(summary, [("By task", report.pivot_accuracy(cells, "task_id", ["x", "y"]))], pairs.select("pair", "mcnemar_exact_p"), cells.limit(0))
    assert "| x | 0.75 |" in text
    assert [r.marks for r in report.verdict_marks(cells, ["condition"], "task_id", "final_correct").orderBy("condition").collect()] == [".CCC", "...C"]
    assert sorted(r.votes for r in metrics.majority_vote(cells, ["task_id"], "condition").collect()) == [1] * 4


def test_containments(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab c") for _ in range(n))
    texts = [(i, word(rng.randrange(40))) for i in range(80)] + [(80, None), (81, ""), (82, '"AB  b." '), (82, "ab b")]
    golds = [(i, word(rng.randrange(1, 6))) for i in range(60)] + [(60, None), (61, ""), (62, '  "ab B" '), (63, "b"), (64, "b")]
    both = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame(golds, "g long, gold string")
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"\.+$", "", t.strip().strip('"').strip())).lower()
    want = sorted((k, g) for k, t in texts if t is not None for g, x in golds if x is not None and norm(x) in norm(t))
    for part_bytes in (1 << 20, 40):
        found = contain.containments(*both, text_id="k", text="t", gold_id="g", gold="gold", part_bytes=part_bytes)
        assert "NestedLoop" not in found._jdf.queryExecution().toString() and "Cartesian" not in found._jdf.queryExecution().toString()
        assert sorted((r.text_id, r.gold_id) for r in found.collect()) == want
    assert contain.containments(both[0], both[1].limit(0), text_id="k", text="t", gold_id="g", gold="gold").collect() == []


def test_containments_collapse_white_space_of_texts_in_the_scan(spark):
    from tallyforge.functions import text as t

    points = [chr(c) for c in range(1, 0x3002) if not 0xD800 <= c < 0xE000]
    texts = [(i, f"{c}a{c} b{c}{c}") for i, c in enumerate(points)] + [(-1, ""), (-2, " \n"), (-3, "\tA \u3000\x1c b. ."), (-4, "a\nb ..")]
    both = spark.createDataFrame(texts, "k long, t string"), spark.createDataFrame([(1, "a b"), (2, "a b "), (3, "b")], "g long, gold string")
    assert [r.t for r in both[0].select("t", t.collapse(F.col("t")).alias("c")).collect() if t.collapse_str(r.t) != r.c] == []
    found = contain.containments(*both, text_id="k", text="t", gold_id="g", gold="gold")
    assert "regexp" not in found._jdf.queryExecution().optimizedPlan().toString().lower()
    both[0].select("k", t.normalize_text(F.col("t")).alias("n")).createOrReplaceTempView("n")
    both[1].select("g", t.normalize_text(F.col("gold")).alias("o")).createOrReplaceTempView("o")
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, spark.sql("SELECT k, g FROM n JOIN o ON contains(n, o)").collect()))
