import json
import random

import pytest

from tallyforge.sources import documents, files

SCHEMA = "id long, text string, inner struct<a:array<long>,b:map<string,string>>"
ODD = ['"', "\\", '\\"', "[", "]", "{", "}", '"}', "},{", "\\\\", "é", "\U0001f600", "\n", "a,b", ":", "x" * 60]


def objects(seed, n):
    rng = random.Random(seed)
    text = lambda: "".join(rng.choice(ODD) for _ in range(rng.randrange(9)))
    return [{"id": i, "text": text(), "inner": {"a": [rng.randrange(9) for _ in range(rng.randrange(3))], "b": {text() or "k": text()}}} for i in range(n)]


def plain(rows):
    return sorted((r.asDict(recursive=True) for r in rows), key=lambda r: r["id"])


@pytest.fixture
def small_blocks(spark):
    settings = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("indent", "ascii_only"), [(None, True), (2, False)])
def test_blocks_that_cut_anywhere(spark, small_blocks, tmp_path, indent, ascii_only):
    want = objects(1, 120)
    path = tmp_path / "rows.json"
    path.write_text(json.dumps(want, indent=indent, ensure_ascii=ascii_only))
    assert documents._pieces(spark, str(path)).rdd.getNumPartitions() > 10
    assert plain(documents.read_objects(spark, str(path), SCHEMA).collect()) == want


def test_objects_longer_than_blocks(spark, small_blocks, tmp_path):
    want = [{"id": i, "text": ('say "[{" ' + "\\" * (i % 3)) * 300 * (i % 4), "inner": {"a": [], "b": {}}} for i in range(12)]
    (tmp_path / "rows.json").write_text(json.dumps(want))
    assert plain(documents.read_objects(spark, str(tmp_path / "rows.json"), SCHEMA).collect()) == want


def test_under_a_key_with_a_head(spark, small_blocks, tmp_path):
    for n, name in ((40, "a"), (0, "b"), (1, "c")):
        (tmp_path / f"{name}.json").write_text(json.dumps({"version": f'v "{name}"', "note": "[{", "meta": {"k": "}"}, "rows": objects(n, n), "n": n}, indent=n % 3 or None))
    found = documents.read_objects(spark, str(tmp_path), SCHEMA, key="rows", head="version string, n long").collect()
    assert sorted((r.version, r.n, r.id) for r in found) == [('v "a"', 40, i) for i in range(40)] + [('v "c"', 1, 0)]
    assert plain(r for r in documents.read_objects(spark, f"{tmp_path}/a.json", SCHEMA, key="rows").collect()) == objects(40, 40)


def test_small_and_broken_documents(spark, tmp_path):
    read = lambda text: ((tmp_path / "x.json").write_text(text), documents.read_objects(spark, f"{tmp_path}/x.json", SCHEMA).collect())[1]
    assert read("[]") == [] and read(" [ ] \n") == [] and read("") == []
    assert [r.id for r in read('[{"id": 1}]')] == [1]
    with pytest.raises(ValueError, match="complete"):
        read('[{"id": 1}, {"id"')


def test_same_rows_as_before(spark, tmp_path):
    tasks = [{"id": i, "category": "c", "answer_type": "label", "labels": ["a", "b"], "code_tests": None, "prompt": f'p "{i}"', "gold_answer": "a"} for i in range(3)]
    (tmp_path / "t.json").write_text(json.dumps({"version": "v1", "created": "now", "note": None, "prompts": tasks}, indent=2))
    found = files.read_tasks(spark, f"{tmp_path}/t.json").orderBy("id").collect()
    assert [(r.benchmark_version, r.id, r.labels, r.prompt, r.unit) for r in found] == [("v1", i, ["a", "b"], f'p "{i}"', None) for i in range(3)]


def test_an_array_is_written_by_lines_as_one_file(spark, tmp_path):
    from tallyforge.sources import files

    for n in (0, 1, 5000):
        rows = spark.range(n).selectExpr("id AS a", "concat('say \"', id, '\"') AS b").repartition(3)
        path = files.write_array(rows, f"file://{tmp_path}/array-{n}", head='{"x":[', tail="]}")
        [file] = (tmp_path / f"array-{n}").glob("*.txt")
        document = json.loads(file.read_text())
        assert sorted(r["a"] for r in document["x"]) == list(range(n))
        assert max(map(len, file.read_text().splitlines())) < 100  # a row never holds the table
        assert documents.read_objects(spark, path, "a long, b string", key="x").count() == n


def test_changed_files(spark, tmp_path):
    from tallyforge.sources import files

    for name in "ab":
        (tmp_path / f"{name}.bin").write_text(name)
    digests = files.file_digests(spark, f"file://{tmp_path}/*.bin").collect()
    (tmp_path / "b.bin").write_text("other")
    found = files.changed_files(spark, f"file://{tmp_path}/*.bin", spark.createDataFrame(digests)).collect()
    assert sorted((r.path[-5:], r.changed) for r in found) == [("a.bin", False), ("b.bin", True)]
