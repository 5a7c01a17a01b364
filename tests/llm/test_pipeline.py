import inspect

import corpus_pipeline
from llm_cases import ODD_TEXTS, prose

from tallyforge.llm import decontaminate, jaccard, pii, quality


def test_stages_keep_columns_and_take_effect(spark, make, tmp_path):
    leak = prose(500, 40)
    texts = [*ODD_TEXTS, (20, prose(20, 80)), (21, prose(20, 80)), (22, prose(22, 40) + " " + leak), (23, prose(23, 60) + " mail x@y.example.com now"), (24, "### $$$ ||| &&& " * 20)]
    docs = make(texts)
    spark.createDataFrame([(20, 1, 0), (24, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert list(inspect.signature(stage).parameters) == ["spark", "docs", "sf_dir"]
        docs = stage(spark, docs, str(tmp_path))
        path = f"{tmp_path}/{name.replace(' ', '_')}"
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == make([]).columns
    ids = {r.doc_id for r in docs.collect()}
    assert {20, 23} <= ids
    assert not ids & {21, 22, 24, 4, 5, 6, 7, 8}


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "n-gram Jaccard join", "benchmark decontamination", "PII", "best-fit packing"]


def test_run_against_brute_force(spark):
    """The stages on the smallest table, each filter redone with plain loops."""
    folder = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.train(docs, labels)
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = {d: t for d, t in rows.items() if quality.judge(t or "", model)[-1]}
    sets = {}
    for d, t in kept.items():
        words = jaccard.words_of(t)
        sets[d] = frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))
    root = {d: d for d in sets}
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and root[a] != root[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    words = lambda t: f" {' '.join(map(str, decontaminate.word_ids(t).tolist()))} "
    clean = {d for d in set(root.values()) if not any(words(i) in words(kept[d]) for i in items)}
    got = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in got} == clean
    assert pii.train(docs.limit(0)) is not None
