import random
from collections import defaultdict

import numpy as np
from llm_cases import ODD_TEXTS, prose

from tallyforge.llm import jaccard


def shingle_set(text):
    words = jaccard.words_of(text or "")
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(docs):
    """(doc_id, class_id, n_links, n_copies) by comparing all pairs."""
    sets = [shingle_set(t) for _, t in docs]
    n = len(docs)
    near = [[i != j and (sets[i] == sets[j] or 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])) for j in range(n)] for i in range(n)]
    root = list(range(n))
    for i in range(n):
        for j in range(n):
            if near[i][j] and root[i] != root[j]:
                a, b = root[i], root[j]
                root = [a if r == b else r for r in root]
    ids = defaultdict(list)
    for i in range(n):
        ids[root[i]].append(docs[i][0])
    least = {r: min((x for x in v if x is not None), default=None) for r, v in ids.items()}
    return sorted(((docs[i][0], least[root[i]], sum(near[i]), sum(s == sets[i] for s in sets)) for i in range(n)), key=str)


def joined(df):
    return sorted(((r.doc_id, r.class_id, r.n_links, r.n_copies) for r in jaccard.join_ngrams(df).collect()), key=str)


def near_copies():
    rng = random.Random(11)
    docs = []
    for g in range(25):
        base = prose(g, rng.randrange(40, 200)).split()
        for _ in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(rng.randrange(4)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(99)}"
            docs += [(len(docs), " ".join(words))] * rng.choice([1, 1, 1, 2])
    return [(i, t) for i, (_, t) in enumerate(docs)]


def test_against_brute_force(make):
    docs = near_copies()
    assert joined(make(docs)) == brute(docs)


def test_odd_rows(make, odd, nothing):
    small = [(d, t) for d, t in ODD_TEXTS if len(t or "") < 100_000]
    assert joined(make(small)) == brute(small)
    assert len(joined(odd)) == len(ODD_TEXTS)
    assert joined(nothing) == []
    kept = jaccard.keep_firsts(odd, jaccard.join_ngrams(odd))
    assert kept.schema == odd.schema
    sets = {shingle_set(t) for _, t in ODD_TEXTS}
    assert len({shingle_set(r.text) for r in kept.collect()}) == kept.count() == len(sets)
    assert jaccard.keep_firsts(nothing, jaccard.join_ngrams(nothing)).collect() == []


def test_one_of_each_group_stays(make):
    docs = near_copies()
    df = make(docs)
    kept = {r.doc_id for r in jaccard.keep_firsts(df, jaccard.join_ngrams(df)).collect()}
    assert kept == {c for _, c, _, _ in brute(docs)}


def test_blocks(make, monkeypatch):
    """A group that is cut into several blocks gives the same links."""
    rng = random.Random(5)
    base = prose(77, 120).split()
    docs = []
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(6)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(999)}"
        docs.append((i, " ".join(words)))
    monkeypatch.setattr(jaccard, "BLOCK_NODES", 7)
    assert joined(make(docs)) == brute(docs)


def test_empty_blocks(make, monkeypatch):
    """A group of many more blocks than nodes, most of them empty, gives the same links."""
    docs = near_copies()
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", 50)
    assert joined(make(docs)) == brute(docs)


def test_depth_reaches_recall():
    depth = jaccard.matched_depth()
    assert jaccard.expected_recall(0.8, jaccard.TREES, depth) >= jaccard.TARGET_RECALL
    assert jaccard.expected_recall(0.8, jaccard.TREES, depth + 1) < jaccard.TARGET_RECALL or depth == jaccard.DEPTH


def test_measured_recall_at_threshold():
    """Pairs with a Jaccard of just over 0.8 share a prefix in one tree at least."""
    rng = np.random.default_rng(9)
    depth, found = jaccard.matched_depth(), 0
    for _ in range(600):
        common, a, b = (rng.integers(0, 1 << 63, n, dtype=np.uint64) for n in (400, 49, 49))
        one, two = (jaccard.signature(np.unique(np.concatenate([common, x]))).reshape(jaccard.TREES, jaccard.DEPTH) for x in (a, b))
        found += bool((one[:, :depth] == two[:, :depth]).all(axis=1).any())
    assert found >= 0.99 * 600


def test_large_subtrees(make, monkeypatch):
    """Subtrees that are walked in slices give the same links, whatever their size is against that of a slice."""
    rng = random.Random(6)
    docs = near_copies()
    base = prose(78, 90).split()
    for i in range(120):
        words = list(base)
        for _ in range(rng.randrange(5)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(999)}"
        docs.append((1000 + i, " ".join(words)))
    want = brute(docs)
    for n in (3, 40):
        monkeypatch.setattr(jaccard, "SUBTREE_NODES", n)
        assert joined(make(docs)) == want


def test_one_row_many_times(spark, make):
    """A row repeated 100,000 times is merged before it is verified."""
    text = prose(5, 60)
    near = text.rsplit(" ", 1)[0] + " other"
    df = spark.range(100_000).selectExpr("7L AS doc_id", f"'{text}' AS text").unionByName(make([(8, near), (9, prose(6, 60))]).select("doc_id", "text"))
    got = jaccard.join_ngrams(df)
    assert sorted((r.doc_id, r.class_id, r.n_links, r.n_copies, r["count"]) for r in got.groupBy("doc_id", "class_id", "n_links", "n_copies").count().collect()) == [(7, 7, 100_000, 100_000, 100_000), (8, 7, 100_000, 1, 1), (9, 9, 0, 1, 1)]
    assert sorted(r.doc_id for r in jaccard.keep_firsts(df, got).collect()) == [7, 9]


def test_rows_merged_in_a_task():
    import pyarrow as pa

    keys = [1, 1, 2, None, None, 2]
    batch = pa.RecordBatch.from_pydict({"text": list("aabccb"), "rep_id": [k or 0 for k in keys], "no_id": [k is None for k in keys], "rep_hash": [5, 5, 6, 7, 8, 6]})
    assert [b.column("text").to_pylist() for b in jaccard._once([batch, batch])] == [["a", "b", "c", "c"], []]


def test_clashing_names(make):
    """A column named like one used inside keeps its values."""
    from pyspark.sql import functions as F

    df = make(near_copies()).withColumns({"id": F.lit("mine"), "_id": F.lit("too"), "hash": F.lit(1), "none": F.lit(2)})
    kept = jaccard.keep_firsts(df, jaccard.join_ngrams(df))
    assert kept.schema == df.schema and {(r.id, r._id, r.hash, r.none) for r in kept.collect()} == {("mine", "too", 1, 2)}
