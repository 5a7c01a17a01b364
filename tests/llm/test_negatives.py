import math
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import negatives

SCHEMA = "vec_id long, label int, embedding array<float>, anchor string, rank int, score long, slot string, vector string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, 2, "x", "y") for r in rows], SCHEMA)


def brute(rows, every=10, low=80, n=5):
    """The contract's words as loops."""
    usable = {}
    for i, label, v in rows:
        if None not in (i, label, v) and all(x is not None and math.isfinite(x) for x in v):
            usable[i, label, tuple(math.floor(256 * float(np.float32(x))) for x in v)] = None
    found = []
    for anchor in usable:
        if anchor[0] % every:
            continue
        scores = sorted((-sum(x * y for x, y in zip(anchor[2], r[2], strict=False)), r[0], r[1]) for r in usable if r != anchor)
        for minus, positive, _ in [s for s in scores if s[2] == anchor[1]][:n]:
            window = [s for s in scores if s[2] != anchor[1] and low * -minus <= 100 * -s[0] <= 100 * -minus][:n]
            found += [(anchor[0], positive, rank, s[1], -minus, -s[0]) for rank, s in enumerate(window, 1)]
    return sorted(found)


def mined(df, every=10, **options):
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r[n] for n in names) for r in negatives.mine_negatives(df, F.col("vec_id") % every == 0, **options).collect())


def vectors(n, dims, seed, labels=3):
    rng = random.Random(seed)
    return [(i, rng.randrange(labels), [rng.gauss(0.1, 0.4) for _ in range(dims)]) for i in range(-n // 3, n - n // 3)]


def test_against_brute_force(spark):
    rows = vectors(400, 9, 1)
    want = brute(rows)
    assert len(want) > 300
    assert mined(frame(spark, rows)) == want
    assert mined(frame(spark, rows).repartition(7), block_bytes=9 * 8 * 6, sample=20, piece=4) == want  # several blocks, a poor codebook


def test_ties_repeats_and_odd_rows(spark):
    rows = vectors(120, 6, 2)
    rows += [(1000 + i, i % 2, [0.5] * 6) for i in range(90)]  # one vector holds a large share
    rows += [(1000, 0, [0.5] * 6)] * 20 + [(1010, 1, [0.25] * 6), (1020, 2, [])]  # repeated rows, ids twice, a shorter vector
    rows += [(None, 1, [0.5] * 6), (2000, None, [0.5] * 6), (2010, 1, None), (2020, 1, [float("nan")] * 6), (2030, 1, [float("inf")] + [0.0] * 5), (2040, 1, [None] * 6), (2050, 1, [0.0] * 6), (2060, 7, [0.1] * 6)]
    assert mined(frame(spark, rows)) == brute(rows)


def test_small_tables(spark):
    assert mined(frame(spark, [])) == []
    assert mined(frame(spark, vectors(9, 3, 3)), every=1000003) == brute(vectors(9, 3, 3), every=1000003)
    assert mined(frame(spark, [(10, 1, [1.0])])) == []
    assert mined(frame(spark, [(10, 1, [])] * 3 + [(11, 1, []), (12, 2, [])])) == [(10, 11, 1, 12, 0, 0)]


def test_scores_beyond_a_long_are_an_error(spark):
    with pytest.raises(Exception, match="fit in a long"):
        mined(frame(spark, [(10, 1, [1e30, 1.0]), (11, 1, [1.0, 1.0])]))
    large = [(10, 1, [1e6, 1.0]), (11, 1, [1e6, 2.0]), (12, 2, [9e5, 1.0])]
    assert mined(frame(spark, large)) == brute(large) != []


@pytest.mark.parametrize("scale", [1, 10**3, 10**7])
def test_bounds_hold(scale):
    rng = np.random.default_rng(scale)
    rows, anchors = (rng.integers(-scale, scale + 1, (n, 33)) for n in (500, 40))
    book = negatives.train_codebook(rows[:100].astype(float))
    score, reach = negatives.bounds(book, anchors, *book.encode(rows.astype(float)))
    true = rows @ anchors.T
    assert (np.abs(score - true) <= reach).all()
    assert np.median(reach) < 0.5 * np.abs(true).max()


def test_few_pairs_are_scored():
    """On vectors like the table's the bounds leave a small share of all pairs."""
    rng = np.random.default_rng(5)
    rows = np.floor(256 * (x := rng.normal(size=(20_000, 64))) / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    labels, ids, n = rng.integers(0, 10, len(rows)), np.arange(len(rows)), 100
    book = negatives.train_codebook(rows[: negatives.SAMPLE].astype(float))
    whole = np.int64(negatives.MOST)
    search = negatives.Search(negatives.Anchors(ids[:n], labels[:n], rows[:n], np.full((n, 1), -whole), np.full((n, 1), whole), True), book, 5)
    scored, plain = [], negatives.exact_scores
    negatives.exact_scores = lambda a, r, i, j: scored.append(len(i)) or plain(a, r, i, j)
    try:
        codes, residuals = book.encode(rows.astype(float))
        for at in range(0, len(rows), negatives.ROWS):
            part = slice(at, at + negatives.ROWS)
            search.add(ids[part], labels[part], rows[part], codes[part], residuals[part])
    finally:
        negatives.exact_scores = plain
    assert sum(scored) < 0.02 * n * len(rows)
    found = defaultdict(list)
    for slot, i, score in zip(search.slot, search.ids, search.scores, strict=True):
        found[slot].append((-score, i))
    for a in range(n):
        scores = rows @ rows[a]
        assert sorted(found[a]) == sorted((-scores[i], i) for i in ids[labels == labels[a]] if i != a)[:5]
