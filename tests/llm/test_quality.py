import itertools
import random
from collections import Counter

import numpy as np

from tallyforge.llm import quality

from llm_cases import ODD_TEXTS, prose


def brute(text):
    words = quality.WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w, n in Counter(windows).items() if n > 1}
    covered = {j for i, w in enumerate(windows) if w in twice for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if quality.WORD.search(x)]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_base_counts():
    rng = random.Random(3)
    texts = [t or "" for _, t in ODD_TEXTS] + ["".join(rng.choices(["a ", "b ", "c\n", "d#", "\x1c", "\u2003", "\x85", "|", " \n"], k=rng.randrange(80))) for _ in range(800)]
    for t in texts:
        n, *rest, failed, _, kept = quality.judge(t, quality.PRIOR)
        assert (n, *rest) == brute(t), repr(t[:80])
        assert failed == (n < 10 or 100 * rest[-1] > 20 * n)
        assert not (failed and kept)


def test_viterbi():
    rng = random.Random(1)
    for _ in range(300):
        scores = [rng.uniform(-2, 2) for _ in range(rng.randrange(1, 8))]
        steps = tuple(tuple(rng.uniform(-1, 1) for _ in range(2)) for _ in range(2))
        value = lambda y: sum(s for s, l in zip(scores, y, strict=True) if l) + sum(steps[a][b] for a, b in itertools.pairwise(y))  # noqa: E741, B023
        best = max(value(y) for y in itertools.product((0, 1), repeat=len(scores)))
        assert abs(value(quality.viterbi(scores, steps)) - best) < 1e-9


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    judged = quality.judge_quality(docs, quality.train(docs, labels)).join(labels, "doc_id")
    counts = {(r.quality, r.kept): r["count"] for r in judged.filter("NOT base_failed").groupBy("quality", "kept").count().collect()}
    assert counts.get((1, True), 0) >= 0.99 * sum(n for (q, _), n in counts.items() if q == 1)
    assert counts.get((0, False), 0) >= 0.95 * sum(n for (q, _), n in counts.items() if q == 0)


def test_odd_rows(odd, nothing, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(odd, labels)
    assert model == quality.PRIOR
    assert quality.judge_quality(odd, model).count() == len(ODD_TEXTS)
    kept = quality.keep_quality(odd, model)
    assert kept.schema == odd.schema
    want = [(d, t) for d, t in ODD_TEXTS if quality.judge(t or "", model)[-1]]
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted(want, key=str)
    assert quality.judge_quality(nothing, model).collect() == []
    assert quality.keep_quality(nothing, model).collect() == []


def test_one_class_of_labels(make, spark):
    docs = make([(1, prose(1, 40))])
    assert quality.train(docs, spark.createDataFrame([(1, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int")) == quality.PRIOR


def _labelled():
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.1"
    docs, labels = (pq.read_table(f"{folder}/{name}.parquet") for name in ("documents", "labels"))
    quality_of = dict(zip(labels["doc_id"].to_pylist(), labels["quality"].to_pylist(), strict=True))
    found = {0: [], 1: []}
    for doc, text in zip(docs["doc_id"].to_pylist(), docs["text"].to_pylist(), strict=True):
        if quality_of.get(doc) is not None and text and len(text) <= quality.SAMPLE_CHARS and quality.WORD.search(text):
            found[quality_of[doc]].append(text)
    for y in found:
        random.Random(y).shuffle(found[y])
    return found


def test_lines_of_mixed_documents():
    """The field labels lines, not documents: on documents spliced from held-out lines of both classes most lines are right, and the share of content follows the mixture."""
    found = _labelled()
    n = min(150, len(found[0]) // 2)
    model = quality.model_of([(t, y) for y in (0, 1) for t in found[y][:n]])
    held = [(t, y) for y in (0, 1) for t in found[y][n : 2 * n]]
    texts, whole = [t for t, _ in held], [np.full(len(quality.features_of(t)), y) for t, y in held]
    right = total = 0
    shares = []
    for text, gold in quality.spliced(texts, whole, 300, seed=5):
        rows = list(quality.lines_of(text))
        got = quality.viterbi([sum(a * b for a, b in zip(model.weights, quality.line_features(*r), strict=True)) for r in rows], model.steps)
        right, total = right + int((np.array(got) == gold).sum()), total + len(gold)
        words = np.array([len(r[1]) for r in rows])
        shares.append((quality.judge(text, model)[6], float(words[gold == 1].sum() / words.sum())))
    assert right >= 0.9 * total
    assert np.mean([0 < got < 1 for got, _ in shares]) > 0.9
    assert np.mean([abs(got - want) < 0.2 for got, want in shares]) > 0.85
    real = [quality.judge(t, model)[6] for t in found[0][n:]]
    assert np.mean([0 < s < 1 for s in real]) > 0.2  # bad documents with clean lines among them


def test_fit_follows_its_likelihood():
    """The fitted field is near a maximum: no small step along an axis raises the penalized likelihood, counted by all labellings."""
    rng = np.random.default_rng(2)
    sequences = [(np.c_[np.ones(n), rng.normal(size=(n, 9))], rng.integers(0, 2, n)) for n in (1, 2, 3, 4, 5, 4, 3)]

    def value(theta):
        w, steps, total = theta[:10], theta[10:].reshape(2, 2), 0.0
        for x, y in sequences:
            score = lambda labels: sum(float(r @ w) * b for r, b in zip(x, labels, strict=True)) + sum(steps[a, b] for a, b in itertools.pairwise(labels))  # noqa: E731, B023
            total += (score(y) - np.logaddexp.reduce([score(z) for z in itertools.product((0, 1), repeat=len(y))])) / len(y)
        return total / len(sequences) - 1e-2 * float(theta @ theta) / 2 / 10

    model = quality.fit(sequences, rounds=3000, rate=0.03)
    theta = np.r_[model.weights, np.ravel(model.steps)]
    assert all(value(theta + d * e) <= value(theta) + 1e-5 for e in np.eye(14) for d in (-0.03, 0.03))


def test_no_boilerplate_lines():
    assert quality.spliced([], [], 5) == []
    assert quality.spliced(["a b"], [np.array([1])], 5) == []
    assert quality.model_of([("", 1), (" \n", 0)]) == quality.PRIOR
