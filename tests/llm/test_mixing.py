import random
import re
from collections import defaultdict

import pytest

from tallyforge.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_targets(sizes, weights, most=3):
    """Water-filling by bisection: a level at which all shares together are the total."""
    low, high, total = 0.0, 4.0 * sum(sizes) + 1, sum(sizes)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(most * s, level * w) for s, w in zip(sizes, weights, strict=True)) < total else (low, level)
    return [min(most * s, high * w) for s, w in zip(sizes, weights, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0, "x", 3) for r in rows], "doc_id long, text string, source string, size long, target double, lot string, n long")


def check(rows, texts):
    """Words taken are within 0.1% of the target, or, for a source of a few documents, within half of its largest one."""
    want = sorted(((d, s, len(WORD.findall(t or ""))) for d, t, s in texts), key=str)
    assert sorted(((r.doc_id, r.source, r.size) for r in rows), key=str) == want
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    order = sorted(by, key=lambda s: (s is None, s or ""))
    sizes = [sum(r.size for r in by[s]) for s in order]
    for s, size, target in zip(order, sizes, brute_targets(sizes, [(5, 2, 1)[i % 3] for i in range(len(order))]), strict=True):
        assert {r.source_size for r in by[s]} == {size}
        assert all(abs(r.target - target) <= 1e-6 * max(1, target) for r in by[s])
        whole = int(target / size + 1e-9) if size else 0
        assert all(r.taken in (whole * r.size, (whole + 1) * r.size) and r.taken <= 3 * r.size for r in by[s])
        slack = 0.001 * target + 1 if len(by[s]) > 16 else max(r.size for r in by[s]) / 2
        assert abs(sum(r.taken for r in by[s]) - target) <= slack, s


def corpus(n, seed, sources=("a", "b", "c", "d", None)):
    rng = random.Random(seed)
    return [(i, "w " * int(rng.paretovariate(1.2) * 20), sources[min(int(rng.expovariate(0.8)), len(sources) - 1)]) for i in range(n)]


@pytest.mark.parametrize("group", [40, 10_000])
def test_totals_meet_targets(spark, group):
    texts = corpus(3000, 1)
    check(mixing.mix_sources(frame(spark, texts), group=group).collect(), texts)


def test_given_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = mixing.op12_mix(spark, sf_dir).collect()
    sums = defaultdict(int)
    for r in rows:
        sums[r.source, r.target] += r.taken
    assert len(rows) == docs.count()
    assert abs(sum(t for _, t in sums) - sum(r.size for r in rows)) < 1e-6 * sum(r.size for r in rows)
    check(rows, [(r.doc_id, r.text, r.source) for r in docs.collect()])


def test_odd_rows_and_repeats(spark):
    texts = [(None, "a b", "x"), (1, None, "x"), (2, "", None), (3, " \n", ""), (4, "one\x0btwo three", ""), (5, "w " * 200_000, "long")]
    texts += [(6, "again and again", "x")] * 5000 + [(i, "v " * (i % 30), "é\U0001f600") for i in range(700)]
    check(mixing.mix_sources(frame(spark, texts), group=100).collect(), texts)


def test_empty(spark):
    assert mixing.mix_sources(frame(spark, [])).collect() == []
    assert [(r.target, r.taken) for r in mixing.mix_sources(frame(spark, [(1, "", "a"), (2, None, "a")])).collect()] == [(0.0, 0)] * 2


def test_reruns_agree_however_rows_lie(spark):
    texts = corpus(1500, 2) + [(7, "same same", "b")] * 300
    rows = [sorted(map(str, mixing.mix_sources(frame(spark, t).repartition(n), group=70).collect())) for t, n in ((texts, 2), (texts[::-1], 7))]
    assert rows[0] == rows[1]


def test_targets():
    assert mixing.fill_targets([100, 100, 100], [5, 2, 1]) == [187.5, 75.0, 37.5]
    assert mixing.fill_targets([10, 100, 100], [5, 2, 1]) == pytest.approx([30, 120, 60])
    assert mixing.fill_targets([0, 0], [5, 2]) == [0, 0]
    for seed in range(200):
        rng = random.Random(seed)
        sizes, weights = [rng.randrange(0, 10 ** rng.randrange(1, 6)) for _ in range(9)], [(5, 2, 1)[i % 3] for i in range(9)]
        got = mixing.fill_targets(sizes, weights)
        assert got == pytest.approx(brute_targets(sizes, weights), rel=1e-6, abs=1e-6) and sum(got) == pytest.approx(sum(sizes))


def test_flight_keeps_totals_and_chances():
    rng = random.Random(3)
    for _ in range(200):
        n = rng.randrange(1, 60)
        sizes, psi = [rng.choice([0, 1, 5, rng.randrange(1000)]) for _ in range(n)], [rng.choice([0.0, 1.0, 0.3, rng.random()]) for _ in range(n)]
        flown = mixing.flight(sizes, psi, rng)
        assert sum(0 < p < 1 for p in flown) <= 2 and all(q == p for p, q in zip(psi, flown, strict=True) if p in (0, 1))
        assert sum(flown) == pytest.approx(sum(psi), abs=1e-6)
        assert sum(s * p for s, p in zip(sizes, flown, strict=True)) == pytest.approx(sum(s * p for s, p in zip(sizes, psi, strict=True)), abs=1e-4)
    sizes, psi, runs = [9, 5, 4, 3, 2, 2, 1], [0.3] * 7, 20_000
    means = [sum(x) / runs for x in zip(*(mixing.flight(sizes, psi, rng) for _ in range(runs)), strict=True)]
    assert means == pytest.approx(psi, abs=0.02)


def test_landing_is_the_best_choice():
    rng = random.Random(4)
    for _ in range(50):
        n = rng.randrange(1, 9)
        sizes, psi = [rng.randrange(50) for _ in range(n)], [rng.random() for _ in range(n)]
        got, goal, number = mixing.land(sizes, psi), sum(s * p for s, p in zip(sizes, psi, strict=True)), sum(psi)
        off = lambda x: abs(sum(s for i, s in enumerate(sizes) if x >> i & 1) - goal)
        best = min(off(x) for x in range(2**n) if abs(x.bit_count() - number) < 1)
        assert abs(sum(s * p for s, p in zip(sizes, got, strict=True)) - goal) == pytest.approx(best)
