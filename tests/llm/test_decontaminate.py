import random

import pytest

from llm_cases import ODD_TEXTS, prose

from tallyforge.llm import decontaminate as dc


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


def brute(item, text):
    """Least distance of the item to any run of words, and whether it is allowed."""
    a, b = dc.word_ids(item).tolist(), dc.word_ids(text).tolist()
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return min(row), min(row) <= dc.edits_allowed(len(a))


def benchmark(spark, items):
    return spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, doc_id string")


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        p = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[p] = f"new{rng.randrange(99)}"
        elif kind < 0.7 and len(out) > 1:
            del out[p]
        else:
            out.insert(p, f"more{rng.randrange(99)}")
    return out


def test_recall_under_edits(spark, make):
    rng = random.Random(7)
    items = [(i, prose(1000 + i, rng.randrange(12, 60))) for i in range(60)]
    docs = []
    for i in range(400):
        words = items[i % 60][1].split()
        docs.append((i, " ".join([prose(i, 30), *edited(rng, words, rng.randint(0, dc.edits_allowed(len(words)))), prose(i + 5000, 30)])))
    docs += [(i, prose(i + 9000, 200)) for i in range(400, 600)]
    hits = {(r.doc_id, r.item_id): r for r in dc.find_leaks(make(docs), benchmark(spark, items)).collect()}
    want = {(i, j): brute(t, x)[0] for i, x in docs for j, t in items if (j == i % 60 or i % 20 == 0) and brute(t, x)[1]}
    found = [k for k in want if k in hits]
    assert len(found) >= 0.99 * len(want)
    assert all(doc < 400 for doc, _ in hits)
    exact = [hits[k].distance == want[k] for k in found]
    assert sum(exact) >= 0.98 * len(exact)
    for (doc, item), r in hits.items():
        run = dc.word_ids(docs[doc][1])[r.start_word : r.end_word].tolist()
        assert distance(dc.word_ids(items[item][1]).tolist(), run) == r.distance <= dc.edits_allowed(len(items[item][1].split()))


def test_nearest_run():
    rng = random.Random(3)
    for _ in range(400):
        item, words = [rng.randrange(4) for _ in range(rng.randrange(1, 7))], [rng.randrange(4) for _ in range(rng.randrange(12))]
        best = min((distance(item, words[a:b]), a, b) for a in range(len(words) + 1) for b in range(a, len(words) + 1))
        found = dc.nearest_run(item, words, 9)
        assert found[0] == best[0] and distance(item, words[found[1] : found[2]]) == best[0]


def test_odd_rows(spark, odd, nothing):
    items = [(1, prose(1, 60)), (1, prose(1, 60)), (None, "one two"), (2, None), (3, ""), (4, "line"), (5, "Quick!"), (6, prose(9, 30_000)[5000:5400])]
    hits = dc.find_leaks(odd, benchmark(spark, items)).collect()
    assert {r.item_id for r in hits if r.doc_id in (7, 8)} == {None}
    assert sorted(r.doc_id for r in hits if r.item_id == 1 and r.doc_id) == [1, 1, 3, 3, 3, 3]
    assert any(r.doc_id is None for r in hits)
    assert {r.item_id for r in hits if r.doc_id == 12} == {4}
    assert {r.item_id for r in hits if r.doc_id == 9} == {6}
    kept = dc.drop_leaks(odd, benchmark(spark, items))
    assert kept.schema == odd.schema
    assert sorted((str(r.doc_id), len(r.text or "")) for r in kept.collect()) == sorted((str(d), len(t or "")) for d, t in ODD_TEXTS if d not in (1, 3, 7, 8, 9, 12) and not (d is None and t))
    assert dc.find_leaks(odd, benchmark(spark, [])).collect() == []
    assert dc.find_leaks(nothing, benchmark(spark, items)).collect() == []
    assert dc.drop_leaks(odd, benchmark(spark, [(1, None)])).count() == len(ODD_TEXTS)


def test_many_parts(spark, make, monkeypatch):
    monkeypatch.setattr(dc, "ITEMS_AT_ONCE", 3)
    items = [(i, prose(i, 20)) for i in range(10)]
    docs = make([(i, prose(50, 10) + " " + prose(i, 20)) for i in range(12)])
    assert sorted((r.doc_id, r.item_id) for r in dc.find_leaks(docs, benchmark(spark, items)).collect()) == [(i, i) for i in range(10)]
    assert sorted(r.doc_id for r in dc.drop_leaks(docs, benchmark(spark, items)).collect()) == [10, 11]


def test_occurs():
    rng = random.Random(5)
    for _ in range(600):
        item, words = [rng.randrange(4) for _ in range(rng.randrange(1, 80))], [rng.randrange(4) for _ in range(rng.randrange(90))]
        least = dc.nearest_run(item, words, 99)[0]
        most = max(0, least + rng.randrange(-2, 2))
        assert dc.occurs(item, words, most) == (least <= most)


def test_parts():
    for n in range(2, 500):
        bounds, edits = dc.parts_of(n)
        sizes = [b - a for a, b in zip(bounds, bounds[1:], strict=False)]
        assert bounds[0] == 0 and bounds[-1] == n and max(sizes) <= dc.PART_WORDS and max(sizes) - min(sizes) <= 1
        assert (edits + 1) * len(sizes) > dc.edits_allowed(n)  # more edits than that in every part are more than the item allows
    assert len({(b - a, dc.parts_of(n)[1]) for n in range(2, 5000) for a, b in zip(dc.parts_of(n)[0], dc.parts_of(n)[0][1:], strict=False)}) < 64


@pytest.mark.parametrize("kind", ["substitution", "insertion", "deletion"])
@pytest.mark.parametrize("size", [5, 10, 15, 16, 19, 20, 30, 59, 100, 400])
def test_recall_at_full_edits(size, kind):
    """Items with exactly as many edits as allowed, all of one kind, in texts of their own."""
    rng = random.Random(size)
    items = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(size))) for i in range(max(40, min(120, 4000 // size)))]
    index = dc.index_of(items)
    docs = []
    for _, text in items:
        words = text.split()
        for _ in range(dc.edits_allowed(size)):
            p = rng.randrange(len(words))
            if kind == "substitution":
                words[p] = f"x{rng.randrange(10**6)}"
            elif kind == "deletion":
                del words[p]
            else:
                words.insert(p, f"x{rng.randrange(10**6)}")
        docs.append(((" ".join([*(f"a{rng.randrange(10**6)}" for _ in range(25)), *words, *(f"b{rng.randrange(10**6)}" for _ in range(25))])),))
    found = sum(i in hits for i, (_, hits) in enumerate(dc.search_stream(iter(docs), index)))
    assert found >= 0.97 * len(items), found / len(items)
