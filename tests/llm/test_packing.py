import array
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyforge.llm import packing


def check(rows, capacity=2048):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_ids_agree():
    """Against the contract's plain call, whichever library an encoder takes."""
    from tokenizers import Tokenizer

    encoder, plain = packing.Encoder(packing.default_tokenizer()), Tokenizer.from_file(packing.default_tokenizer())
    rng = random.Random(4)
    alphabet = ["a", "the ", "ing", " ", "  ", "\n", "\t", "é", "ß", "'s", "'LL", "12", "3", "!?", "###", "\x00", "\xa0", "\x85", "<|endoftext|>", "Ñ", "_", "http://"]
    for _ in range(1500):
        text = "".join(rng.choices(alphabet, k=rng.randrange(60)))
        assert encoder.ids(text) == plain.encode(text, add_special_tokens=False).ids, text
    for text in ("x" * 1999, "x" * 2001, "x" * 3000, " " * 499, " " * 501, " " * 3000, "a" + " " * 499 + "b", "a " * 800 + " " * 480, "日本語 текст 😀", "\xad\u0301", "a\u0000b"):
        assert encoder.ids(text) == plain.encode(text, add_special_tokens=False).ids
    for code in range(256):
        for text in (chr(code), f"a{chr(code)}b", f" {chr(code) * 3} ", f"{chr(code)}'s 1"):
            assert encoder.ids(text) == plain.encode(text, add_special_tokens=False).ids, code


def test_pieces():
    assert [(p, s, len(i)) for p, s, i in packing.pieces_of(list(range(5000)), 2048)] == [(0, 0, 904), (1, 904, 2048), (2, 2952, 2048)]
    assert [(p, s, len(i)) for p, s, i in packing.pieces_of(list(range(4096)), 2048)] == [(0, 0, 2048), (1, 2048, 2048)]
    assert [(p, s, len(i)) for p, s, i in packing.pieces_of([0], 2048)] == [(0, 0, 1)]


def test_odd_rows(odd):
    from llm_cases import ODD_TEXTS

    rows = packing.pack_documents(odd).collect()
    check(rows)
    encoder = packing.Encoder(packing.default_tokenizer())
    want = Counter()
    for doc, text in ODD_TEXTS:
        ids = [*encoder.slow.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start, part in packing.pieces_of(ids, 2048):
            want[doc, piece, start, len(part), zlib.crc32(array.array("I", part).tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want


def test_empty(nothing):
    assert packing.pack_documents(nothing).collect() == []


def test_ids_column(make):
    [row] = packing.tokenize(make([(1, "hello world")]), with_ids=True).collect()
    assert row.length == len(row.ids) and row.ids[-1] == 0


@pytest.mark.parametrize("seed", range(4))
def test_plan(seed):
    rng = np.random.default_rng(seed)
    histogram = np.zeros(201, np.int64)
    for n in rng.integers(1, 201, 3000) if seed % 2 else np.minimum(200, rng.geometric(0.02, 3000)):
        histogram[n] += 1
    plan = packing.plan_packing(histogram, 200)
    used = np.zeros_like(histogram)
    for lengths, n in plan:
        assert sum(lengths) <= 200 and n > 0
        for x in lengths:
            used[x] += n
    assert (used == histogram).all()
    total = int((np.arange(201) * histogram).sum())
    assert sum(n for _, n in plan) <= sum(1 for _ in _best_fit_decreasing(histogram, 200)) + 2
    assert sum(n for _, n in plan) <= max(-(-total // 200), int(histogram[101:].sum())) * 1.01 + 1


def _best_fit_decreasing(histogram, capacity):
    gaps = []
    for length in range(capacity, 0, -1):
        for _ in range(int(histogram[length])):
            fit = [g for g in gaps if g >= length]
            if fit:
                g = min(fit)
                gaps.remove(g)
            else:
                g = capacity
                yield 1
            gaps.append(g - length)


def test_added_tokens():
    """The literal of an added token is the id that the tokenizers library gives by default."""
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    plain, encoder = Tokenizer.from_file(path), packing.Encoder(path)
    assert encoder.added
    for literal in encoder.added:
        for text in (f"a {literal} b", literal, f"\u4e00{literal}{literal}", literal[:-1]):
            assert encoder.ids(text) == plain.encode(text, add_special_tokens=False).ids
        assert plain.token_to_id(literal) in encoder.ids(f"a {literal} b")


@pytest.mark.parametrize("seed", range(5))
def test_index_of_sums(seed):
    """What the index finds is there, and it finds something whenever there is something, while counts fall."""
    rng = random.Random(seed)
    capacity = 24
    counts = [0] + [rng.choice([0, 0, 1, 2, 3]) for _ in range(capacity)]
    index = packing.SumIndex(counts)

    def exists(top, gap, parts):
        left = list(counts)
        left[top] -= 1

        def fill(gap, most, parts):
            if gap == 0:
                return True
            for x in range(min(gap, most), 0, -1) if parts else ():
                if left[x] > 0:
                    left[x] -= 1
                    found = fill(gap - x, x, parts - 1)
                    left[x] += 1
                    if found:
                        return True
            return False

        return fill(gap, capacity, parts)

    while any(counts):
        top = rng.choice([x for x in range(1, capacity + 1) if counts[x]])
        rest = index.complement(top, capacity - top)
        assert (rest is not None) == exists(top, capacity - top, 3)
        taken = (top, *(rest or ()))
        assert rest is None or sum(taken) == capacity
        for x in taken:
            counts[x] -= 1
            assert counts[x] >= 0


def test_given_lengths(spark):
    """The plans for the given tables are at the lower bound."""
    for folder, least in (("sf0.001", None), ("sf0.01", 481)):
        lengths = packing.tokenize(spark.read.parquet(f"/root/testdata/{folder}/documents.parquet")).select("length").toPandas()["length"]
        histogram = np.bincount(lengths, minlength=2049)
        n = sum(times for _, times in packing.plan_packing(histogram, 2048))
        assert n == -(-int(lengths.sum()) // 2048)
        assert least in (None, n)


def test_buckets(make, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_PIECES", 5)
    rows = packing.pack_documents(make([(i % 7, "same words here" if i % 3 else f"w{i}") for i in range(400)])).collect()
    assert len(rows) == 400 and len({(r.sequence_id, r.offset) for r in rows}) == 400
    check(rows)
