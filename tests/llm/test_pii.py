import hashlib
import random
import re

import pytest
from llm_cases import ODD_TEXTS

from tallyforge.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
FIT = ["mail a.b@mail7.example.com or call +1 (974) 555-3436", "ip 97.51.17.173 card 4111111111111111", "n 9807915762804490 and 4845168114407320", "12.4.300.1 and 1234567", "b@c.example.org +44 20 7946 0958"] * 20


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    spans = [(*m.span(), "email") for m in EMAIL.finditer(text)]
    spans += [(*m.span(), "ip") for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    spans += [(*m.span(), "card") for m in CARD.finditer(text) if 12 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    spans += [(*m.span(), "phone") for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], pii.KINDS.index(s[2])))


@pytest.fixture(scope="module")
def field():
    return pii.fit(FIT)


def test_base_spans():
    rng = random.Random(8)
    for alphabet in ("0123456789..@-+ ()ab%é", "01..", "a@.-", "4111 1111-", "+1 (23)-"):
        for _ in range(4000):
            text = "".join(rng.choices(alphabet, k=rng.randrange(50)))
            assert pii.base_spans(text) == brute(text), text


def test_long_runs():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 60_000, "@" * 100_000, "+1" * 60_000, "a@b" * 50_000):
        pii.base_spans(text)


def test_consistency_across_a_document(field):
    text = "call +1 (974) 555-3436 today, " + "or so we say, " * 20 + "1 (974) 555-3436"
    base, spans = pii.find_spans(text, field)
    assert [k for *_, k in base] == ["phone"]
    assert [text[a:b] for a, b, k in spans if k == "phone"] == ["+1 (974) 555-3436", "1 (974) 555-3436"]
    assert pii.masked(text, spans).count("<PHONE>") == 2
    assert pii.find_spans("call 1 (974) 555-3436", field)[1] == []


def test_clean_texts_are_left_alone(field):
    for text in ("numbers 9807915762804490 and 9807915762804491", "at 12.4.300.1 or 1.2.3", "version 3.0, 1234567 items", "name@host", "no digits at all"):
        assert pii.find_spans(text, field)[1] == brute(text)


def test_beliefs_are_exact_on_trees(field):
    """Without loops message passing gives the true marginals."""
    import itertools

    import numpy as np

    rng = np.random.default_rng(2)
    local, observed = rng.normal(size=(4, 5)), np.array([-1, 2, -1, -1])
    chain, hubs = [(0, 1), (1, 2)], [[2, 3]]
    got = pii.beliefs(local, observed, chain, hubs, [], field)
    total = np.zeros((4, 5))
    for y in itertools.product(range(5), repeat=5):
        if y[1] != 2:
            continue
        score = sum(local[i, y[i]] for i in (0, 2, 3)) + field.chain[y[0], y[1]] + field.chain[y[1], y[2]] + field.same * ((y[2] == y[4]) + (y[3] == y[4]))
        for i in range(4):
            total[i, y[i]] += np.exp(score)
    assert np.allclose(got, total / total.sum(axis=1, keepdims=True), atol=1e-6)


def test_masks():
    assert pii.masked("ab cd ef", [(0, 2, "ip"), (1, 5, "card"), (6, 8, "phone")]) == "<IP> <PHONE>"
    assert pii.masked("ab", []) == "ab"


def test_odd_rows(spark, odd, nothing, field):
    got = pii.find_personal_data(odd, field).collect()
    assert len(got) == len(ODD_TEXTS)
    for r in got:
        if r.doc_id == -5:
            assert (r.n_email, r.n_phone, r.spans) == (1, 1, "phone:0:17,email:18:33")
            assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
        elif r.doc_id in (4, 5, None):
            assert r.base_sha256 == hashlib.sha256(b"").hexdigest() and r.spans == ""
    masked = pii.mask_personal_data(odd, field)
    assert masked.schema == odd.schema
    rows = {r.doc_id: r for r in masked.collect() if r.doc_id in (-5, 4, 9)}
    assert (rows[-5].text, rows[-5].n_chars) == ("<PHONE> <EMAIL>", 15)
    assert (rows[4].text, rows[4].n_chars) == (None, 1)
    assert rows[9].n_chars == len(rows[9].text)
    assert pii.find_personal_data(nothing, field).collect() == [] == pii.mask_personal_data(nothing, field).collect()
    assert pii.find_spans("x 1234567890", pii.train(nothing))[1] == []
    assert pii.mask_personal_data(spark.createDataFrame([("a@b.example",)], "text string"), field).collect()[0].text == "<EMAIL>"


def test_address_of_many_zeros():
    """A part with more digits than Python turns into a number is read by what follows its zeros."""
    zeros = "0" * 5000
    for part, n in (("", 1), ("255", 1), ("256", 0)):
        assert [k for _, _, k in pii.base_spans(f"at 1.2.3.{zeros}{part} now")].count("ip") == n


def test_contents_one_edit_apart(field):
    """A number with a digit wrong, one more or one less, or in national form shares the label; so do addresses."""
    for other in ("1 (974) 555-3437", "1 (974) 555-343", "1 (974) 555-34367", "(974) 555-3436"):
        text = f"call +1 (974) 555-3436 today, {'or so we say, ' * 9}{other} too"
        assert other.strip("(") in [text[a:b].strip("(") for a, b, k in pii.find_spans(text, field)[1] if k == "phone"], other
    text = "at +41 44 668 18 00 or 044 668 18 00"
    assert [text[a:b] for a, b, _ in pii.find_spans(text, field)[1]] == ["+41 44 668 18 00", "044 668 18 00"]
    text = "a.b@mail.example.com, a.c@mail and xyz@host"
    assert [text[a:b] for a, b, _ in pii.find_spans(text, field)[1]] == ["a.b@mail.example.com", "a.c@mail"]
    assert pii.find_spans("call +1 (974) 555-3436 or 1 (974) 777-9999", field)[1] == pii.base_spans("call +1 (974) 555-3436")
    flat = pii.Field(field.weights, field.chain, 0.0, 0.0)
    assert len(pii.find_spans("at +41 44 668 18 00 or 044 668 18 00", flat)[1]) == 1


def test_numbers_in_a_row(field):
    text = "+1 974 555 3436 then 555 123 4567 974 555 3436 and 974 555 3436 555 987 6543"
    spans = [text[a:b] for a, b, _ in pii.find_spans(text, field)[1]]
    assert spans == ["+1 974 555 3436", "974 555 3436", "974 555 3436"]
    pii.find_spans("12 " * 100_000 + "+1 974 555 3436", field)


def test_links():
    keys = ["1234567890", "1234567891", "1234567890", "5555555555", "234567890", "a@b"]
    hubs, bridges = pii.links_of(keys)
    assert hubs == [[0, 2]]
    ends = {frozenset(keys[i] if i < 6 else keys[hubs[i - 6][0]] for i in b) for b in bridges}
    assert frozenset(["1234567890", "1234567891"]) in ends and frozenset(["1234567890", "234567890"]) in ends
    assert not any("5555555555" in e or "a@b" in e for e in ends)
    rng = random.Random(3)
    for _ in range(300):
        one, two = ("".join(rng.choices("012", k=rng.randrange(7, 10))) for _ in range(2))
        near = one[:-1] == two or two[:-1] == one or any(one[:i] + one[i + 1 :] in (two, two[:i] + two[i + 1 :]) or two[:i] + two[i + 1 :] == one for i in range(10))
        linked = one != two and bool(pii.links_of([one, two])[1])
        assert linked >= (one != two and near and abs(len(one) - len(two)) <= 1)


def test_fitted_potentials(field):
    assert field.same > 0 and field.near > 0
    none = pii.fit(["no number", "1234567 items"])
    assert (none.same, none.near) == (0.0, 0.0)
    # nodes one edit from a phone number that are none speak against the link
    odd = [f"+1 (974) 555-3436 and item 974555343{d} or 974555{d}436" for d in range(10)] * 20
    assert pii.fit(odd).near < pii.fit(["+1 (974) 555-3436"] * 200).near


def test_loops_settle(field):
    text = "".join(f"+1 974 555 {i % 90:04d} or 1 974 555 {(i + 1) % 90:04d}, " for i in range(400))
    assert len(pii.find_spans(text, field)[1]) >= 400
