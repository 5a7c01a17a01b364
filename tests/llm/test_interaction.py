from collections import Counter
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from tallyforge.llm import interaction

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def brute(rows, names):
    """Runs every order: rows of (part, set of failed filters, good, toxic)."""
    found, shapley = {}, Counter()
    for part in {r[0] for r in rows}:
        for order in permutations(names):
            left = [r for r in rows if r[0] == part]
            for step, name in enumerate(order, 1):
                out, left = [r for r in left if name in r[1]], [r for r in left if name not in r[1]]
                fails = [r for r in rows if r[0] == part and name in r[1]]
                shapley[part, name] += len(out)
                found[part, "".join(order), step] = [len(left), len(out), len(fails) - len(out), sum(r[1] == {name} for r in fails), sum(r[2] for r in out), sum(r[3] for r in out)]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in found.items()}


def result(df):
    rows = df.collect()
    found = {(r.part, r.filter_order, r.step): tuple(r[c] for c in COUNTS) for r in rows}
    assert len(found) == len(rows)
    return found


def judged(docs, labels):
    """The five conditions as plain Python."""
    rows, known = [], {}
    for d, q, t in labels:
        good, toxic = known.get(d, (False, False))
        known[d] = (good or q == 1, toxic or t == 1)
    for d, text, source in docs:
        t = text or ""
        w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", t) if x]
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), "D": any(c in "#$%&*|" for c in t),
            "E": d is not None and any(e is not None and e < d and (u or "") == t for e, u, _ in docs),
        }
        good, toxic = known.get(d, (False, False)) if d is not None else (False, False)
        rows.append((source or "", {k for k, v in fails.items() if v}, good, toxic))
    return rows


def test_against_running_every_order(spark):
    words = " ".join(f"w{i}" for i in range(230))
    docs = [(i, [words, words.upper(), words + " #", "a b", "a " * 300, "", None, f"{words} {i % 3}"][i % 8], ["x", "y", None, ""][i % 4 if i % 3 else 1]) for i in range(60)]
    docs += [(None, words, "x"), (None, words, "x"), (5, words, "y"), (-3, "a b", "z"), (5, "AB" * 400_000, "y"), (7, " \U0001f600" * 9, "x"), (7, "dup", "x"), (7, "dup", "x")]
    docs += [(100 + i, "hot " * 250, "x") for i in range(50)]
    labels = [(i, i % 2, int(i % 5 == 0)) for i in range(0, 60, 2)] + [(4, None, 1), (5, 1, 0), (5, 0, 1), (None, 1, 1), (900, 1, 1)]
    table = spark.createDataFrame([(*d, 1, "p", 2) for d in docs], "doc_id long, text string, source string, n long, part string, mask int")
    known = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert result(interaction.audit_documents(table.repartition(3), known)) == brute(judged(docs, labels), "ABCDE")
    nothing = interaction.audit_documents(table, known.limit(0))
    assert {r.good_lost + r.toxic_lost for r in nothing.collect()} == {0}
    assert interaction.audit_documents(table.limit(0), known).collect() == []


def test_own_filters_and_orders(spark):
    rows = spark.range(1000).withColumn("kept", F.lit("clash")).withColumn("before", F.lit("clash"))
    filters = {"2": F.col("id") % 2 == 0, "3": F.col("id") % 3 == 0, "?": F.lit(None).cast("boolean")}
    found = interaction.audit_filters(rows, F.lit(None).cast("string"), filters, orders=["32?", "23?"]).collect()
    got = {(r.filter_order, r.step): (r.part, r.kept, r.removed, r.redundant, r.unique_fails, r.shapley) for r in found}
    assert got["32?", 1] == (None, 666, 334, 0, 167, 3 * 334 + 3 * 167)
    assert got["32?", 2] == (None, 333, 333, 167, 333, 3 * 500 + 3 * 333)
    assert got["23?", 3] == (None, 333, 0, 0, 0, 0)
    assert len(got) == 6


def test_zeta(spark):
    values = [(i * 7919) % 101 for i in range(64)]
    sums = spark.range(1).select(interaction.zeta(F.array(*map(F.lit, values)), 6).alias("z")).first().z
    assert sums == [sum(values[s] for s in range(64) if s & m == s) for m in range(64)]


def test_refused(spark):
    with pytest.raises(ValueError, match="one character"):
        interaction.audit_filters(spark.range(1), F.lit("p"), {"ab": F.lit(True)})
    with pytest.raises(ValueError, match="once"):
        interaction.audit_filters(spark.range(1), F.lit("p"), {"a": F.lit(True), "b": F.lit(True)}, orders=["aa"])
    with pytest.raises(ValueError, match="orders"):
        interaction.audit_filters(spark.range(1), F.lit("p"), {x: F.lit(True) for x in "abcdefg"})
