"""Documents with odd rows, shared by the tests."""

import random

#: Columns beside the ones that operators read, named like what they return or use inside.
EXTRA = "lang string, source string, n_chars long, shard string, slot string, size string, class_id string, length string, kept string, doc string, n string, copies string, first string, path string, host string"
PROSE = "the quick brown fox jumps over a lazy dog while seven grey herons watch from an old wooden bridge near town".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randrange(40)) for _ in range(n))


ODD_TEXTS = [
    (1, prose(1, 60)), (2, prose(2, 60)), (2, prose(3, 60)), (3, prose(1, 60)), (3, prose(1, 60)), (None, prose(1, 60)), (None, None), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "one two"),
    (9, prose(9, 30_000)), (10, "ß\u00a0é \U0001f600 \u2003x\x00y"), (11, "a" * 120_000), (12, "line\n" * 4000), (-5, "+1 (974) 555-3436 x@y.example.com"),
]


def frame(spark, rows):
    names = [c.split()[0] for c in EXTRA.split(", ")]
    extra = ["en", "s", 1, *["clash"] * (len(names) - 3)]
    return spark.createDataFrame([(*r, *extra) for r in rows], f"doc_id long, text string, {EXTRA}")
