"""Filter interaction audit: what every order of a set of filters keeps and removes, from one pass over the rows.

Each row has a mask of the filters that it fails. Rows are counted for each
part and mask; a subset-zeta transform of those counts gives the survivors of
every subset of filters, and a step of an order is the difference between two
neighbouring subsets. So no order is run: the work is one scan and as many
numbers a part as there are subsets.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh_names, literals, staged, table, text_or_empty

#: Most filters for which every order is listed, unless the caller names the orders.
ALL_ORDERS = 6


def mask_of(filters: dict[str, Column]) -> Column:
    """A number with one bit a filter, in the order given, set where the row fails it; a condition that is null is no failure."""
    return sum((F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(filters.values())), F.lit(0))


def mask_counts(rows: DataFrame, part: Column, mask: Column, labels: dict[str, Column]) -> DataFrame:
    """Rows of (part, mask, n, and one count for each label): at most one for each part and mask leaves a task."""
    count = lambda c: F.sum(F.when(c, F.lit(1)).otherwise(F.lit(0)).cast("long"))
    return rows.select(part.alias("part"), mask.alias("mask"), *(c.alias(f"label_{n}") for n, c in labels.items())).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), *(count(F.col(f"label_{n}")).alias(n) for n in labels))


def zeta(counts: Column, n_filters: int) -> Column:
    """Subset sums of an array of 2 ** n_filters counts: at place m the sum over all subsets of m."""

    def over_bit(sums: Column, bit: Column) -> Column:
        return F.transform(sums, lambda x, m: x + F.when(m.bitwiseAND(bit) != 0, F.element_at(sums, m.bitwiseXOR(bit) + 1)).otherwise(F.lit(0)))

    return F.aggregate(literals([1 << i for i in range(n_filters)], "int"), counts, over_bit)


def subset_survivors(counts: DataFrame, n_filters: int, measures: list[str]) -> DataFrame:
    """One row a part: for each measure its counts by mask, and ``kept_<measure>``: at place S the rows that pass all filters of subset S."""
    size = 1 << n_filters
    places = F.sequence(F.lit(0), F.lit(size - 1))
    by_mask = lambda n: F.map_from_entries(F.collect_list(F.struct("mask", n)))  # noqa: E731  2 ** n_filters entries at most
    at_places = lambda n: F.transform(places, lambda m: F.coalesce(F.col(n)[m], F.lit(0).cast("long"))).alias(n)
    dense = counts.groupBy("part").agg(*(by_mask(n).alias(n) for n in measures)).select("part", *map(at_places, measures))
    # a row passes the filters of S if its mask is a subset of the others: the sums backwards
    return dense.select("*", *(F.reverse(zeta(F.col(n), n_filters)).alias(f"kept_{n}") for n in measures))


def audit_filters(rows: DataFrame, part: Column, filters: dict[str, Column], labels: dict[str, Column] | None = None, *, orders: list[str] | None = None) -> DataFrame:
    """What each filter removes at each place of each order, for each part.

    ``filters`` maps names of one character to conditions under which a row
    fails; ``labels`` maps names to conditions whose rows are counted as lost.
    Returns one row for each part, order and step: part, filter_order, step
    (from 1), kept, removed, redundant (fails the filter and was removed
    before), unique_fails (fails this filter only), ``<label>_lost`` and
    shapley: the rows its filter removes, summed over all orders, whichever
    orders are listed. All are counts of rows, as longs.

    Null conditions count as passed and null parts are a part; repeated rows
    count as often as they stand; an empty table has no part and gives no rows;
    texts are read only by the conditions, whole; columns other than those that
    the conditions name are not read, so their names cannot clash.
    """
    names, labels = "".join(filters), labels or {}
    if len(names) != len(filters) or len(filters) > 16:
        raise ValueError("give up to 16 filters with names of one character")
    if orders is None:
        if len(names) > ALL_ORDERS:
            raise ValueError(f"name the orders of more than {ALL_ORDERS} filters")
        orders = ["".join(p) for p in permutations(names)]
    if any(sorted(o) != sorted(names) for o in orders):
        raise ValueError("an order names each filter once")
    n, full = len(names), (1 << len(names)) - 1
    measures = ["n", *labels]
    parts = subset_survivors(mask_counts(rows, part, mask_of(filters), labels), n, measures)

    def lost(measure: str, before: Column, bit: Column) -> Column:
        kept = F.col(f"kept_{measure}")
        return F.element_at(kept, before + 1) - F.element_at(kept, before.bitwiseOR(bit) + 1)

    def over_orders(bit: int) -> Column:
        """The filter's removed rows over all orders: those before it form S in |S|! (n - 1 - |S|)! orders."""
        weights = literals([math.factorial(k) * math.factorial(n - 1 - k) for k in range(n)], "long")
        without = literals([s for s in range(full + 1) if not s & bit], "int")
        return F.aggregate(without, F.lit(0).cast("long"), lambda total, s: total + F.element_at(weights, F.bit_count(s) + 1) * lost("n", s, F.lit(bit)))

    parts = parts.withColumn("shapley", F.array(*(over_orders(1 << i) for i in range(n))))
    steps = parts.withColumn("filter_order", F.explode(literals(orders, "string"))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(n))))
    place = F.instr(F.lit(names), F.substring("filter_order", F.col("step"), F.lit(1)))
    before = sum((F.when(F.instr("filter_order", name) < F.col("step"), F.lit(1 << i)).otherwise(F.lit(0)) for i, name in enumerate(names)), F.lit(0))
    steps = steps.withColumn("place", place).withColumn("before", before).withColumn("bit", F.element_at(literals([1 << i for i in range(n)], "int"), F.col("place")))
    b, s = F.col("bit"), F.col("before")
    removed = lost("n", s, b)
    return steps.select(
        "part", "filter_order", "step",
        F.element_at("kept_n", s.bitwiseOR(b) + 1).alias("kept"),
        removed.alias("removed"),
        (lost("n", F.lit(0), b) - removed).alias("redundant"),
        F.element_at("n", b + 1).alias("unique_fails"),
        *(lost(label, s, b).alias(f"{label}_lost") for label in labels),
        F.element_at("shapley", F.col("place")).alias("shapley"),
    )


def with_repeats(rows: DataFrame, key: str, digest: str, name: str) -> DataFrame:
    """Adds a boolean: a smaller key has an equal digest. Null keys are neither smaller nor larger than any.

    Only digests of more than one row are joined back. They are written first,
    so that the join shuffles both sides by itself and adaptive execution can
    split a digest that a third of the rows share. ``rows`` is read twice: hand
    in a written table.
    """
    least, known = fresh_names(rows, "least", "known")
    repeated = rows.groupBy(F.col(digest).alias(known)).agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias(least)).where("copies > 1").drop("copies")
    joined = rows.join(staged(repeated, "repeats"), F.col(digest) == F.col(known), "left")
    return joined.withColumn(name, F.coalesce(F.col(key) > F.col(least), F.lit(False))).drop(least, known)


def word_list(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text."""
    return F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def audit_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """The audit of five document filters by source, with good and toxic documents (``known``: doc_id, quality, toxic) that each step loses.

    A: under 200 words; B: distinct words under half of the words; C: over 2%
    capital letters A-Z; D: holds one of ``#$%&*|``; E: equal to the text of a
    smaller doc_id, anywhere in the table.

    Null texts are empty and null sources are the source ''; null ids have no
    label and are not copies nor originals of others. Of repeated ids every
    row counts; a label holds if any row of the id has it. Very long texts are
    read whole, each in one task. Empty tables: no documents, no rows; no
    labels, nothing lost. Other columns are not read.
    """
    text = text_or_empty()
    facts = docs.select(
        "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"), word_list(text).alias("words"),
    ).select(
        "doc_id", "part",
        (F.size("words") < 200).alias("a"),
        (100 * F.size(F.array_distinct("words")).cast("long") < 50 * F.size("words").cast("long")).alias("b"),
        (100 * F.length(F.regexp_replace("text", "[^A-Z]+", "")).cast("long") > 2 * F.length("text").cast("long")).alias("c"),
        F.col("text").rlike("[#$%&*|]").alias("d"),
        F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest"),
    )
    rows = with_repeats(staged(facts, "filter-facts"), "doc_id", "digest", "e")
    flag = lambda name: F.max(F.when(F.col(name) == 1, F.lit(1)).otherwise(F.lit(0))).alias(name)
    flags = staged(known.where("doc_id IS NOT NULL AND (quality = 1 OR toxic = 1)").groupBy(F.col("doc_id").alias("labelled")).agg(flag("quality"), flag("toxic")), "filter-labels")
    rows = rows.join(flags, F.col("doc_id") == F.col("labelled"), "left")
    return audit_filters(rows, F.col("part"), {x.upper(): F.col(x) for x in "abcde"}, {"good": F.col("quality") == 1, "toxic": F.col("toxic") == 1})


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH texts AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), known AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), rows AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < 200 THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN texts.doc_id > min(texts.doc_id) OVER (PARTITION BY t) THEN 16 ELSE 0 END AS mask
  FROM texts LEFT JOIN known ON texts.doc_id = known.doc_id
), masks AS (
  SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM rows GROUP BY part, mask
), letters AS (
  SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) v(letter, bit)
), orders AS (
  SELECT a.letter || b.letter || c.letter || d.letter || e.letter AS filter_order, a.bit AS b1, b.bit AS b2, c.bit AS b3, d.bit AS b4, e.bit AS b5
  FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit + b.bit + c.bit + d.bit + e.bit = 31 AND (a.bit | b.bit | c.bit | d.bit | e.bit) = 31
), steps AS (
  SELECT filter_order, 1 AS step, b1 AS bit, 0 AS before FROM orders
  UNION ALL SELECT filter_order, 2, b2, b1 FROM orders
  UNION ALL SELECT filter_order, 3, b3, b1 + b2 FROM orders
  UNION ALL SELECT filter_order, 4, b4, b1 + b2 + b3 FROM orders
  UNION ALL SELECT filter_order, 5, b5, b1 + b2 + b3 + b4 FROM orders
), found AS (
  SELECT part, filter_order, step, bit,
    sum(CASE WHEN mask & (before | bit) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN mask & before <> 0 AND mask & bit <> 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN mask & before = 0 AND mask & bit <> 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM masks CROSS JOIN steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley
FROM found
"""
