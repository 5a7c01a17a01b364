"""Connected components of a distributed edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import staged


#: A node with more edges than this has them joined in several parts, each of about so many.
HUB_EDGES = 1_000_000


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """The edges (u, v) with the ``m`` of their u; ``least`` has one row (u, m, n) for each node, n its edges.

    A hub's edges are dealt over parts by its degree and its row is copied to
    each. The table of hubs that is broadcast has at most one row for every
    HUB_EDGES edges.
    """
    parts = F.ceil(F.col("n") / HUB_EDGES)
    hubs = F.broadcast(least.filter(F.col("n") > HUB_EDGES).select("u", parts.alias("parts")))
    parted = edges.join(hubs, "u", "left").withColumn("part", F.pmod(F.xxhash64("v"), F.coalesce("parts", F.lit(1).cast("long"))))
    copied = least.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    return parted.select("u", "v", "part").join(copied.select("u", "m", "part"), ["u", "part"]).select("u", "v", "m")


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the least of the node and its neighbours."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("m", "u").alias("m"), "n")
    return _with_least(both.filter("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the least of those."""
    tied = _with_least(edges, edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")))
    return tied.select("u", F.col("m").alias("v")).unionByName(tied.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()


def _is_done(edges: DataFrame) -> bool:
    """Whether the edges are stars: every node has one smaller neighbour or is a centre, not both."""
    roles = edges.select(F.col("u").alias("w"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("w"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    mixed = roles.groupBy("w").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR up > 0 AND down > 0")
    return mixed.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge in (a, b); the root is the least node of the component.

    Each round is written to the shared folder and read again. Rounds go on
    until only stars are left, about the logarithm of the longest chain. Edges
    from a node to itself, and those with a null end, are dropped; nodes with no
    other edge are not returned. Repeated edges are one; ends of any type that
    has an order will do, and its least value is the root; from no edges come
    no rows; other columns are not read.
    """
    now = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while not _is_done(now):
        now = staged(_small(_large(now)), "stars")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
