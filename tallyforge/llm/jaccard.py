"""N-gram Jaccard join with a MinHash LSH forest.

Texts become sets of word shingles; texts with equal sets are copies and share
one node. Each node's MinHash signature is cut into the labels of a forest of
prefix tries. Starting from whole labels, the matched prefix is shortened until
the forest's expected recall at the threshold reaches the target; nodes that
share a prefix of that length in a tree are candidates. Walking each subtree in
sorted order, a sketch keeps the candidates that can be similar, as edges to a
few pivots instead of all pairs. In the components of those edges, which
contain every candidate link, exact Jaccard is computed block by block:
all links are counted, and each node is tied to the least node it is connected with.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import fresh_names, map_arrow, map_rows, staged, text_or_empty, words_of
from tallyforge.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
TREES, DEPTH = 32, 8
TARGET_RECALL = 0.999
#: Sketch similarity from which a candidate is tied to a pivot, and from which it is no pivot itself.
#: If two texts are similar from 0.8 on and one is within CORE of a pivot, the other is at 0.55 or more to it; TIED leaves four standard errors below that.
TIED, CORE = 0.43, 0.75
#: Nodes and shingles of a block, about.
BLOCK_NODES, BLOCK_SHINGLES = 256, 1_000_000
#: Nodes of a subtree that one task walks; a larger one is walked in slices.
SUBTREE_NODES = 50_000
SIGNED = "doc_id long, text_hash long, node binary, n_shingles long, labels array<binary>, sketch binary"


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a number of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


_HASHES = WordHashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)


def shingles(text: str, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; a shorter text with words is one n-gram, one without has none."""
    words = words_of(text)
    if not words:
        return np.empty(0, np.uint64)
    ids = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))
    width = min(size, len(ids))
    n = len(ids) - width + 1
    out = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            out = _mixed(out + ids[i : i + n])
    return np.unique(out)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return rng.integers(0, 1 << 32, n, dtype=np.uint32) | np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


_A, _B = _permutations(TREES * DEPTH)


def signature(hashes: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of a set that is not empty."""
    x = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    best = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for start in range(0, len(x), 2048):
        part = np.multiply.outer(_A, x[start : start + 2048])
        part += _B[:, None]
        np.minimum(best, part.min(axis=1), out=best)
    return best ^ (best >> np.uint32(16))


def expected_recall(similarity: float, trees: int, depth: int) -> float:
    return 1 - (1 - similarity**depth) ** trees


def matched_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL, trees: int = TREES, depth: int = DEPTH) -> int:
    """The longest prefix at which the forest's expected recall reaches the target: shortened step by step from whole labels."""
    while depth > 1 and expected_recall(threshold, trees, depth) < target:
        depth -= 1
    return depth


def _sign(rows: Iterator[tuple]) -> Iterator[tuple]:
    trees = [bytes([t]) for t in range(TREES)]
    for doc, text_hash, text in rows:
        own = shingles(text)
        node = hashlib.blake2b(own.tobytes(), digest_size=16).digest()
        if len(own):
            values = signature(own)
            raw = (values & np.uint32(0xFFFF)).astype(">u2").tobytes()
            labels = [t + raw[2 * DEPTH * i : 2 * DEPTH * (i + 1)] for i, t in enumerate(trees)]
            yield doc, text_hash, node, len(own), labels, ((values >> np.uint32(8)) & np.uint32(0xFF)).astype(np.uint8).tobytes()
        else:
            yield doc, text_hash, node, 0, [], b""


#: What a row of a walk is: a pivot found before, a row that is to be given if it is close to no pivot, or another row.
PIVOT, TOLD, QUIET = 0, 1, 2


def similar_to_pivots(rows: Iterator[tuple], grow: bool = True) -> Iterator[tuple]:
    """Walks rows (key, subtree, role, label, node, sketch) sorted by key, role and label.

    Only a group's pivots are held. A row joins the pivots that its sketch
    resembles: (member, pivot, null), given only where it joins what was apart,
    so there are fewer edges than rows. A row that is close to none of them is
    a pivot from then on with ``grow``, and given as (node, null, subtree) if
    its role is TOLD.
    """
    now: object = None
    root: list[int] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    for key, subtree, role, _, node, sketch in rows:
        own = np.frombuffer(sketch, np.uint8)
        if key != now:
            now, nodes, root = key, [], []
            pivots = np.empty((8, len(own)), np.uint8)
        n = len(nodes)
        joined = -1
        if role != PIVOT and n:
            alike = (pivots[:n] == own).mean(axis=1)
            for i in np.flatnonzero(alike >= TIED).tolist():
                r = find(i)
                if r != joined:
                    yield node, nodes[i], None
                    if joined >= 0:
                        root[r] = joined
                    else:
                        joined = r
            if alike.max() >= CORE:
                continue
        if role == TOLD:
            yield node, None, subtree
        if role == PIVOT or grow:
            if n == len(pivots):
                pivots = np.concatenate([pivots, np.empty_like(pivots)])
            pivots[n] = own
            nodes.append(node)
            root.append(joined if joined >= 0 else n)


WALKED = "a binary, b binary, subtree long"


def candidate_edges(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that connect all nodes of a subtree that can be similar, from rows (subtree, n, node), n the subtree's nodes, and (node, label, sketch).

    A subtree is one task up to SUBTREE_NODES. Of a larger one a slice of about
    that many nodes is walked alone; its pivots then go to the other slices,
    where every row meets them, and only rows close to none of them stay for
    the next round: a group of near copies, however large, is close to a few.
    """

    def walk(rows: DataFrame, grow: bool) -> DataFrame:
        rows = rows.join(nodes, "node").select("key", "subtree", "role", "label", "node", "sketch")
        rows = rows.repartition("key").sortWithinPartitions("key", "role", "label", "node")
        return staged(map_rows(rows, lambda r: similar_to_pivots(r, grow), WALKED), "walked")

    edges: DataFrame | None = None
    slices = F.ceil(F.col("n") / SUBTREE_NODES)
    for turn in itertools.count():
        rows = members.withColumn("slices", slices).withColumn("slice", F.pmod(F.xxhash64("node", F.lit(turn)), slices))
        role = F.when(F.col("slices") > 1, TOLD).otherwise(QUIET).alias("role")
        walked = walk(rows.filter("slice = 0").select(F.col("subtree").alias("key"), "subtree", role, "node"), True)
        found = walked.filter("b IS NOT NULL").select("a", "b")
        edges = found if edges is None else edges.unionByName(found)
        if rows.filter("slice > 0").isEmpty():
            return edges
        sizes = rows.filter("slices > 1").groupBy("subtree").agg(F.max("slices").alias("slices"))
        pivots = walked.filter("b IS NULL").join(sizes, "subtree").withColumn("slice", F.explode(F.sequence(F.lit(1).cast("long"), F.col("slices") - 1)))
        key = F.xxhash64("subtree", "slice").alias("key")
        met = walk(rows.filter("slice > 0").select(key, "subtree", F.lit(TOLD).alias("role"), "node").unionByName(pivots.select(key, "subtree", F.lit(PIVOT).alias("role"), F.col("a").alias("node"))), False)
        edges = edges.unionByName(met.filter("b IS NOT NULL").select("a", "b"))
        left = met.filter("b IS NULL").select("subtree", F.col("a").alias("node"))
        members = staged(left.join(left.groupBy("subtree").agg(F.count(F.lit(1)).alias("n")), "subtree"), "left")


def links(sets: list[np.ndarray], sides: np.ndarray, threshold: Fraction, across: bool) -> Iterator[tuple[int, np.ndarray]]:
    """For each i the j > i with Jaccard of at least the threshold; with ``across`` only those on another side.

    Sets are sorted and distinct. Intersections are counted with an inverted index.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    num, den = threshold.numerator, threshold.denominator
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    posts = owner[order]
    starts = np.flatnonzero(np.r_[True, flat[order][1:] != flat[order][:-1]])
    counts = np.diff(np.r_[starts, len(flat)])
    term = np.empty(len(flat), np.int64)
    term[order] = np.repeat(np.arange(len(starts)), counts)
    begin = np.r_[0, np.cumsum(sizes)]
    for i in range(len(sets) - 1):
        own = term[begin[i] : begin[i + 1]]
        own = own[counts[own] > 1]
        if not len(own):
            continue
        n = counts[own]
        at = np.arange(n.sum()) + np.repeat(starts[own] - np.r_[0, np.cumsum(n)[:-1]], n)
        common = np.bincount(posts[at], minlength=len(sets))
        good = common * (num + den) >= num * (sizes + sizes[i])
        good[: i + 1] = False
        if across:
            good &= sides != sides[i]
        if good.any():
            yield i, np.flatnonzero(good)


def _verify(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (key, node, copies, block, across, shingles) sorted by key: (node, null, linked documents) and (node, least node connected with it, 0).

    ``across`` tells the pair of two blocks, even if one of them is empty: links inside a block are counted by its pair with itself.
    """
    threshold = Fraction(str(THRESHOLD))
    held: dict[bytes, tuple] = {}
    now: object = None
    across = False

    def group():
        if across and len({m[1] for m in held.values()}) < 2:
            return
        nodes, members = list(held), list(held.values())
        weights, sides = np.array([m[0] for m in members]), np.array([m[1] for m in members])
        sums = np.zeros(len(nodes), np.int64)
        root = list(range(len(nodes)))
        parent = np.arange(len(nodes))  # roots as last seen; equal ones need no further look

        def find(i):
            while root[i] != i:
                root[i] = i = root[root[i]]
            return i

        for i, js in links([m[2] for m in members], sides, threshold, across):
            sums[i] += weights[js].sum()
            sums[js] += weights[i]
            for j in js[parent[js] != parent[i]].tolist():
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
                parent[j] = min(a, b)
            parent[i] = find(i)
        for i in np.flatnonzero(sums).tolist():
            if find(i) != i:
                yield nodes[i], nodes[find(i)], 0
            yield nodes[i], None, int(sums[i])

    for key, node, copies, block, two, own in rows:
        if key != now:
            if len(held) > 1:
                yield from group()
            held, now, across = {}, key, two
        held[node] = (copies, block, np.frombuffer(own, np.uint64))
    if len(held) > 1:
        yield from group()


#: Rows that a task remembers to merge repeated ones.
REMEMBERED = 500_000


def _once(batches):
    """Batches without the rows whose key (rep_id, no_id, rep_hash) the task has just seen. It forgets all when it has seen REMEMBERED, which costs merging and no row."""
    import pyarrow as pa

    seen: set[tuple] = set()
    for batch in batches:
        fresh = []
        for key in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("rep_id", "no_id", "rep_hash")), strict=True):
            fresh.append(key not in seen)
            seen.add(key)
        if len(seen) > REMEMBERED:
            seen.clear()
        yield batch if all(fresh) else batch.filter(pa.array(fresh))


def _shingle_rows(rows: Iterator[tuple]) -> Iterator[tuple]:
    for text, *rest in rows:
        yield (*rest, shingles(text).tobytes())


def join_ngrams(docs: DataFrame, *, target_recall: float = TARGET_RECALL) -> DataFrame:
    """One row for each document: doc_id, text_hash, class_id, n_links, n_copies, is_first.

    Two documents are linked if the Jaccard similarity of their sets of
    5-word shingles is 0.8 or more; equal sets are always linked. ``n_links``
    counts the other documents a document is linked with; ``class_id`` is the
    least doc_id of those it is connected with through links; ``n_copies``
    the documents with an equal set, itself included; ``is_first`` marks the
    document (by id, then hash of the text) that stands for its class. Rows
    equal in id and text are all marked or none.

    Null and empty texts and texts of white space have no shingles and are
    copies of each other; texts of one to four words have one shingle of all
    words; very long texts are read whole, and their set of shingles is one
    row. Null ids are passed over in class_id unless a class has no other.
    Empty tables give no rows; other columns are not read.
    """
    depth = matched_depth(target=target_recall)
    # doc_id, hash and text; a text's rows are told apart from others of the same id by the hash
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_or_empty()).alias("text_hash"), text_or_empty().alias("text"))
    signed = staged(map_rows(rows, _sign, SIGNED), "signed")
    first = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id"), F.col("text_hash"))
    small = signed.groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min(first).alias("rep"), F.max("n_shingles").alias("n_shingles"), F.first("labels").alias("labels"), F.first("sketch").alias("sketch"))
    nodes = staged(small.select("node", "copies", F.col("rep.doc_id").alias("rep_id"), F.col("rep.text_hash").alias("rep_hash"), "n_shingles", "labels", "sketch"), "nodes")

    # candidates: nodes that share a prefix; subtrees with the same nodes in several trees are walked once
    prefixed = nodes.select("node", F.explode("labels").alias("label")).select("node", F.xxhash64(F.substring("label", 1, 1 + 2 * depth)).alias("prefix"))
    together = prefixed.groupBy("prefix").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("members")).filter("n > 1")
    subtrees = prefixed.join(together, "prefix").select("node", F.xxhash64("n", "members").alias("subtree"), "n").repartition("node").distinct()
    coarse = components(candidate_edges(staged(subtrees, "subtrees"), nodes.select("node", "sketch", F.get("labels", F.lit(0)).alias("label"))))

    # exact verification inside the components, one pair of blocks at a time
    members = coarse.join(nodes.select("node", "copies", "rep_id", "rep_hash", "n_shingles"), "node")
    # what rows fetch by a key that many of them share is written first: a join with a table is one that adaptive execution can split
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("s"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("s") / BLOCK_SHINGLES)).cast("int")
    members = staged(members.join(staged(sizes, "sizes"), "root").select("node", "copies", F.coalesce("rep_id", F.lit(0)).alias("rep_id"), F.col("rep_id").isNull().alias("no_id"), "rep_hash", "root", blocks.alias("blocks")), "members")
    keyed = rows.select("text", F.coalesce("doc_id", F.lit(0)).alias("rep_id"), F.col("doc_id").isNull().alias("no_id"), F.col("text_hash").alias("rep_hash"))
    # a row that stands many times is merged in its task before it moves, and once more where its copies meet;
    # a sort-merge join at every size, which neither side's size can turn into a broadcast
    keys = ["rep_id", "no_id", "rep_hash"]
    chosen = map_arrow(keyed, _once, keyed.schema).join(members.hint("merge"), keys).dropDuplicates(keys).select("text", "node", "copies", "root", "blocks")
    sets = map_rows(chosen, _shingle_rows, "node binary, copies long, root binary, blocks int, shingles binary")
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pair = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("i"), F.greatest("block", j).alias("j"))))
    dealt = sets.withColumn("block", block).withColumn("pair", pair).withColumn("key", F.xxhash64("root", "pair.i", "pair.j"))
    dealt = dealt.select("key", "node", "copies", "block", (F.col("pair.i") != F.col("pair.j")).alias("across"), "shingles").repartition("key").sortWithinPartitions("key", "node")
    verified = staged(map_rows(dealt, _verify, "a binary, b binary, linked long"), "verified")

    # classes
    final = components(verified.filter("b IS NOT NULL").select("a", "b"))
    linked = verified.filter("b IS NULL").groupBy(F.col("a").alias("node")).agg(F.sum("linked").alias("linked"))
    named = final.join(nodes.select("node", "rep_id", "rep_hash"), "node")
    least = named.groupBy("root").agg(F.min(F.struct(F.col("rep_id").isNull().alias("last"), F.col("rep_id"), F.col("rep_hash"))).alias("least"))
    classed = named.join(least, "root").join(linked, "node", "left").select("node", F.col("least.rep_id").alias("class_of"), F.col("least.rep_hash").alias("hash_of"), "linked")
    summary = nodes.select("node", "copies", "rep_id", "rep_hash").join(classed, "node", "left").select(
        "node", "copies", F.when(F.col("hash_of").isNull(), F.col("rep_id")).otherwise(F.col("class_of")).alias("class_id"), F.coalesce("hash_of", "rep_hash").alias("class_hash"), F.coalesce("linked", F.lit(0)).alias("linked")
    )
    return signed.select("doc_id", "text_hash", "node").join(staged(summary, "summary"), "node").select(
        "doc_id", "text_hash", "class_id", (F.col("linked") + F.col("copies") - 1).alias("n_links"), F.col("copies").alias("n_copies"),
        (F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash"))).alias("is_first"),
    )


def keep_firsts(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """The documents that stand for their class in ``joined``, one row each, with all their columns.

    ``joined`` is ``join_ngrams`` of the same documents. Of rows equal in id
    and text one stays, whatever its other columns are; very long texts move as
    rows like others; a null id is an id, a
    null text an empty one; an empty table stays empty; names of columns that
    are used inside are chosen so that none clashes.
    """
    keys = fresh_names(docs, "id", "none", "hash")
    of_row = (F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), F.col("doc_id").isNull(), F.xxhash64(text_or_empty()))
    of_first = (F.coalesce("doc_id", F.lit(0)), F.col("doc_id").isNull(), F.col("text_hash"))
    firsts = joined.filter("is_first").select(*(c.alias(k) for k, c in zip(keys, of_first, strict=True))).distinct()
    keyed = docs.withColumns(dict(zip(keys, of_row, strict=True)))
    return keyed.join(firsts, keys, "left_semi").dropDuplicates(keys).select(*(F.col(f"`{c}`") for c in docs.columns))


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_ngrams(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", "n_links", "n_copies")


OP8_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_sort(list_distinct(list_transform(range(len(w) - 4), lambda i: array_to_string(w[i + 1:i + 5], ' ')))) END AS sh FROM d
), n AS (
  SELECT sh, min(doc_id) AS node, count(*) AS copies, len(sh) AS size FROM s GROUP BY sh
), t AS (
  SELECT node, size, copies, unnest(sh) AS g FROM n
), l AS (
  SELECT a.node AS a, b.node AS b, any_value(b.copies) AS copies FROM t a JOIN t b ON a.g = b.g AND a.node <> b.node
  GROUP BY a.node, b.node, a.size, b.size HAVING 9 * count(*) >= 4 * (a.size + b.size)
), r(node, root) AS (
  SELECT node, node FROM n UNION SELECT l.b, r.root FROM r JOIN l ON r.node = l.a
), c AS (
  SELECT node, min(root) AS class_id FROM r GROUP BY node
), k AS (
  SELECT a, sum(copies) AS linked FROM l GROUP BY a
)
SELECT s.doc_id, c.class_id, (coalesce(k.linked, 0) + n.copies - 1)::BIGINT AS n_links, n.copies::BIGINT AS n_copies
FROM s JOIN n ON s.sh = n.sh JOIN c ON c.node = n.node LEFT JOIN k ON k.a = n.node
"""
