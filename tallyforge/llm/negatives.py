"""Hard-negative mining with product quantisation and residual bounds.

Vectors are made integers. Each is coded by the nearest centroids of its short
pieces; beside the codes stands the norm of what they leave out. For an anchor,
the sum of table entries for a row's codes differs from the true inner product
by no more than the anchor's norm times that residual norm, so rows whose
bounds cannot reach a window are left out without loss. The others are scored
with exact integers. Anchors go in blocks of bounded bytes over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import arrow_schema, map_arrow, new_path, staged, table

#: Components in a piece, centroids for each piece, rows of the bounded training sample, rounds of training.
PIECE, CENTROIDS, SAMPLE, ROUNDS = 2, 256, 4096, 8
#: Bytes of anchors' vectors that go over the rows at once; anchors and rows that meet in one table; pairs scored at once.
BLOCK_BYTES, ANCHORS, ROWS, PAIRS = 16 << 20, 256, 2048, 1 << 16
#: No score may need more than a long.
MOST = float(1 << 62)

INDEX = "vec_id long, label long, vector binary, codes binary, residual double"
HITS = "anchor int, slot int, vec_id long, score long"


def _nearest(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """The nearest centroid of each point, but for rounding, which costs a little residual and no correctness."""
    points, centroids = points.astype(np.float32), centroids.astype(np.float32)
    with np.errstate(over="ignore", invalid="ignore"):
        far = np.broadcast_to((centroids**2).sum(1) / 2, (len(points), len(centroids))).copy()
        for d in range(points.shape[1]):  # few components: cheaper than a matrix product
            far -= points[:, d, None] * centroids[None, :, d]
    return np.argmin(far, axis=1)


@dataclass
class Codebook:
    """``centroids[p]``: the centroids of piece p, padded with zeros to whole pieces."""

    centroids: np.ndarray
    dims: int

    @property
    def pieces(self) -> int:
        return self.centroids.shape[0]

    def padded(self, vectors: np.ndarray) -> np.ndarray:
        wide = np.zeros((len(vectors), self.pieces * self.centroids.shape[2]))
        wide[:, : vectors.shape[1]] = vectors
        return wide.reshape(len(vectors), self.pieces, self.centroids.shape[2])

    def encode(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows x pieces) and residual norms, rounded up."""
        wide, codes, rest = self.padded(vectors), np.empty((len(vectors), self.pieces), np.uint8), np.zeros(len(vectors))
        for p, centroids in enumerate(self.centroids):
            codes[:, p] = _nearest(wide[:, p], centroids)
            rest += ((wide[:, p] - centroids[codes[:, p]]) ** 2).sum(1)
        return codes, np.sqrt(rest) * (1 + 1e-9) + 1e-9


def train_codebook(sample: np.ndarray, piece: int = PIECE, n: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 7) -> Codebook:
    """k-means for each piece. The codebook decides how many rows are scored exactly, never which rows are found."""
    dims = sample.shape[1]
    pieces = max(1, -(-dims // piece))
    book = Codebook(np.zeros((pieces, n, piece)), dims)
    wide, rng = book.padded(sample), np.random.default_rng(seed)
    for p in range(pieces if len(sample) else 0):
        points = wide[:, p]
        centroids = points[rng.choice(len(points), n, replace=len(points) < n)].copy()
        for _ in range(rounds):
            at = _nearest(points, centroids)
            held = np.bincount(at, minlength=n)
            sums = np.stack([np.bincount(at, points[:, d], n) for d in range(piece)], axis=1)
            centroids = np.where(held[:, None] > 0, sums / np.maximum(held, 1)[:, None], centroids)
        book.centroids[p] = centroids
    return book


@dataclass
class Anchors:
    """A block of anchors. ``low`` and ``high`` (anchors x slots) bound the scores that count; a slot with low > high is empty."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same_label: bool


def bounds(book: Codebook, anchors: np.ndarray, codes: np.ndarray, residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lookup-table scores of rows x anchors, and how far the true score can be from each, rounding of floats included."""
    wide = book.padded(anchors)
    with np.errstate(over="ignore", invalid="ignore"):
        score = np.zeros((len(codes), len(anchors)), np.float32)
        largest = np.zeros(len(anchors))
        for p, centroids in enumerate(book.centroids):
            entries = centroids @ wide[:, p].T
            largest += np.abs(entries).max(axis=0)
            score += entries.astype(np.float32)[codes[:, p]]
        # each of the entries and each of the sums rounds by 2 ** -24 of what it holds
        slack = largest * (book.pieces + 4) * 2.0**-23 + 1e-3
        reach = residuals.astype(np.float32)[:, None] * np.linalg.norm(anchors, axis=1).astype(np.float32)[None, :]
        return score, reach * np.float32(1 + 1e-5) + slack.astype(np.float32)[None, :]


def exact_scores(anchors: np.ndarray, rows: np.ndarray, a: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Integer inner products of the pairs, some at a time."""
    return np.concatenate([np.einsum("ij,ij->i", anchors[a[i : i + PAIRS]], rows[r[i : i + PAIRS]]) for i in range(0, len(a), PAIRS)] or [np.zeros(0, np.int64)])


def best(slot: np.ndarray, ids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Places of the first ``keep`` of each slot by score and id."""
    order = np.lexsort((ids, -scores, slot))
    s = slot[order]
    rank = np.arange(len(s)) - np.searchsorted(s, s, side="left")
    return order[rank < keep]


class Search:
    """What a task has found so far for a block of anchors: at most ``keep`` rows for each anchor and slot."""

    def __init__(self, block: Anchors, book: Codebook, keep: int):
        self.block, self.book, self.keep = block, book, keep
        self.n_slots = block.low.shape[1]
        self.slot, self.ids, self.scores = (np.zeros(0, np.int64) for _ in range(3))
        # the least score that can still enter a slot
        self.least = block.low.astype(np.float64)

    def add(self, ids, labels, vectors, codes, residuals) -> None:
        for at in range(0, len(self.block.ids), ANCHORS):
            self._meet(slice(at, min(at + ANCHORS, len(self.block.ids))), ids, labels, vectors, codes, residuals)

    def _meet(self, part: slice, ids, labels, vectors, codes, residuals) -> None:
        block = self.block
        score, reach = bounds(self.book, block.vectors[part], codes, residuals)
        above, below = score + reach, score - reach
        fits = labels[:, None] == block.labels[part][None, :]
        fits = fits if block.same_label else ~fits
        wanted = np.zeros_like(fits)
        for slot in range(self.n_slots):
            low, high = self.least[part, slot], block.high[part, slot].astype(np.float64)
            if (open_ := (low <= high)).any():
                # written so that a bound that is no number leaves nothing out
                inside = fits & ~(below > high[None, :]) & open_[None, :]
                sure = np.where(inside & (above <= high[None, :]), below, -np.inf)
                if len(ids) > self.keep + 1:  # so many rows are surely inside and above; one more than kept, as one may be the anchor
                    low = np.maximum(low, np.partition(sure, len(ids) - self.keep - 1, axis=0)[len(ids) - self.keep - 1])
                wanted |= inside & ~(above < low[None, :])
        r, a = np.nonzero(wanted)
        a = a + part.start
        scores = exact_scores(block.vectors, vectors, a, r)
        for slot in range(self.n_slots):
            # as low holds for the slot, and not the raised bound, what enters is decided by exact scores alone
            enters = (scores >= block.low[a, slot]) & (scores <= block.high[a, slot])
            if block.same_label:
                alike = enters & (ids[r] == block.ids[a])
                enters[alike] = ~(vectors[r[alike]] == block.vectors[a[alike]]).all(axis=1)
            self._keep(a[enters] * self.n_slots + slot, ids[r[enters]], scores[enters])

    def _keep(self, slot: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        if not len(slot):
            return
        touched = np.isin(self.slot, slot)
        slot, ids, scores = (np.concatenate([x[touched], y]) for x, y in ((self.slot, slot), (self.ids, ids), (self.scores, scores)))
        places = best(slot, ids, scores, self.keep)
        slot, ids, scores = slot[places], ids[places], scores[places]
        full, start, n = np.unique(slot, return_index=True, return_counts=True)
        full, last = full[n == self.keep], (start + n - 1)[n == self.keep]
        self.least[full // self.n_slots, full % self.n_slots] = scores[last]
        self.slot, self.ids, self.scores = (np.concatenate([x[~touched], y]) for x, y in ((self.slot, slot), (self.ids, ids), (self.scores, scores)))


def _integers(vector: Column) -> Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 256))


def _usable(vector: Column) -> Column:
    whole = lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf"))
    return vector.isNotNull() & F.forall(vector, lambda x: F.coalesce(whole(x), F.lit(False)))


def _matrix(vectors: list[np.ndarray], dims: int) -> np.ndarray:
    found = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        found[i, : len(v)] = v
    return found


def _vectors(column, dims: int) -> np.ndarray:
    """Integer vectors of a binary Arrow column, of which all rows have ``dims`` numbers."""
    return np.frombuffer(b"".join(column.to_pylist()), np.int64).reshape(len(column), dims)


def index_rows(rows: DataFrame, book: Codebook) -> DataFrame:
    """Codes and residual norm of every row (vec_id, label, vector: integers), shorter vectors filled with zeros."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                column = part.column(2)
                vectors = _matrix([np.asarray(v, np.int64) for v in column.to_pylist()], book.dims)
                norms = np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
                if len(norms) and norms.max() ** 2 >= MOST:
                    raise OverflowError("a vector is so long that its integer scores do not fit in a long")
                codes, residuals = book.encode(vectors.astype(np.float64))
                raw = [pa.array([v.tobytes() for v in x], pa.binary()) for x in (vectors, codes)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *raw, pa.array(residuals)], schema=arrow_schema(INDEX))

    return map_arrow(rows, run, INDEX)


def _search(index: DataFrame, block: Anchors, book: Codebook, keep: int) -> DataFrame:
    """The first ``keep`` rows of each anchor and slot over all rows of the index: anchor, slot, vec_id, score, rank."""
    shared = index.sparkSession.sparkContext.broadcast((block, book))  # BLOCK_BYTES and the bounds beside it

    def run(batches):
        import pyarrow as pa

        found = Search(*shared.value, keep)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(part.num_rows, book.pieces)
                found.add(*(part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1)), _vectors(part.column(2), book.dims), codes, part.column(4).to_numpy(zero_copy_only=False))
        columns = found.slot // found.n_slots, found.slot % found.n_slots, found.ids, found.scores
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow_schema(HITS), strict=True)], schema=arrow_schema(HITS))

    hits = map_arrow(index, run, HITS)
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)


def mine_negatives(
    rows: DataFrame, is_anchor: Column, *, vec_id: str = "vec_id", label: str = "label", vector: str = "embedding", n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, of: int = 100,
    block_bytes: int = BLOCK_BYTES, sample: int = SAMPLE, piece: int = PIECE,
) -> DataFrame:
    """Hard negatives for the rows where ``is_anchor`` holds: anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are inner products of the integers floor(256 * x); higher ones come
    first, ties by the smaller id. An anchor's positives are its first
    ``n_positives`` other rows of its label. For each, the first
    ``n_negatives`` rows of other labels whose score is from low / of to
    high / of of the positive's are returned, ranked from 1: fewer, where there
    are fewer. Every row is coded and every anchor meets every row; bounds only
    leave out rows that cannot be among the first, so nothing is lost (recall
    1). The codebook is fitted on at most ``sample`` rows.

    Rows with a null id, label or vector, or with a component that is null or
    not finite, take no part. Shorter vectors count as filled up with zeros.
    Repeated rows count once; rows that share an id but not the label or the
    vector are rows of their own. A vector so long
    that a score would not fit in a long ends the job with an error. Vectors
    that many rows share are scored like others, in pairs of bounded number. An
    empty table, and one without anchors, gives no rows; other columns are not
    read. Anchors pass the driver in blocks of ``block_bytes``.
    """
    if not 0 <= low <= high <= of:
        raise ValueError("the window is from low to high of a positive's score, both between 0 and of")
    spark = rows.sparkSession
    usable = F.col(vec_id).isNotNull() & F.col(label).isNotNull() & _usable(F.col(vector))
    rows = rows.where(usable).select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), _integers(F.col(vector)).alias("vector"), F.coalesce(is_anchor, F.lit(False)).alias("is_anchor"))
    rows = staged(rows.groupBy("vec_id", "label", "vector").agg(F.max("is_anchor").alias("is_anchor")), "negatives-rows")
    dims = max(1, rows.agg(F.max(F.size("vector"))).first()[0] or 0)
    drawn = rows.select("vector").orderBy(F.xxhash64("vec_id", "label"), "vec_id", "label").limit(sample).collect()
    book = train_codebook(_matrix([np.asarray(r.vector) for r in drawn], dims).astype(np.float64), piece)
    index = staged(index_rows(rows.select("vec_id", "label", "vector"), book), "negatives-index")
    anchors = staged(rows.where("is_anchor").select("vec_id", "label", "vector"), "negatives-anchors")
    n_blocks = max(1, -(-anchors.count() * dims * 8 // block_bytes))
    path = new_path(spark, "negatives")
    result = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark.createDataFrame([], result).write.mode("append").parquet(path)
    for number in range(n_blocks):
        held = anchors.where(F.pmod(F.xxhash64("vec_id", "label", "vector"), F.lit(n_blocks)) == number).collect()
        if held:
            _mine_block(index, book, held, dims, n_positives, n_negatives, (low, high, of)).write.mode("append").parquet(path)
    return spark.read.schema(result).parquet(path)


def _mine_block(index: DataFrame, book: Codebook, held: list, dims: int, n_positives: int, n_negatives: int, window: tuple[int, int, int]) -> DataFrame:
    """The result's rows of one block of anchors: positives over all rows, then negatives in their windows over all rows."""
    low, high, of = window
    ids, labels = (np.array([r[i] for r in held], np.int64) for i in range(2))
    vectors = _matrix([np.asarray(r.vector) for r in held], dims)
    whole = np.int64(MOST)
    any_score = Anchors(ids, labels, vectors, np.full((len(held), 1), -whole), np.full((len(held), 1), whole), same_label=True)
    positives = _search(index, any_score, book, n_positives).select("anchor", "rank", "vec_id", "score").collect()  # n_positives for each of the block's anchors
    lows, highs = np.ones((len(held), n_positives), np.int64), np.zeros((len(held), n_positives), np.int64)  # empty
    found: list[tuple] = []
    for r in positives:
        lows[r.anchor, r.rank - 1], highs[r.anchor, r.rank - 1] = -(-low * r.score // of), high * r.score // of
        found.append((r.anchor, r.rank - 1, int(ids[r.anchor]), r.vec_id, r.score))
    windows = Anchors(ids, labels, vectors, lows, highs, same_label=False)
    known = index.sparkSession.createDataFrame(found, "anchor int, slot int, anchor_id long, positive_id long, positive_score long")
    hits = _search(index, windows, book, n_negatives)
    return hits.join(F.broadcast(known), ["anchor", "slot"]).select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    wrong = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine_negatives(wrong, F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH rows AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), pairs AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM rows a JOIN rows b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM pairs WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN pairs USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
