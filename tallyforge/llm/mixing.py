"""Mixing sources to target weights by balanced sampling with the cube method.

Each source has a target of words. Every document of it is taken a whole
number of times, and once more with one probability for all documents of the
source, so that the expected words meet the target. The cube method turns those
probabilities into zeros and ones: three documents that are still open move
along the null-space of two constraints, words and documents, until one of them
is decided, and the next comes in. Groups of documents do this by themselves;
the one or two that each leaves open go on to the next level, until one group a
source is left, whose landing searches all choices of its last few documents.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_grouped, staged, table, text_or_empty

#: Units (copies of documents) in a group of the flight, about.
GROUP = 10_000
#: Equal rows are dealt in lots of so many, each hashed to a group by itself.
LOT = 64
#: Units that wait for the landing, beside the two that the flight leaves.
LANDING = 14
#: Source tables of up to so many bytes are broadcast, joined by shuffle beyond.
BROADCAST_BYTES = 16 << 20
#: Probabilities this near to 0 or 1 are decided.
EPSILON = 1e-9


@dataclass(frozen=True)
class Source:
    """A source with its words, units, target, and how its documents are taken: ``whole`` times, and once more with probability ``share``."""

    name: str | None
    size: int
    units: int
    target: float

    @property
    def ratio(self) -> float:
        return self.target / self.size if self.size else 0.0

    @property
    def whole(self) -> int:
        return math.floor(self.ratio + EPSILON)

    @property
    def share(self) -> float:
        share = self.ratio - self.whole
        return share if EPSILON < share < 1 - EPSILON else 0.0


def fill_targets(sizes: list[int], weights: list[float], *, total: float | None = None, most: float = 3.0) -> list[float]:
    """Targets that share ``total`` (all sizes, if not given) by weight; none is over ``most`` times its size, and the excess goes to the others by weight."""
    targets, left, still = [0.0] * len(sizes), float(sum(sizes)) if total is None else float(total), list(range(len(sizes)))
    while still and left > 0:
        each = left / sum(weights[i] for i in still)
        over = [i for i in still if weights[i] * each > most * sizes[i]]
        for i in over or still:
            targets[i] = most * sizes[i] if over else weights[i] * each
        if not over:
            break
        left -= sum(targets[i] for i in over)
        still = [i for i in still if i not in set(over)]
    return targets


def _step(psi: list[float], units: list[int], direction: list[float], draw: float) -> list[int]:
    """Moves units along +-direction to the wall of the cube, at odds that keep each expectation; returns the units still open."""
    ahead = min((1 - psi[k]) / u if u > 0 else -psi[k] / u for k, u in zip(units, direction, strict=True) if u)
    back = min(psi[k] / u if u > 0 else (psi[k] - 1) / u for k, u in zip(units, direction, strict=True) if u)
    by = ahead if draw * (ahead + back) < back else -back
    for k, u in zip(units, direction, strict=True):
        moved = psi[k] + by * u
        psi[k] = 0.0 if moved < EPSILON else 1.0 if moved > 1 - EPSILON else moved
    return [k for k in units if 0 < psi[k] < 1]


def flight(sizes: list[int], psi: list[float], rng: random.Random) -> list[float]:
    """Decides all units but two at most, keeping the sums of psi and of size times psi."""
    psi, held = list(psi), []
    for k, p in enumerate(psi):
        if not 0 < p < 1:
            continue
        held.append(k)
        if len(held) == 3:
            a, b, c = (sizes[i] for i in held)
            direction = [b - c, c - a, a - b] if a != b or b != c else [1, -1, 0]
            held = _step(psi, held, direction, rng.random())
    return psi


def land(sizes: list[int], psi: list[float]) -> list[float]:
    """Decides up to about 20 units at once: of all choices whose number is next to the sum of psi, the one whose words are nearest to theirs."""
    words, units = np.zeros(1, np.int64), np.zeros(1, np.int64)
    for size in sizes:
        words, units = np.concatenate([words, words + size]), np.concatenate([units, units + 1])
    off = np.abs(words - sum(s * p for s, p in zip(sizes, psi, strict=True)))
    best = int(np.argmin(np.where(np.abs(units - sum(psi)) < 1, off, np.inf)))
    return [float(best >> i & 1) for i in range(len(sizes))]


def fly_and_land(sizes: list[int], psi: list[float], rng: random.Random) -> list[float]:
    """Flies all but LANDING units, the largest and others at even steps of the order, and lands those with the two that the flight leaves."""
    still = [k for k, p in enumerate(psi) if 0 < p < 1]
    large = LANDING // 2
    kept = still if len(still) <= LANDING + 2 else [*still[:large], *(still[large + i * (len(still) - large - 1) // (LANDING - large - 1)] for i in range(LANDING - large))]
    waiting = set(kept)
    flown = flight(sizes, [0.0 if k in waiting else p for k, p in enumerate(psi)], rng)
    last = sorted(waiting | {k for k, p in enumerate(flown) if 0 < p < 1})
    for k, p in zip(last, land([sizes[k] for k in last], [psi[k] if k in waiting else flown[k] for k in last]), strict=True):
        flown[k] = p
    return [flown[k] if 0 < p < 1 else p for k, p in enumerate(psi)]


def _fly(batch):
    """One group: units in order of size, largest first; equal sizes by their hash."""
    import pyarrow as pa

    rows = batch.to_pydict()
    order = sorted(range(batch.num_rows), key=lambda i: (-rows["size"][i], rows["draw"][i], str(rows["doc_id"][i]), rows["copy"][i]))
    fly = fly_and_land if rows["landing"][0] else flight
    decided = fly([rows["size"][i] for i in order], [rows["psi"][i] for i in order], random.Random(rows["draw"][order[0]]))
    psi = [0.0] * batch.num_rows
    for i, p in zip(order, decided, strict=True):
        psi[i] = p
    return batch.set_column(batch.schema.get_field_index("psi"), "psi", pa.array(psi, pa.float64()))


def word_count(text: Column) -> Column:
    """How many ``[^\\x20\\x09-\\x0D]+`` a text has, without a list of them."""
    return F.length(F.regexp_replace(F.regexp_replace(text, r"[^\x20\x09-\x0D]+", "x"), r"[\x20\x09-\x0D]+", "")).cast("long")


def read_sources(lots: DataFrame, weights: tuple[float, ...], most: float) -> list[Source]:
    """Sources by code point, null last, with weights that repeat, and their targets. One row for each source reaches the driver."""
    sums = lots.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("units")).collect()
    sums.sort(key=lambda r: (r.source is None, r.source or ""))
    targets = fill_targets([r.size for r in sums], [weights[i % len(weights)] for i in range(len(sums))], most=most)
    return [Source(r.source, r.size, r.units, t) for r, t in zip(sums, targets, strict=True)]


def _groups(n: int, size: int) -> int:
    return max(1, -(-n // size))


def mix_sources(docs: DataFrame, *, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, group: int = GROUP) -> DataFrame:
    """How many words of each document a mix takes: doc_id, source, size, source_size, target, taken, one row for each document.

    Sources are ordered by code point, a null source last, and weigh
    ``weights``, repeating. They share the words of all documents by weight; a
    source takes no more than ``most`` times its own words, and the excess is
    shared again. ``size`` is the document's words, ``taken`` a multiple of it
    by one of the two whole numbers next to target / source_size. For each
    source the words taken differ from the target by no more than its last open
    document, among its smallest, and the copies by no more than two documents.

    Null and empty texts have no words and take none; null ids and sources are
    values like others; repeated rows are dealt one by one; sources without
    words have the target 0; an empty table gives no rows; texts are counted
    whole, however long; columns other than doc_id, source and text are not
    read. Choices come from hashes of doc_id, size and copy, so reruns agree,
    on any number of executors.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text_or_empty()).alias("size"))
    # equal rows are counted before they move, so a row that fills a third of the table is one row here, then many lots
    counted = rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
    lots = staged(
        counted.withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT).cast("long"))))
        .withColumn("copies", F.least(F.lit(LOT).cast("long"), F.col("n") - F.col("lot") * LOT)).drop("n"),
        "mix-lots",
    )
    sources = read_sources(lots, weights, most)
    names = "source_no int, source string, source_size long, target double, whole int, share double"
    known = spark.createDataFrame([(i, s.name, s.size, s.target, s.whole, s.share) for i, s in enumerate(sources)], names)
    if sum(64 + len((s.name or "").encode()) for s in sources) <= BROADCAST_BYTES:
        known = F.broadcast(known)
    units = lots.withColumnRenamed("source", "its").join(known, F.col("its").eqNullSafe(F.col("source"))).select(
        "source_no", "doc_id", "size", F.explode(F.sequence(F.col("lot") * LOT, F.col("lot") * LOT + F.col("copies") - 1)).alias("copy"),
        F.when(F.col("size") > 0, F.col("share")).otherwise(F.lit(0.0)).alias("psi"),
    )
    open_now = (F.col("psi") > 0) & (F.col("psi") < 1)
    decided, waiting, level = [units.where(~open_now)], units.where(open_now), 0
    n_groups = {i: _groups(s.units, group) for i, s in enumerate(sources) if s.share > 0}
    while n_groups:
        dealt = spark.createDataFrame([(i, n) for i, n in n_groups.items()], "source_no int, n_groups long")
        draw = F.xxhash64("doc_id", "size", "copy", F.lit(level))
        lot = F.floor(F.col("copy") / LOT) if level == 0 else F.col("copy")
        keyed = waiting.join(F.broadcast(dealt), "source_no").select(
            *waiting.columns, draw.alias("draw"), (F.col("n_groups") == 1).alias("landing"),
            F.pmod(F.xxhash64("doc_id", "size", lot, F.lit(-1 - level)), F.col("n_groups")).alias("dealt_to"),
        )
        flown = staged(map_grouped(keyed, ["source_no", "dealt_to"], _fly).select(*waiting.columns), f"mix-level{level}")
        decided.append(flown.where(~open_now))
        waiting = flown.where(open_now)
        n_groups = {i: _groups(2 * n, group) for i, n in n_groups.items() if n > 1}
        level += 1
    done = decided[0]
    for part in decided[1:]:
        done = done.unionByName(part)
    taken = F.col("size") * (F.col("whole") + F.col("psi").cast("long"))
    return done.join(known, "source_no").select("doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"))


def op12_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")
