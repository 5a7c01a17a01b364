"""Best-fit packing of tokenized documents by exact-complement hashing.

Documents become pieces of at most ``capacity`` tokens. Only the histogram of
piece lengths, ``capacity`` numbers at most, reaches the driver. There, from
the longest length down, the gap a piece leaves is looked up in an index of
single, pair and triple sums of the lengths still available, and combinations
that fill it exactly are consumed as often as their counts allow; what is left
is packed best-fit. The plan says how often each combination is used. Executors
then give every piece its rank among those of equal length and read its
sequence and offset from the plan.
"""

from __future__ import annotations

import array
import sys
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm.common import literals, map_arrow, map_rows, staged

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
END_ID = 0
#: Pieces of one length are numbered in independent groups of about so many.
BUCKET_PIECES = 1_000_000
#: Equal pieces are numbered in lots of so many.
LOT = 64
_RANKS = 1 << 48  # more than the pieces of any length

Plan = list[tuple[tuple[int, ...], int]]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the tokenizer file gives them: ``Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids``.

    Where a file with the same vocabulary as ranks lies beside it, texts in
    Latin-1 without added tokens and extreme runs, for which the faster library
    is no faster, are encoded by that library. The ids are the same, which
    tests hold against the call above.
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        #: Literals that the tokenizer reads as one id in any text; the faster library has none.
        self.added = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        self.fast = self._ranks(path)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    @staticmethod
    def _ranks(path: str):
        import base64
        import os

        ranks = path.removesuffix(".json") + ".tiktoken"
        if not path.endswith(".json") or not os.path.exists(ranks):
            return None
        import public_tokenizers
        import tiktoken

        with open(ranks, "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.fast and _plain(text) and not any(t in text for t in self.added):
            return self.fast.encode_ordinary(text)
        return self.slow.encode(text, add_special_tokens=False).ids


def _plain(text: str) -> bool:
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    words = text.split()
    space = len(text) - sum(map(len, words))
    return space - len(words) < 500 and max(map(len, words), default=0) < 2000


def pieces_of(ids: list[int], capacity: int) -> Iterator[tuple[int, int, list[int]]]:
    """(piece, start, ids): whole if it fits; else full pieces after a first one that takes the remainder."""
    first = len(ids) % capacity or capacity
    at = 0
    piece = 0
    while at < len(ids):
        end = first if not at else at + capacity
        yield piece, at, ids[at:end]
        at, piece = end, piece + 1


def crc_of_ids(ids: list[int]) -> int:
    raw = array.array("I", ids)
    if sys.byteorder == "big":
        raw.byteswap()
    return zlib.crc32(raw.tobytes())


def tokenize(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, piece, start, length, ids_crc32 and, if asked for, the ids.

    A document is its ids and the end id 0; null and empty texts are the end id alone.
    """
    path = tokenizer or default_tokenizer()

    def run(rows):
        encoder = Encoder.of(path)
        for doc, text in rows:
            for piece, start, ids in pieces_of([*encoder.ids(text or ""), END_ID], capacity):
                row = (doc, piece, start, len(ids), crc_of_ids(ids))
                yield (*row, ids) if with_ids else row

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, PIECES + ", ids array<int>" * with_ids)


class SumIndex:
    """Which lengths still available make up a sum.

    One length is its count. Two lengths are listed by their sum, the most even
    pair first; three are a length and a pair that makes up the rest. Counts
    only fall, so what once is used up is never looked at again: each list has
    a place up to which nothing is left. Even combinations come first because
    the small lengths they spare are what fills the last gaps.
    """

    def __init__(self, counts: list[int]):
        self.counts = counts
        some = np.array(counts) > 0
        #: For each sum the larger parts of its pairs.
        self.pairs: list[list[int]] = []
        for total in range(len(counts)):
            half = (total + 1) // 2
            self.pairs.append((half + np.flatnonzero(some[half:total] & some[total - half : 0 : -1])).tolist() if total > 1 else [])
        self.pair_from = [0] * len(counts)
        self.triple_from = [-(-total // 3) for total in range(len(counts))]

    def times(self, lengths: tuple[int, ...]) -> int:
        """How often the combination can be taken."""
        return min(self.counts[x] // lengths.count(x) for x in lengths)

    def pair(self, total: int, most: int, taken: tuple[int, ...]) -> tuple[int, int] | None:
        """(a, b) with a + b = total and most >= a >= b, available beside ``taken``."""
        larger, i = self.pairs[total], self.pair_from[total]
        while i < len(larger) and not self.times((larger[i], total - larger[i])):
            i += 1
        self.pair_from[total] = i
        while i < len(larger) and larger[i] <= most:
            a = larger[i]
            if self.times((a, total - a, *taken)):
                return a, total - a
            i += 1
        return None

    def triple(self, total: int, taken: tuple[int, ...]) -> tuple[int, int, int] | None:
        """(a, b, c) with a + b + c = total and a >= b >= c, available beside ``taken``."""
        a = self.triple_from[total]
        while a < total - 1 and not (self.counts[a] and self.pair(total - a, a, (a,))):
            a += 1
        self.triple_from[total] = a
        while a < total - 1:
            if self.counts[a] and (two := self.pair(total - a, a, (a, *taken))):
                return a, *two
            a += 1
        return None

    def complement(self, top: int, gap: int) -> tuple[int, ...] | None:
        """One to three available lengths, the fewest, that exactly fill the gap beside ``top``."""
        if gap == 0:
            return ()
        if self.times((top, gap)):
            return (gap,)
        return self.pair(gap, gap - 1, (top,)) or self.triple(gap, (top,))

    def best_fit(self, top: int, gap: int) -> tuple[int, ...]:
        """The longest available length that fits in the gap beside ``top``, again and again."""
        found: list[int] = []
        self.counts[top] -= 1
        while gap > 0 and (x := next((x for x in range(gap, 0, -1) if self.counts[x] > 0), 0)):
            found.append(x)
            self.counts[x] -= 1
            gap -= x
        for x in (top, *found):
            self.counts[x] += 1
        return tuple(found)


def plan_packing(histogram: np.ndarray, capacity: int) -> Plan:
    """Combinations of lengths and how often to use each. ``histogram[n]``: pieces of n tokens.

    From the longest length down, exact fills are taken as often as the counts
    allow. A piece that has none is packed best-fit: at once if it is longer
    than half the capacity, so that exact fills of small pieces do not use up
    what only it can be filled with, else at the end.
    """
    counts = [int(n) for n in histogram]
    index = SumIndex(counts)
    plan: Plan = []

    def take(lengths: tuple[int, ...]) -> None:
        n = index.times(lengths)
        for x in lengths:
            counts[x] -= n
        plan.append((lengths, n))

    for top in range(capacity, 0, -1):
        while counts[top] > 0:
            rest = index.complement(top, capacity - top)
            if rest is None and 2 * top <= capacity:
                break
            take((top, *(index.best_fit(top, capacity - top) if rest is None else rest)))
    for top in range(capacity // 2, 0, -1):
        while counts[top] > 0:
            take((top, *index.best_fit(top, capacity - top)))
    return plan


def _placements(plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys length * _RANKS + first rank; the sequence of that rank; the offset in it."""
    rows, used, sequence = [], {}, 0
    for lengths, n in plan:
        at = 0
        for x in lengths:
            rank = used.get(x, 0)
            rows.append((x * _RANKS + rank, sequence, at))
            used[x] = rank + n
            at += x
        sequence += n
    rows.sort()
    return tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in range(3))


def pack_pieces(pieces: DataFrame, *, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to a table of pieces (columns of PIECES; it is read twice, so hand in a written one)."""
    histogram = np.zeros(capacity + 1, dtype=np.int64)
    for length, n in pieces.groupBy("length").agg(F.count(F.lit(1))).collect():  # capacity rows at most
        histogram[length] = n
    keys, sequences, offsets = _placements(plan_packing(histogram, capacity))
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    lots = (
        pieces.groupBy(*names).agg(F.count(F.lit(1)).alias("n"))
        .withColumn("lot", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LOT).cast("long"))))
        .withColumn("copies", F.least(F.lit(LOT).cast("long"), F.col("n") - F.col("lot") * LOT))
        .withColumn("bucket", F.pmod(F.xxhash64(*names, "lot"), F.element_at(literals(np.maximum(1, -(-histogram // BUCKET_PIECES)).tolist(), "long"), F.col("length").cast("int") + 1)))
    )
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "start", "ids_crc32", "lot").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    over = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lots = lots.withColumn("before", F.sum("copies").over(inside) - F.col("copies"))
    # rows of three numbers: one for each length, and one more for each BUCKET_PIECES pieces (8 MB for 10^11 pieces)
    sums = lots.groupBy("length", "bucket").agg(F.sum("copies").alias("n_bucket")).withColumn("base", F.sum("n_bucket").over(over) - F.col("n_bucket"))
    rank = F.col("base") + F.col("before")
    ranked = lots.join(F.broadcast(sums.select("length", "bucket", "base")), ["length", "bucket"]).withColumn("rank", F.explode(F.sequence(rank, rank + F.col("copies") - 1)))

    def place(batches):
        import pyarrow as pa

        for batch in batches:
            length, ranks = (batch.column(batch.schema.get_field_index(n)).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "rank"))
            at = np.searchsorted(keys, length * _RANKS + ranks, side="right") - 1
            columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
            columns += [pa.array(sequences[at] + (length * _RANKS + ranks - keys[at])), pa.array(offsets[at])]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "sequence_id", "offset"])

    return map_arrow(ranked.select(*names, "rank"), place, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, *, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """Packs all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, one row a piece.

    Null and empty texts are one end id; null and repeated ids are values like
    others (equal pieces are interchangeable); long texts are cut as
    ``pieces_of`` says; an empty table gives no rows; other columns are not
    read. To train, ``tokenize(..., with_ids=True)`` joined on doc_id, piece
    and ids_crc32 brings the ids of each place.
    """
    return pack_pieces(staged(tokenize(docs, capacity=capacity, tokenizer=tokenizer), "pieces"), capacity=capacity)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
