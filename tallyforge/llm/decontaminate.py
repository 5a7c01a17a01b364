"""Benchmark decontamination under word edit distance.

Benchmark items and item-sized windows of documents are strings of words. A
CGK random walk embeds such a string so that its edit distance shows as a
Hamming distance; hashes of sampled positions of the embedding, over several
walks, meet the items' hashes, and the exact edit distance decides.

The Hamming distance grows with the square of the edits, so a long item would
need ever more repetitions. It is searched by its parts instead: of p parts of
an item within k edits, one is within k // p, whichever edits they are; windows
of its size are embedded, and where one meets it, the whole item is verified.

Windows that cannot be near a part are ruled out before they are embedded:
a string of n words within k edits of a part has at least n - 1 - 2k of its
n - 1 pairs of adjacent words among the part's pairs, which a running sum of
the pairs known from all parts tells for every window at once.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_arrow, map_rows, words_of
from tallyforge.llm.jaccard import _mixed

#: Edits allowed, as a share of the item's words (rounded down).
EDIT_SHARE = 0.2
TARGET_RECALL = 0.99
#: Positions of the embedding that a hash samples.
SAMPLED = 3
#: Items of more words are searched by near equal parts of at most so many.
PART_WORDS = 19
#: Items sent to executors at once; more are searched in several passes over the documents.
ITEMS_AT_ONCE, ITEM_WORDS_AT_ONCE = 20_000, 500_000
#: Characters that a word loses at its ends before it is lower-cased.
EDGES = ".,;:!?\"'()[]{}<>#*$%&|`~^_=+/\\-"
HITS = "doc_id long, text_hash long, item_id long, distance int, start_word int, end_word int"


class NormalHashes(dict):
    """64-bit hashes of normalized words by raw word; words of symbols only keep their symbols."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= 150_000:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest((word.strip(EDGES) or word).lower())
        return found


_HASHES = NormalHashes()


def word_ids(text: str) -> np.ndarray:
    words = words_of(text)
    return np.fromiter(map(_HASHES.__getitem__, words), np.uint64, len(words))


def _pairs(ids: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mixed(ids[:-1] * np.uint64(3) + ids[1:])


class Walks:
    """The CGK walks of one repetition over words that lie one after another.

    ``at[step, i]`` is how far the walk from start i has come before ``step``.
    A walk writes the word it stands on and moves on if the random bit of this
    step and word is set; beyond its window it writes 0. All walks share the
    bits, so after equal words two walks can fall into step again. Until it
    leaves its window a walk does not depend on the window's size, so windows
    of all sizes at one start share it.
    """

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray, n_steps: int, repetition: int):
        self.words, self.starts, self.ends = words, starts, ends
        self.at = np.empty((n_steps, len(starts)), np.int64)
        place = starts.copy()
        with np.errstate(over="ignore"):
            for step in range(n_steps):
                self.at[step] = place
                bit = np.uint64((repetition * 1_000_003 + step) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                place = place + (_mixed(words[np.minimum(place, ends - 1)] + bit) >> np.uint64(63)).astype(np.int64)

    def symbols(self, rows: np.ndarray, sizes: np.ndarray, steps: np.ndarray) -> np.ndarray:
        """What the walks of these rows write at ``steps`` (one row of steps each) in windows of these sizes."""
        place = self.at[steps, rows[:, None]]
        inside = place < np.minimum(self.starts[rows] + sizes, self.ends[rows])[:, None]
        return np.where(inside, self.words[np.where(inside, place, 0)], np.uint64(0))


def sampled_steps(size: int, repetition: int) -> np.ndarray:
    """The positions that this repetition samples of an embedding: of its first 2 * size steps, where walks are still in their windows."""
    return np.sort(np.random.default_rng([repetition, size]).choice(2 * size, size=min(SAMPLED, 2 * size), replace=False))


def window_keys(walks: Walks, rows: np.ndarray, sizes: np.ndarray, steps: np.ndarray, repetition: int) -> np.ndarray:
    """One LSH key for each window: its size and the symbols at its sampled steps."""
    symbols = walks.symbols(rows, sizes, steps)
    key = sizes.astype(np.uint64) * np.uint64(1009) + np.uint64(repetition)
    with np.errstate(over="ignore"):
        for i in range(symbols.shape[1]):
            key = _mixed(key + symbols[:, i])
    return key


def repetitions_for(edits: int, size: int, target: float = TARGET_RECALL) -> int:
    """How many repetitions find a window of up to PART_WORDS words at ``edits`` with probability ``target``, whatever kind the edits are.

    Each edit takes about 2.4 positions in ``size`` out of step until the walks
    meet again. Half as many again are made because walks differ: deletions,
    the worst kind, need so many (measured on random strings; tests hold the
    recall for each size and kind at the full number of edits).
    """
    agree = max(0.3, 1 - 2.4 * edits / size) ** SAMPLED
    return math.ceil(1.5 * math.log(1 - target) / math.log(1 - agree)) if agree < 1 else 1


def parts_of(size: int) -> tuple[list[int], int]:
    """Where the parts of an item of ``size`` words begin and end, and the edits allowed in one of them."""
    n = -(-size // PART_WORDS)
    return [size * i // n for i in range(n + 1)], edits_allowed(size) // n


def occurs(item: list[int], words: list[int], most: int) -> bool:
    """Whether some run of ``words`` is within ``most`` edits of the item (one step of word-wide operations for each word)."""
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(item):
        where[x] |= 1 << j
    n = len(item)
    every, last = (1 << n) - 1, 1 << n - 1
    up, down, score = every, 0, n
    if score <= most:
        return True
    for word in words:
        same = where.get(word, 0)
        vertical = same | down
        level = (((same & up) + up) ^ up) | same
        more, less = down | ~(level | up) & every, up & level
        score += bool(more & last) - bool(less & last)
        if score <= most:
            return True
        more, less = more << 1 & every, less << 1 & every
        up, down = less | ~(vertical | more) & every, more & vertical
    return False


def nearest_run(item: list[int], words: list[int], most: int) -> tuple[int, int, int] | None:
    """The least (distance, start, end) over all runs of ``words``, by edit distance to the item, if at most ``most``."""
    distance, origin = list(range(len(item) + 1)), [0] * (len(item) + 1)
    found = (distance[-1], 0, 0) if distance[-1] <= most else None
    for end, word in enumerate(words, 1):
        d, o = 0, end
        before, before_from = distance[0], origin[0]
        distance[0], origin[0] = 0, end
        for j, x in enumerate(item, 1):
            best, start = before + (x != word), before_from
            up, up_from = distance[j] + 1, origin[j]
            if up < best or up == best and up_from < start:
                best, start = up, up_from
            if d + 1 < best or d + 1 == best and o < start:
                best, start = d + 1, o
            before, before_from = distance[j], origin[j]
            distance[j], origin[j] = d, o = best, start
        if d <= most and (found is None or (d, o, end) < found):
            found = (d, o, end)
    return found


@dataclass
class Index:
    """Items by id and what finds them. A kind is a size of parts and the edits allowed in one."""

    ids: list[int]
    words: list[np.ndarray]
    #: Sorted pairs of words, with a bit table of them, and the kinds of parts (a bit each) that each pair is in.
    pairs: np.ndarray
    bits: np.ndarray
    kinds_of: np.ndarray
    #: Items of one word by that word.
    singles: dict[int, list[int]]
    #: The kinds, by size; of each, the edits and repetitions.
    sizes: np.ndarray
    edits: np.ndarray
    repetitions: np.ndarray
    #: Item, and place in it, of each part.
    owner: np.ndarray
    offset: np.ndarray
    #: For each repetition the sampled steps by kind, and the sorted keys with the part of each.
    steps: list[np.ndarray]
    keys: list[tuple[np.ndarray, np.ndarray]]
    #: Known pairs that some block of the least size has in every window that can be near a part.
    least: int

    def needed(self, kind: int) -> int:
        """Least number of a part's pairs in a window within the edits allowed."""
        return max(1, int(self.sizes[kind] - 1 - 2 * self.edits[kind]))


def edits_allowed(size: int, share: float = EDIT_SHARE) -> int:
    return math.floor(size * share + 1e-9)


def index_of(items: list[tuple[int, str]]) -> Index:
    """The index of (item_id, text) pairs; items without words are left out."""
    known = [(i, w) for i, t in items if len(w := word_ids(t or ""))]
    words = [w for _, w in known]
    singles: dict[int, list[int]] = defaultdict(list)
    parts: list[tuple[int, int, int, int]] = []  # size, edits, item, place
    for k, w in enumerate(words):
        if len(w) == 1:
            singles[int(w[0])].append(k)
            continue
        bounds, edits = parts_of(len(w))
        parts += [(b - a, edits, k, a) for a, b in zip(bounds, bounds[1:], strict=False)]
    kinds = sorted({p[:2] for p in parts})  # fewer than 64: sizes up to PART_WORDS, with up to three numbers of edits
    sizes, edits = (np.array([k[i] for k in kinds], np.int64) for i in (0, 1))
    repetitions = np.array([repetitions_for(e, n) for n, e in kinds], np.int64)
    kind = np.array([kinds.index(p[:2]) for p in parts], np.int64)
    owner, offset = (np.array([p[i] for p in parts], np.int64) for i in (2, 3))
    steps, keys = [], []
    pairs, kinds_of = np.empty(0, np.uint64), np.empty(0, np.uint64)
    if parts:
        cut = [words[k][a : a + n] for n, _, k, a in parts]
        own = sizes[kind]
        every = np.concatenate([_pairs(w) for w in cut])
        pairs, place = np.unique(every, return_inverse=True)
        kinds_of = np.zeros(len(pairs), np.uint64)
        np.bitwise_or.at(kinds_of, place, np.uint64(1) << np.repeat(kind, own - 1).astype(np.uint64))
        flat, ends = np.concatenate(cut), np.cumsum(own)
        for r in range(int(repetitions.max())):
            steps.append(np.array([sampled_steps(n, r) for n, _ in kinds]))
            used = np.flatnonzero(repetitions[kind] > r)
            walks = Walks(flat, ends - own, ends, int(2 * sizes[-1]), r)
            found = window_keys(walks, used, own[used], steps[-1][kind[used]], r)
            order = np.argsort(found, kind="stable")
            keys.append((found[order], used[order]))
    index = Index([i for i, _ in known], words, pairs, _bits(pairs), kinds_of, dict(singles), sizes, edits, repetitions, owner, offset, steps, keys, 1)
    index.least = min((-(-index.needed(i) // -(-int(n) // int(sizes[0]))) for i, n in enumerate(sizes)), default=1)
    return index


def _bits(known: np.ndarray) -> np.ndarray:
    table = np.zeros(1 << max(16, int(len(known) * 32).bit_length()), bool)
    table[(known & np.uint64(len(table) - 1)).astype(np.int64)] = True
    return table


def _known(values: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values that are pairs of items, and which pairs; the bit table rules most others out first."""
    at = np.flatnonzero(index.bits[(values & np.uint64(len(index.bits) - 1)).astype(np.int64)])
    pair = np.minimum(np.searchsorted(index.pairs, values[at]), len(index.pairs) - 1)
    good = index.pairs[pair] == values[at]
    return at[good], pair[good]


def likely_windows(ids: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(start, kind) of the windows with enough pairs of parts of their kind.

    None that can be near a part is left out. A window of n words holds at
    most ceil(n / m) blocks of the least size m, so one of them has that share
    of the pairs needed: a running sum over the pairs of all items finds the
    few starts where any size can do. A document shorter than a part is one
    window.
    """
    none = np.empty(0, np.int64)
    n = len(ids)
    if n < 2 or not len(index.pairs):
        return none, none
    at, pair = _known(_pairs(ids), index)
    m = int(index.sizes[0])
    if len(at) < index.least:
        return none, none
    ahead = np.searchsorted(at, at + m - 1)  # the first known pair after a block that begins at a known pair
    if (ahead - np.arange(len(at))).max() < index.least:
        return none, none
    runs = np.zeros(n + 1, np.int64)
    runs[at + 1] = 1
    runs = np.cumsum(runs)[:n]
    dense = runs[np.minimum(np.arange(n) + m - 1, n - 1)] - runs >= index.least
    near = dense.copy()
    for block in range(1, -(-int(index.sizes[-1]) // m)):
        near[: max(0, n - block * m)] |= dense[block * m :]
    starts = np.flatnonzero(near)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for i, size in enumerate(index.sizes.tolist()):
        own = at[index.kinds_of[pair] >> np.uint64(i) & np.uint64(1) == 1]
        if len(own) < index.needed(i):
            continue
        ends = np.minimum(starts + size, n)
        enough = np.searchsorted(own, ends - 1) - np.searchsorted(own, starts) >= index.needed(i)
        good = starts[enough & (ends - starts >= size - int(index.edits[i]))]
        found.append((good, np.full(len(good), i)))
    return (np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])) if found else (none, none)


def candidates(docs: list[np.ndarray], windows: list[tuple[np.ndarray, np.ndarray]], index: Index) -> dict[tuple[int, int], set[int]]:
    """(document, item) -> where the item would start by the windows that share an LSH key with one of its parts, over all repetitions of its kind."""
    found: dict[tuple[int, int], set[int]] = defaultdict(set)
    first = np.r_[0, np.cumsum([len(d) for d in docs])]
    start = np.concatenate([s + first[i] for i, (s, _) in enumerate(windows)])
    place = np.concatenate([p for _, p in windows])
    doc = np.repeat(np.arange(len(docs)), [len(s) for s, _ in windows])
    if not len(start):
        return found
    flat = np.concatenate(docs)
    own, rows = np.unique(start, return_inverse=True)
    ends = first[np.searchsorted(first, own, side="right")]
    sizes = index.sizes[place]
    for r, (keys, parts) in enumerate(index.keys):
        live = np.flatnonzero(index.repetitions[place] > r)
        if not len(live):
            break
        walks = Walks(flat, own, ends, int(2 * sizes[live].max()), r)
        key = window_keys(walks, rows[live], sizes[live], index.steps[r][place[live]], r)
        low, high = np.searchsorted(keys, key), np.searchsorted(keys, key, side="right")
        for j in np.flatnonzero(high > low).tolist():
            w = live[j]
            for part in parts[low[j] : high[j]].tolist():
                found[int(doc[w]), int(index.owner[part])].add(int(start[w] - first[doc[w]] - index.offset[part]))
    return found


def nearest(item: np.ndarray, ids: np.ndarray, starts: set[int]) -> tuple[int, int, int] | None:
    """The least (distance, start, end) of the item against runs of words around these starts, if within the edits allowed."""
    n = len(item)
    most = edits_allowed(n)
    ordered = sorted(starts)
    first, last_word = item[0], item[-1]
    for start in ordered:
        if 0 <= start and start + n <= len(ids) and ids[start] == first and ids[start + n - 1] == last_word and np.array_equal(ids[start : start + n], item):
            return 0, start, start + n
    found = None
    at = 0
    while at < len(ordered):  # starts that lie close together are searched as one stretch
        last = at
        while last + 1 < len(ordered) and ordered[last + 1] - ordered[last] <= n:
            last += 1
        low, high = max(0, ordered[at] - most), min(len(ids), ordered[last] + n + most)
        near = None
        # all but ``most`` of the item's words stand in a stretch that holds it
        if np.count_nonzero(np.isin(item, ids[low:high])) >= n - most:
            words = ids[low:high].tolist()
            near = nearest_run(item.tolist(), words, most) if occurs(item.tolist(), words, most) else None
        if near and (found is None or (near[0], near[1] + low, near[2] + low) < found):
            found = (near[0], near[1] + low, near[2] + low)
        at = last + 1
    return found


def search(docs: list[np.ndarray], windows: list[tuple[np.ndarray, np.ndarray]], index: Index) -> list[dict[int, tuple[int, int, int]]]:
    """For each document its items: (distance, start, end) of the nearest run of words."""
    best: list[dict[int, tuple[int, int, int]]] = [{} for _ in docs]
    if index.singles:
        for ids, own in zip(docs, best, strict=True):
            for i in np.flatnonzero(np.isin(ids, np.fromiter(index.singles, np.uint64)))[::-1].tolist():
                own.update({k: (0, i, i + 1) for k in index.singles[int(ids[i])]})
    for (doc, item), starts in candidates(docs, windows, index).items():
        if hit := nearest(index.words[item], docs[doc], starts):
            best[doc][item] = hit
    return best


def search_stream(rows: Iterator[tuple], index: Index, *, windows_at_once: int = 20_000, words_at_once: int = 2_000_000) -> Iterator[tuple[tuple, dict[int, tuple[int, int, int]]]]:
    """(row, items found) for rows whose last column is a text, in order; documents wait until there is enough for one set of walks."""
    held: list[tuple] = []
    words = n = 0
    for row in rows:
        ids = word_ids(row[-1] or "")
        windows = likely_windows(ids, index)
        useful = len(windows[0]) > 0 or bool(index.singles)
        held.append((row[:-1], ids if useful else ids[:0], windows))
        words, n = words + len(held[-1][1]), n + len(windows[0])
        if n >= windows_at_once or words >= words_at_once or len(held) >= 20_000:
            yield from _searched(held, index)
            held, words, n = [], 0, 0
    yield from _searched(held, index)


def _searched(held: list[tuple], index: Index) -> Iterator[tuple]:
    if held:
        yield from zip([h[0] for h in held], search([h[1] for h in held], [h[2] for h in held], index), strict=True)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item found in it: the columns of HITS, one per item, the nearest window.

    An item is found where a run of the document's words is within a fifth of
    the item's words of it by edit distance, words compared in lower case
    without punctuation at their ends. The windows searched start at every
    word; words are counted from 0, end exclusive.

    Very long texts are searched whole, each in one task whose memory grows
    with the text. Null, empty and white-space texts, of documents or items,
    have no words and no rows; items of one word are found exactly; repeated items and rows give
    repeated rows; null ids are kept; either table may be empty; other columns
    are not read. Items go to executors in parts of bounded size; a larger
    benchmark means more passes over the documents.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text_hash"), F.col("text").cast("string").alias("text"))
    found = None
    for part in _parts(benchmark):
        index = index_of(part)
        if not index.ids:
            continue
        hits = map_rows(rows, _searcher(index), HITS)
        found = hits if found is None else found.unionByName(hits)
    return docs.sparkSession.createDataFrame([], HITS) if found is None else found


def _searcher(index: Index):
    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for (doc, text_hash), items in search_stream(rows, index):
            for item, (distance, start, end) in sorted(items.items()):
                yield doc, text_hash, index.ids[item], distance, start, end

    return run


def _parts(benchmark: DataFrame) -> Iterator[list[tuple[int, str]]]:
    """The items, read row by row on the driver, in parts of bounded count and words."""
    held: list[tuple[int, str]] = []
    words = 0
    for item, text in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).toLocalIterator():
        held.append((item, text or ""))
        words += len(words_of(text or ""))
        if len(held) >= ITEMS_AT_ONCE or words >= ITEM_WORDS_AT_ONCE:
            yield held
            held, words = [], 0
    if held:
        yield held


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents in which no benchmark item is found (see ``find_leaks``), with all their columns, in one pass and without a shuffle.

    Very long texts are searched whole, each in one task. Null and empty texts,
    null ids and repeated rows stay as they are; either table may be empty; no column is added, so none can clash.
    """
    import pyarrow as pa

    kept = docs
    for part in _parts(benchmark):
        index = index_of(part)
        if not index.ids:
            continue

        def run(batches, index=index):
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text"))
                rows = ((t,) for at in range(0, batch.num_rows, 256) for t in texts.slice(at, 256).to_pylist())
                yield batch.filter(pa.array([not items for _, items in search_stream(rows, index)], pa.bool_()))

        kept = map_arrow(kept, run, docs.schema)
    return kept


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return find_leaks(docs, benchmark).select("doc_id", "item_id", "distance", "start_word", "end_word")
