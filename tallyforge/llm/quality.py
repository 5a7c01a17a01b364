"""Quality rules with a line sequence labeller.

Base rules count words, symbols, repeated lines and repeated word windows over
the whole text. A linear-chain conditional random field labels every line that
has a word as content or boilerplate; Viterbi decoding gives the best
labelling, and the share of words in content lines decides whether a document
that passes the base rules is kept.
"""

from __future__ import annotations

import operator
import random
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import _OTHER_SPACE, WORD, map_arrow, map_rows

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
#: Percent of words in repeated windows above which the base rules reject.
MAX_REPEAT = 20
#: Least share of words in content lines.
MIN_CONTENT = 0.5
#: Bounds of the training sample: documents of each class, and code points of a document.
SAMPLE_DOCS, SAMPLE_CHARS = 300, 20_000

FEATURES = ("bias", "symbols", "pipes", "bangs", "repeats", "upper", "short", "ended", "seen", "long_words")
JUDGED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"


@dataclass(frozen=True)
class LineModel:
    """Weights of a line's features towards content, and of steps between labels (0 boilerplate, 1 content)."""

    weights: tuple[float, ...]
    steps: tuple[tuple[float, float], tuple[float, float]]


#: Used where a class has no labelled document: symbols, pipes, bangs and repeats speak against a line.
PRIOR = LineModel((2.0, -6.0, -6.0, -4.0, -6.0, -2.0, 0.0, 0.5, 0.0, -1.0), ((0.5, -0.5), (-0.5, 0.5)))


def line_features(line: str, words: list[str], seen: bool) -> tuple[float, ...]:
    """Features of a line with at least one word, in the order of FEATURES."""
    n = len(words)
    pipes = line.count("|")
    symbols = sum(map(line.count, SYMBOLS)) - pipes
    return (
        1.0,
        min(symbols / n, 2.0),
        min(pipes / n, 1.0),
        min(line.count("!") / n, 2.0),
        sum(map(operator.eq, words, words[1:])) / n,
        float(line.isupper()),
        float(n < 4),
        float(words[-1][-1] in ".!?"),
        float(seen),
        float(sum(map(len, words)) > 15 * n),
    )


def lines_of(text: str) -> Iterator[tuple[str, list[str], bool]]:
    """The lines with a word: line, its words, and whether an earlier line equals it."""
    split = WORD.findall if _OTHER_SPACE.search(text) else str.split
    before: set[str] = set()
    for line in text.split("\n"):
        if words := split(line):
            yield line, words, line in before
            before.add(line)


def viterbi(scores: list[float], steps) -> list[int]:
    """The best labels of a chain whose lines score ``scores`` for content and 0 for boilerplate."""
    (s00, s01), (s10, s11) = steps
    low, high = 0.0, scores[0]
    back: list[tuple[int, int]] = []
    for score in scores[1:]:
        a, b, c, d = low + s00, high + s10, low + s01, high + s11
        back.append((int(b > a), int(d >= c)))
        low, high = max(a, b), max(c, d) + score
    label = int(high >= low)
    labels = [label]
    for pair in reversed(back):
        label = pair[label]
        labels.append(label)
    return labels[::-1]


def fit(sequences: list[tuple[np.ndarray, np.ndarray]], *, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-2) -> LineModel:
    """Fits the field by its conditional likelihood (forward-backward, Adam). Each sequence: features (lines x FEATURES) and the label of each line."""
    # lines lie by their place in the document, longer documents first: the first k[t] documents have a line at place t
    sequences = sorted(sequences, key=lambda s: -len(s[0]))
    n, width = len(sequences), len(FEATURES)
    lengths = np.array([len(x) for x, _ in sequences])
    k = [int((lengths > t).sum()) for t in range(lengths[0])]
    at = np.r_[0, np.cumsum(k)]
    x = np.concatenate([[s[0][t] for s in sequences[: k[t]]] for t in range(lengths[0])])
    gold = np.concatenate([[s[1][t] for s in sequences[: k[t]]] for t in range(lengths[0])])
    owner = np.concatenate([np.arange(m) for m in k])
    share = 1 / lengths[owner]  # each document counts once
    later = np.arange(n, at[-1])  # lines with one before them, and those
    earlier = np.concatenate([np.arange(at[t - 1], at[t - 1] + k[t]) for t in range(1, len(k))]) if len(k) > 1 else later
    seen = [np.bincount(2 * gold[earlier] + gold[later] == i, weights=share[later], minlength=2)[1] for i in range(4)] if len(later) else [0.0] * 4
    theta, m, v = np.zeros(width + 4), np.zeros(width + 4), np.zeros(width + 4)
    for i in range(1, rounds + 1):
        w, steps = theta[:width], theta[width:].reshape(2, 2)
        local = np.stack([np.zeros(len(x)), x @ w], axis=1)
        forward, backward = local.copy(), np.zeros_like(local)
        for t in range(1, len(k)):
            past = forward[at[t - 1] : at[t - 1] + k[t]]
            forward[at[t] : at[t + 1]] += np.logaddexp(past[:, :1] + steps[0], past[:, 1:] + steps[1])
        for t in range(len(k) - 1, 0, -1):
            ahead = local[at[t] : at[t + 1]] + backward[at[t] : at[t + 1]]
            backward[at[t - 1] : at[t - 1] + k[t]] = np.logaddexp(steps[:, 0] + ahead[:, :1], steps[:, 1] + ahead[:, 1:])
        both = forward + backward
        whole = np.logaddexp(both[:n, 0], both[:n, 1])[owner]
        grad = np.zeros(width + 4)
        grad[:width] = ((gold - np.exp(both[:, 1] - whole)) * share) @ x
        for j in range(4):
            a, b = divmod(j, 2)
            p = np.exp(np.minimum(forward[earlier, a] + steps[a, b] + local[later, b] + backward[later, b] - whole[later], 0))
            grad[width + j] = seen[j] - p @ share[later]
        grad = grad / n - ridge * theta / width
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        theta = theta + rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    return LineModel(tuple(map(float, theta[:width])), tuple(tuple(map(float, r)) for r in theta[width:].reshape(2, 2)))


def features_of(text: str) -> np.ndarray:
    return np.array([line_features(*x) for x in lines_of(text)])


def line_labels(documents: list[tuple[np.ndarray, int]]) -> list[np.ndarray]:
    """Labels of lines, which the documents' labels leave open.

    The lines of a good document are content. In a bad one they are
    boilerplate except those that a field of single lines, fitted to the
    documents' labels, takes for content; the line that looks least like
    content stays boilerplate.
    """
    lines = [(x[i : i + 1], np.array([y])) for x, y in documents for i in range(len(x))]
    # one line a sequence; every document counts once, as in the field
    repeated = fit_lines(np.concatenate([x for x, _ in lines]), np.concatenate([y for _, y in lines]), np.concatenate([np.full(len(x), 1 / len(x)) for x, _ in documents]))
    out = []
    for x, y in documents:
        scores = x @ repeated
        own = np.full(len(x), 1) if y else (scores > 0).astype(np.int64)
        if not y:
            own[int(scores.argmin())] = 0
        out.append(own)
    return out


def fit_lines(x: np.ndarray, y: np.ndarray, share: np.ndarray, *, rounds: int = 200, rate: float = 0.1, ridge: float = 1e-2) -> np.ndarray:
    """Weights of single lines towards content: logistic regression in which line i counts ``share[i]``."""
    w, m, v = np.zeros(x.shape[1]), np.zeros(x.shape[1]), np.zeros(x.shape[1])
    for k in range(1, rounds + 1):
        grad = ((y - 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))) * share) @ x / share.sum() - ridge * w / len(w)
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return w


def spliced(texts: list[str], labels: list[np.ndarray], n: int, seed: int = 0) -> list[tuple[str, np.ndarray]]:
    """``n`` documents with known changes of label: runs of one to six lines, content from the one class's lines and boilerplate from the other's, in turn."""
    pools: tuple[list[list[str]], list[list[str]]] = ([], [])
    for text, own in zip(texts, labels, strict=True):
        lines = [line for line, _, _ in lines_of(text)]
        for label in (0, 1):
            if some := [x for x, y in zip(lines, own, strict=True) if y == label]:
                pools[label].append(some)
    out = []
    rng = random.Random(seed)
    for _ in range(n if all(pools) else 0):
        label, lines, gold = rng.randrange(2), [], []
        for _ in range(rng.randrange(2, 6)):
            source = rng.choice(pools[label])
            at = rng.randrange(len(source))
            run = source[at : at + rng.randrange(1, 7)]
            lines += run
            gold += [label] * len(run)
            label = 1 - label
        out.append(("\n".join(lines), np.array(gold)))
    return out


def train(docs: DataFrame, labels: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> LineModel:
    """Fits on a bounded sample of labelled documents: up to ``sample_docs`` of each quality, none longer than ``sample_chars``.

    The sample is the same on every run: ids in the order of their hash.
    Labels of lines come from ``line_labels``; as many documents again are
    spliced from the lines of both classes, so that the field sees where labels
    change. PRIOR is used if one of the classes has no document with a word.
    Null ids, texts and labels are passed over; repeated rows are repeated in
    the sample; other columns are not read.
    """
    hashed = (F.xxhash64("doc_id"), F.col("doc_id"))
    by_id: dict[int, int] = {}
    for quality in (0, 1):
        ids = labels.filter((F.col("quality") == quality) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct().orderBy(*hashed).limit(sample_docs)
        by_id |= {r.doc_id: quality for r in ids.collect() if r.doc_id not in by_id}
    if len(set(by_id.values())) < 2:
        return PRIOR
    short = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter(F.col("doc_id").isin(list(by_id)) & (F.length("text") <= sample_chars))
    rows = short.orderBy(*hashed, F.md5("text")).limit(2 * sample_docs).collect()
    return model_of([(r.text, by_id[r.doc_id]) for r in rows])


def model_of(documents: list[tuple[str, int]]) -> LineModel:
    """The field fitted to texts and their quality."""
    known = [(t, x, y) for t, y in documents if len(x := features_of(t))]
    if len({y for _, _, y in known}) < 2:
        return PRIOR
    labels = line_labels([(x, y) for _, x, y in known])
    made = spliced([t for t, _, _ in known], labels, len(known))
    return fit([(x, own) for (_, x, _), own in zip(known, labels, strict=True)] + [(features_of(t), own) for t, own in made])


def count_repeats(words: list[str]) -> int:
    """Words inside windows of five words that occur twice or more in the text.

    Windows are compared by a hash first. Without equal hashes there are no
    equal windows; the windows of equal hashes are compared as words.
    """
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + ids[i : i + n]
            mixed ^= mixed >> np.uint64(29)
    order = np.argsort(mixed, kind="stable")
    same = mixed[order][1:] == mixed[order][:-1]
    if not same.any():
        return 0
    suspects = np.zeros(n, bool)
    suspects[order[1:][same]] = suspects[order[:-1][same]] = True
    places: dict[tuple[str, ...], list[int]] = {}
    for i in np.flatnonzero(suspects).tolist():
        places.setdefault(tuple(words[i : i + WINDOW]), []).append(i)
    covered = np.zeros(len(words) + 1, np.int32)
    for at in places.values():
        if len(at) > 1:
            covered[at] += 1
            covered[np.array(at) + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(covered[:-1])))


def judge(text: str, model: LineModel, min_content: float = MIN_CONTENT) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, content_share, kept of a text."""
    words: list[str] = []
    scores: list[float] = []
    sizes: list[int] = []
    n_seen = 0
    for line, own, seen in lines_of(text):
        words += own
        n_seen += seen
        sizes.append(len(own))
        scores.append(sum(map(operator.mul, model.weights, line_features(line, own, seen))))
    repeats = count_repeats(words)
    failed = len(words) < MIN_WORDS or 100 * repeats > MAX_REPEAT * len(words)
    share = sum(n for n, label in zip(sizes, viterbi(scores, model.steps), strict=True) if label) / len(words) if words else 0.0
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), n_seen, repeats, failed, share, not failed and share >= min_content


def judge_quality(docs: DataFrame, model: LineModel, *, min_content: float = MIN_CONTENT) -> DataFrame:
    """Judges every document: the columns of JUDGED.

    Null and empty texts have no words and fail the base rules; null ids and
    repeated rows are judged row by row; long texts are read whole; an empty
    table gives no rows; other columns are not read. ``kept`` is
    false if the base rules fail, else the field's verdict.
    """

    def run(rows):
        for doc, text in rows:
            yield (doc, *judge(text or "", model, min_content))

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, JUDGED)


def keep_quality(docs: DataFrame, model: LineModel, *, min_content: float = MIN_CONTENT) -> DataFrame:
    """The documents that are kept (see ``judge_quality``), with all their columns, in one pass and without a shuffle.

    Null and empty texts go; very long texts are labelled whole, line by line,
    each in one task; null ids and repeated rows are judged row by row; an
    empty table stays empty; no column is added, so none can clash.
    """
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                texts = part.column(part.schema.get_field_index("text")).to_pylist()
                yield part.filter(pa.array([judge(t or "", model, min_content)[-1] for t in texts], pa.bool_()))

    return map_arrow(docs, run, docs.schema)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return judge_quality(docs, train(docs, labels)).drop("content_share")
