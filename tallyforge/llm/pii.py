"""Personal data: base patterns and a skip-chain conditional random field.

Base patterns find emails, IP addresses, card and phone numbers. Everything
that looks a little like one of them is a node of a field: spans of the base
patterns are observed, the others have evidence from their shape. Neighbours in
the text are linked, and so are distant nodes with the same content, through
one hub for each content, so a value that occurs ten thousand times adds ten
thousand links and not their square. Contents one edit apart, such as a number
with a digit wrong or a trunk zero for its country code, are linked through
hubs of what is left of both without a character. Loopy message passing then
makes labels consistent across the document: a number written once as a phone
number is one where it lacks its plus sign too.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_arrow, map_rows

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Characters of the parts of an email address.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_HOST = re.compile(r"[A-Za-z0-9-]+")
# an address can only begin where a run of digits begins, so later starts in the run need no try
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"\+?\(?[0-9](?:[\x20().-]{0,2}[0-9])+")
_ANY = re.compile("[0-9@]")
#: Numbers with fewer digits are no nodes.
LEAST_DIGITS = 7
#: Neighbours further apart than so many code points are not linked.
NEAR = 40
#: Belief from which a node that is no base span gets its label.
CERTAIN = 0.8
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 20_000
FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"

Span = tuple[int, int, str]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str, tail: re.Pattern) -> Iterator[tuple[int, int]]:
    """Matches of local part, ``@`` and ``tail``: what the pattern finds, in time linear in the text."""
    end = at = 0
    while (at := text.find("@", at)) >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := tail.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = max(at + 1, end)


def base_spans(text: str) -> list[Span]:
    """The spans (start, end, kind) of the base patterns, by start and then kind as listed."""
    if not _ANY.search(text):
        return []
    spans = [(a, b, "email") for a, b in _emails(text, _DOMAIN)]
    spans += [(*m.span(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(digits := _digits(m[0])) <= 19 and luhn(digits):
            spans.append((*m.span(), "card"))
    spans += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def other_nodes(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Spans that look like personal data and touch no base span: numbers of LEAST_DIGITS digits and names at hosts.

    A run of more than 19 digits is several numbers in a row. Its groups of
    digits are joined wherever that gives a number that stands elsewhere in
    the text; else it is cut at spaces.
    """
    if not _ANY.search(text):
        return []
    found = list(_emails(text, _HOST))
    runs: list[tuple[int, str]] = []
    for m in _NUMBER.finditer(text):
        if (n := len(_digits(m[0]))) > 19:
            runs.append((m.start(), m[0]))
        elif n >= LEAST_DIGITS:
            found.append(m.span())
    if runs:
        known = {content_key(text[a:b]) for a, b, _ in base} | {content_key(text[a:b]) for a, b in found}
        for start, run in runs:
            found += [(start + a, start + b) for a, b in _numbers_of_run(run, known)]
    out: list[tuple[int, int]] = []
    taken = sorted((a, b) for a, b, _ in base)
    i, reach = 0, -1
    for a, b in sorted(found):
        while i < len(taken) and taken[i][0] < b:
            reach = max(reach, taken[i][1])
            i += 1
        if reach <= a:
            out.append((a, b))
            reach = max(reach, b)
    return out


def _numbers_of_run(run: str, known: set[str]) -> Iterator[tuple[int, int]]:
    """Where numbers with a known content stand in a run of groups of digits, from the left; of what is between, the words at spaces with LEAST_DIGITS digits."""
    groups = [m.span() for m in re.finditer("[0-9]+", run)]

    def between(low: int, high: int) -> Iterator[tuple[int, int]]:
        for w in re.finditer(r"[^\x20]+", run[low:high]):
            if len(_digits(w[0])) >= LEAST_DIGITS:
                yield low + w.start(), low + w.end()

    at = free = 0
    for j, (_, end) in enumerate(groups):
        digits, best = 0, (0, -1)
        for i in range(j, free - 1, -1):
            digits += groups[i][1] - groups[i][0]
            if digits > 19:
                break
            if digits >= LEAST_DIGITS and (key := content_key(run[groups[i][0] : end])) in known:
                best = (len(key), i) if len(key) > best[0] else best
        if best[1] >= 0:
            yield from between(at, groups[best[1]][0])
            yield groups[best[1]][0], end
            at, free = end, j + 1
    yield from between(at, len(run))


def shape(span: str) -> list[float]:
    """Evidence of a node's own text."""
    digits = _digits(span)
    n = len(digits)
    parts = span.split(".")
    dotted = len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts)
    at = "@" in span
    return [
        1.0,
        float(at),
        float(at and "." in span.rpartition("@")[2]),
        float(not at and dotted),
        float(dotted and all(len(p) < 10 and int(p) <= 255 for p in parts)),
        float(span.startswith("+")),
        float(not at and 9 <= n <= 15),
        float(not at and not dotted and 12 <= n <= 19),
        float(not at and 12 <= n <= 19 and luhn(digits)),
        float("(" in span),
    ]


N_SHAPE = 10


def content_key(span: str) -> str:
    """Equal for nodes with the same content written alike or nearly alike: local part and host, or the last ten digits."""
    if "@" in span:
        local, _, host = span.lower().partition("@")
        return f"{local}@{host.partition('.')[0]}"
    return _digits(span)[-10:]


#: Longest content, in characters, that has links to contents one edit apart: an address's local part has 64 at most, and the keys of one
#: content take the square of its length in memory. Longer ones have links to equal contents only.
LONGEST_NEAR = 64


def left_without(key: str) -> set[str]:
    """A content key and what is left of it without one character: keys one edit apart have one of these in common. Short and very long keys have none."""
    return {key, *(key[:i] + key[i + 1 :] for i in range(len(key)))} if LEAST_DIGITS <= len(key) <= LONGEST_NEAR else set()


@dataclass(frozen=True)
class Field:
    """Weights of shapes towards labels, and log potentials of neighbours, of equal contents and of contents one edit apart."""

    weights: np.ndarray
    chain: np.ndarray
    same: float
    near: float


def _nodes(text: str) -> tuple[list[Span], list[tuple[int, int, int]]]:
    """Base spans; all nodes in order as (start, end, label), -1 where the label is open."""
    base = base_spans(text)
    nodes = [(a, b, LABELS.index(k)) for a, b, k in base] + [(a, b, -1) for a, b in other_nodes(text, base)]
    return base, sorted(nodes)


def _fit_shapes(x: np.ndarray, y: np.ndarray, rounds: int, ridge: float) -> np.ndarray:
    weights = np.zeros((N_SHAPE, len(LABELS)))
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    for k in range(1, rounds + 1):
        z = x @ weights
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        grad = x.T @ (y - p) / len(x) - ridge * weights
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        weights += 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
    return weights


def fit_potential(agree: list[float], differ: list[float]) -> float:
    """The potential under which links are likeliest: ``agree`` and ``differ`` are what speaks for another label in nodes that share, or do not share, the label at the other end.

    One pair of each outcome is added, of average evidence; without pairs the potential is nothing.
    """
    if not agree:
        return 0.0
    middle = float(np.mean(agree))
    a, d = np.array([*agree, middle]), np.array([*differ, middle])
    grid = np.linspace(0, 30, 301)
    likelihood = [-np.logaddexp(0, a - s).sum() - np.logaddexp(0, s - d).sum() for s in grid]
    return float(grid[int(np.argmax(likelihood))])


def fit(texts: list[str], *, rounds: int = 300, ridge: float = 1e-3) -> Field:
    """Piecewise training: shapes by logistic regression, neighbours by their counts, links between contents by the likelihood of masked copies.

    Base spans have their kind as label, other nodes have none. For each base
    phone number a copy without its plus sign is shown as no phone number,
    because that is what its shape alone says. The same copy stands for an
    entity mentioned twice: it has the label of the number that it was made
    of, so the potential of equal contents is fitted to such pairs, and to
    equal contents with different base labels. That of contents one edit apart
    is fitted to copies with the last digit changed, and to the base spans one
    edit from a node that is none.
    """
    rows, gold, copies = [], [], []
    steps = np.ones((len(LABELS), len(LABELS)))
    same: list[tuple[str, int, bool]] = []
    near: list[tuple[str, int, bool]] = []
    for text in texts:
        _, nodes = _nodes(text)
        by_key: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for a, b, label in nodes:
            label = max(label, 0)
            own = text[a:b]
            rows.append(shape(own))
            gold.append(label)
            if LABELS[label] == "phone":
                copies.append((own[1:], label))
            by_key[content_key(own)].append((own, label))
        for (_, end, one), (start, _, two) in zip(nodes, nodes[1:], strict=False):
            if start - end <= NEAR:
                steps[max(one, 0), max(two, 0)] += 1
        for found in by_key.values():
            same += [(own, found[0][1], label == found[0][1]) for own, label in found[1:] if label and found[0][1]]
        by_rest: dict[str, set[str]] = defaultdict(set)
        for key in by_key if len(by_key) > 1 else ():
            for rest in left_without(key):
                by_rest[rest].add(key)
        for keys in by_rest.values():
            labels = {by_key[k][0][1] for k in keys}
            if len(keys) > 1 and len(labels) == 2 and 0 in labels:
                near += [(by_key[k][0][0], max(labels), False) for k in keys if by_key[k][0][1] == 0]
    weights = np.zeros((N_SHAPE, len(LABELS)))
    if rows:
        shown = [shape(own) for own, _ in copies]
        weights = _fit_shapes(np.array(rows + shown), np.eye(len(LABELS))[gold + [0] * len(shown)], rounds, ridge)

    def against(own: str, label: int) -> float:
        scores = np.array(shape(own)) @ weights
        return float(np.logaddexp.reduce(np.delete(scores, label)) - scores[label])

    same += [(own, label, True) for own, label in copies]
    near += [(own[:-1] + str((int(own[-1]) + 1) % 10), label, True) for own, label in copies]
    joint = steps / steps.sum()
    chain = np.log(joint / (joint.sum(1, keepdims=True) * joint.sum(0, keepdims=True)))
    potentials = [fit_potential([against(o, k) for o, k, yes in pairs if yes], [against(o, k) for o, k, yes in pairs if not yes]) for pairs in (same, near)]
    return Field(weights, np.clip(chain, -1, 1), *potentials)


def train(docs: DataFrame, *, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Field:
    """Fits on a bounded sample: up to ``sample_docs`` documents, first by hash, that have a digit or an ``@`` and at most ``sample_chars`` code points.

    A threshold on the hash, from the number of rows, lets about 25 times as
    many documents through to the choice, so that what tasks send does not grow
    with their number. Null texts are passed over; repeated rows are repeated in
    the sample; from no documents comes a field that adds nothing.
    """
    share = min(1.0, 25 * sample_docs / max(1, docs.count()))
    key = F.xxhash64("doc_id", "text")
    some = docs.select("doc_id", F.col("text").cast("string").alias("text")).filter(F.pmod(key, F.lit(1 << 30)) < int(share * (1 << 30)))
    some = some.filter(F.col("text").rlike("[0-9@]") & (F.length("text") <= sample_chars))
    return fit([r.text for r in some.orderBy(key, F.md5("text")).limit(sample_docs).collect()])


#: Message passing ends when no message changes by more than this, or after so many rounds.
SETTLED, MOST_ROUNDS = 1e-6, 1000


def beliefs(local: np.ndarray, observed: np.ndarray, chain: list[tuple[int, int]], hubs: list[list[int]], bridges: list[list[int]], field: Field) -> np.ndarray:
    """Marginal beliefs of all nodes by loopy message passing.

    Hubs and bridges are extra nodes without evidence. A hub links its nodes by
    the potential of equal contents; a bridge links nodes, and hubs as node
    ``len(local) + place``, by that of contents one edit apart. Messages are
    averaged with the ones before, which settles where plain updates swing;
    if they have not settled after MOST_ROUNDS, the last ones count.
    """
    n, k = local.shape
    unary = np.concatenate([local, np.zeros((len(hubs) + len(bridges), k))])
    for i in np.flatnonzero(observed >= 0):
        unary[i] = -50.0
        unary[i, observed[i]] = 0.0
    groups = [*hubs, *bridges]
    one = np.array([a for a, _ in chain] + [i for h in groups for i in h], np.int64)
    two = np.array([b for _, b in chain] + [n + j for j, h in enumerate(groups) for _ in h], np.int64)
    n_same = sum(map(len, hubs))
    table = np.stack([field.chain] * len(chain) + [np.eye(k) * field.same] * n_same + [np.eye(k) * field.near] * (len(one) - len(chain) - n_same)) if len(one) else np.zeros((0, k, k))
    to_two, to_one = np.zeros((len(one), k)), np.zeros((len(one), k))

    def sums():
        total = unary.copy()
        np.add.at(total, two, to_two)
        np.add.at(total, one, to_one)
        return total

    def passed(x):
        top = x.max(axis=1, keepdims=True)
        out = np.log(np.exp(x - top).sum(axis=1)) + top[:, 0]
        return out - out.max(axis=1, keepdims=True)

    for _ in range(MOST_ROUNDS if len(one) else 0):
        total = sums()
        new_two = passed((total[one] - to_one)[:, :, None] + table)
        new_one = passed((total[two] - to_two)[:, :, None] + table.transpose(0, 2, 1))
        change = max(np.abs(new_two - to_two).max(), np.abs(new_one - to_one).max())
        to_two, to_one = (to_two + new_two) / 2, (to_one + new_one) / 2
        if change < SETTLED:
            break
    total = sums()[:n]
    p = np.exp(total - total.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def links_of(keys: list[str]) -> tuple[list[list[int]], list[list[int]]]:
    """(hubs, bridges) of nodes with these content keys: see ``beliefs``."""
    by_key: dict[str, list[int]] = defaultdict(list)
    for i, key in enumerate(keys):
        by_key[key].append(i)
    hubs = [h for h in by_key.values() if len(h) > 1]
    place = {keys[h[0]]: len(keys) + j for j, h in enumerate(hubs)}
    by_rest: dict[str, list[int]] = defaultdict(list)
    for key, own in by_key.items() if len(by_key) > 1 else ():
        for rest in left_without(key):
            by_rest[rest].append(place.get(key, own[0]))
    return hubs, sorted({tuple(b) for b in by_rest.values() if len(b) > 1})


def find_spans(text: str, field: Field) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of a text."""
    base, nodes = _nodes(text)
    if all(label >= 0 for _, _, label in nodes):
        return base, base
    keys = [content_key(text[a:b]) for a, b, _ in nodes]
    # the same content shows the same evidence however often it stands: each of its open nodes takes its share
    mentions = Counter(key for key, (_, _, label) in zip(keys, nodes, strict=True) if label < 0)
    local = np.array([shape(text[a:b]) for a, b, _ in nodes]) @ field.weights / np.array([[max(1, mentions[key])] for key in keys])
    near = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= NEAR]
    p = beliefs(local, np.array([label for _, _, label in nodes]), near, *links_of(keys), field)
    added = [(a, b, LABELS[int(q.argmax())]) for (a, b, label), q in zip(nodes, p, strict=True) if label < 0 and q.argmax() > 0 and q.max() >= CERTAIN]
    return base, sorted(base + added, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def find_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """For every document the counts of base spans, their digest, and all spans: the columns of FOUND.

    Offsets are code points, ends exclusive. Null and empty texts have no
    spans; null ids and repeated rows are searched row by row; texts are
    searched whole; an empty table gives no rows; other columns are not read.
    """

    def run(rows):
        for doc, text in rows:
            base, spans = find_spans(text or "", field)
            kinds = [k for _, _, k in base]
            yield doc, *map(kinds.count, KINDS), hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)

    return map_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, FOUND)


def masked(text: str, spans: list[Span]) -> str:
    """The text with spans, merged where they overlap, replaced by ``<KIND>`` of the first."""
    out, at = [], 0
    reach, open_kind = -1, ""
    for a, b, kind in spans:
        if a < reach:
            reach = max(reach, b)
            continue
        if reach >= 0:
            out.append(f"<{open_kind.upper()}>")
            at = reach
        out.append(text[at:a])
        reach, open_kind = b, kind
    if reach >= 0:
        out.append(f"<{open_kind.upper()}>")
        at = reach
    return "".join([*out, text[at:]])


def mask_personal_data(docs: DataFrame, field: Field) -> DataFrame:
    """The documents with personal data masked in ``text`` and ``n_chars`` counted anew where that column exists.

    Very long texts are searched whole, each in one task. Null texts stay with
    what ``n_chars`` they have; empty texts, null ids and
    repeated rows are rows like others; an empty table stays empty; no column
    is added, so none can clash.
    """
    import pyarrow as pa

    names = docs.columns

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                place = part.schema.get_field_index("text")
                texts = [t if t is None else masked(t, find_spans(t, field)[1]) for t in part.column(place).to_pylist()]
                columns = list(part.columns)
                columns[place] = pa.array(texts, part.schema.field(place).type)
                if "n_chars" in names:
                    n = part.schema.get_field_index("n_chars")
                    counted = [old if t is None else len(t) for t, old in zip(texts, part.column(n).to_pylist(), strict=True)]
                    columns[n] = pa.array(counted, part.schema.field(n).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return map_arrow(docs, run, docs.schema)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return find_personal_data(docs, train(docs))
