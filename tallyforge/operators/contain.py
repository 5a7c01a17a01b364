"""Which of many golds stand in which of many texts, without a join of all with all."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.text import bare_text, collapse_str, normalize_text
from tallyforge.shipping import ship

#: Bytes of golds that go over the texts at once.
PART_BYTES = 16 << 20
_FOUND = "text_id long, gold_id long"


def _parts(golds: DataFrame, part_bytes: int) -> Iterator[dict[str, list[int]]]:
    """Golds by their text, some bytes at a time."""
    held: dict[str, list[int]] = defaultdict(list)
    size = 0
    for row in golds.toLocalIterator():
        held[row.gold].append(row.gold_id)
        size += len(row.gold.encode()) + 8
        if size >= part_bytes:
            yield dict(held)
            held, size = defaultdict(list), 0
    if held:
        yield dict(held)


def _automaton(golds: dict[str, list[int]]):
    """An automaton that finds all golds in one scan of a text."""
    import ahocorasick

    machine = ahocorasick.Automaton()
    for gold, ids in golds.items():
        if gold:
            machine.add_word(gold, ids)
    machine.make_automaton()
    return machine


def containments(texts: DataFrame, golds: DataFrame, *, text_id: str, text: str, gold_id: str, gold: str, part_bytes: int = PART_BYTES, normalize=normalize_text) -> DataFrame:
    """Pairs (text_id, gold_id) for which the normalized text contains the normalized gold, as ``extract.extract_containment`` tests one pair.

    Each text is scanned once for each part of golds by an Aho-Corasick
    automaton, in time linear in the text and what is found; golds are sent to
    executors in parts of bounded bytes, so a longer list means more passes
    and no larger ones. Null texts contain nothing, null golds are in nothing,
    an empty gold is in every text; repeated rows give repeated pairs.
    ``normalize_text`` collapses white space of the texts where they are
    scanned, as its pattern takes most of the time.
    """
    ship(texts.sparkSession)
    late = normalize is normalize_text
    before = (lambda value: F.lower(bare_text(value))) if late else normalize
    rows = texts.select(F.col(text_id).cast("long").alias("text_id"), _of(before, text).alias("text")).where("text IS NOT NULL")
    wanted = golds.select(F.col(gold_id).cast("long").alias("gold_id"), _of(normalize, gold).alias("gold")).where("gold IS NOT NULL")
    found = texts.sparkSession.createDataFrame([], _FOUND)
    for part in _parts(wanted, part_bytes):
        found = found.unionByName(_scan(rows, texts.sparkSession.sparkContext.broadcast(part), late))
    return found


def _of(normalize, name: str) -> Column:
    value = F.col(name).cast("string")
    return normalize(value) if normalize else value


def _scan(rows: DataFrame, part, collapsed: bool) -> DataFrame:
    def run(batches):
        import pandas as pd

        golds = part.value
        machine, everywhere = _automaton(golds), golds.get("", [])
        for batch in batches:
            pairs = []
            for key, text in zip(batch["text_id"], batch["text"], strict=True):
                hits = {id(ids): ids for _, ids in machine.iter(collapse_str(text) if collapsed else text)} if len(machine) else {}
                pairs += [(key, g) for g in everywhere] + [(key, g) for ids in hits.values() for g in ids]
                if len(pairs) > 100_000:
                    yield pd.DataFrame(pairs, columns=["text_id", "gold_id"])
                    pairs = []
            yield pd.DataFrame(pairs, columns=["text_id", "gold_id"])

    return rows.mapInPandas(run, _FOUND)
