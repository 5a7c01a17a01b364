"""JSON documents that are read by many tasks: one large array of objects, at the top or under a key.

Spark's text scan cuts a file into blocks and, with the quote as its line end,
into pieces between quotes that are never cut themselves. A first pass tells
for each block how it changes the parity of quotes and the depth of brackets,
for either parity that it may start with. One row a block then gives the state
in which each block starts, and a second pass cuts the objects out. An object
that spans blocks is put together from its parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.shipping import ship

_BRACKETS = re.compile(r"[\[\]{}]")
_SUMMARY = "file string, block long, parity0 boolean, net0 long, low0 long, parity1 boolean, net1 long, low1 long"
#: Parts of objects. ``number`` counts the objects that a block starts and ends; -1 is the one that it leaves open, -2 text outside of objects.
_PARTS = "file string, owner long, number long, block long, body string"
OPEN, OUTSIDE = -1, -2


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    scan = spark.read.option("lineSep", '"').option("recursiveFileLookup", True).text(path)
    return scan.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _by_block(batches: Iterator) -> Iterator[tuple[tuple[str, int], Iterator[str]]]:
    """Pieces by (file, block), in the order of the scan."""
    from itertools import groupby

    rows = (row for batch in batches for row in zip(batch["file"], batch["block"], batch["value"], strict=True))
    for key, group in groupby(rows, key=lambda r: (r[0], int(r[1]))):
        yield key, (r[2] for r in group)


def _closes(piece: str) -> bool:
    """Whether the quote after a piece of a string ends the string: an even number of backslashes stands before it."""
    return (len(piece) - len(piece.rstrip("\\"))) % 2 == 0


def _summarize(batches: Iterator) -> Iterator:
    import pandas as pd

    found = []
    for key, pieces in _by_block(batches):
        inside, depth, low = [False, True], [0, 0], [0, 0]
        for piece in pieces:
            marks = None
            for start in (0, 1):
                if inside[start]:
                    inside[start] = not _closes(piece)
                    continue
                marks = _BRACKETS.findall(piece) if marks is None else marks
                for mark in marks:
                    depth[start] += 1 if mark in "[{" else -1
                    low[start] = min(low[start], depth[start])
                inside[start] = True
        found.append((*key, inside[0], depth[0], low[0], inside[1], depth[1], low[1]))
    yield pd.DataFrame(found, columns=[c.split()[0] for c in _SUMMARY.split(", ")])


def _starts(summaries: list, level: int) -> dict[tuple[str, int], tuple[bool, int, int]]:
    """For each block (inside a string, depth, block where the object that is open began)."""
    starts: dict[tuple[str, int], tuple[bool, int, int]] = {}
    file, inside, depth, owner = None, False, 0, -1

    def end() -> None:
        if file is not None and depth != 0:
            raise ValueError(f"{file} is no complete JSON document")

    for r in sorted(summaries, key=lambda r: (r.file, r.block)):
        if r.file != file:
            end()
            file, inside, depth, owner = r.file, False, 0, -1
        starts[r.file, r.block] = inside, depth, owner
        after, net, low = (r.parity1, r.net1, r.low1) if inside else (r.parity0, r.net0, r.low0)
        if depth + net > level and (depth <= level or depth + low <= level):
            owner = r.block  # the object that is open at the end began here
        inside, depth = after, depth + net
    end()
    return starts


def _cut(key: tuple[str, int], pieces: Iterator[str], state: tuple[bool, int, int], level: int) -> Iterator[tuple]:
    """The parts of objects in a block, and its text outside of objects."""
    file, block = key
    inside, depth, owner = state
    number, mine, body, outside = 0, False, [], []
    for piece in pieces:
        last = 0
        if not inside:
            for mark in _BRACKETS.finditer(piece):
                if mark[0] in "[{":
                    if depth == level and mark[0] == "{":
                        last, mine = mark.start(), True
                    depth += 1
                    if depth == level:
                        outside.append(piece[last : mark.end()])
                        last = mark.end()
                    continue
                depth -= 1
                if depth == level and mark[0] == "}":
                    body.append(piece[last : mark.end()])
                    yield file, block if mine else owner, number if mine else OPEN, block, "".join(body)
                    number, mine, body, last = number + mine, False, [], mark.end()
                elif depth == level - 1:
                    last = mark.start()
        if depth > level:
            body.append(piece[last:] + '"')
        elif depth < level:
            outside.append(piece[last:] + '"')
        inside = not inside or not _closes(piece)
    if body:
        yield file, block if mine else owner, OPEN, block, "".join(body)
    yield file, block, OUTSIDE, block, "".join(outside)


def _parts(spark: SparkSession, path: str, level: int) -> DataFrame:
    ship(spark)
    pieces = _pieces(spark, path)
    summaries = pieces.mapInPandas(_summarize, _SUMMARY).collect()  # one row for each block of a file
    starts = spark.sparkContext.broadcast(_starts(summaries, level))

    def cut(batches):
        import pandas as pd

        names, held, size = [c.split()[0] for c in _PARTS.split(", ")], [], 0
        for key, found in _by_block(batches):
            for part in _cut(key, found, starts.value[key], level):
                held.append(part)
                size += len(part[-1])
                if size > 1 << 22:
                    yield pd.DataFrame(held, columns=names)
                    held, size = [], 0
        yield pd.DataFrame(held, columns=names)

    return pieces.mapInPandas(cut, _PARTS)


def read_objects(spark: SparkSession, path: str, schema: str, *, key: str | None = None, head: str | None = None) -> DataFrame:
    """The objects of documents that are one array, or an object that holds one array of objects under ``key``.

    ``path`` is a file or a folder of such documents. With ``head``, a schema
    of plain fields, those fields of the document stand before the object's.
    A document that ends early is an error. Objects come in no order.

    Under a key, no other value of the document may hold objects at the same
    depth. An object is put together in one task; the driver holds one row for
    each block of a file.
    """
    level = 1 if key is None else 2
    parts = _parts(spark, path, level)
    whole = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "body"))), lambda p: p["body"]), "")
    objects = parts.filter(F.col("number") != OUTSIDE).groupBy("file", "owner", "number").agg(whole.alias("body"))
    rows = objects.select("file", F.from_json("body", schema).alias("o"))
    if head is None:
        return rows.select("o.*")
    outside = parts.filter(F.col("number") == OUTSIDE).groupBy(F.col("file").alias("of")).agg(whole.alias("body"))
    # the last piece of a file has got a quote that the file does not have
    heads = outside.select("of", F.from_json(F.regexp_replace("body", r'"\s*\z', ""), head).alias("h"))
    return rows.join(F.broadcast(heads), F.col("file") == F.col("of")).select("h.*", "o.*")
