"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events. Logs are partitioned by conversation and
sorted by sequence; starts, streamed deltas, edits, regenerations and removals
fold into the final messages, which a reversible template renders.

Events: (conv_id, seq, kind, turn, role, text) with kind
  start       opens the message ``turn`` with a role and empty text
  delta       appends text to it
  edit        replaces its text and drops all later messages, as after an edit of a prompt
  regenerate  empties its text; the deltas of the new attempt follow
  remove      drops the message
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from itertools import groupby

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import map_rows

#: Fixed control strings of the template and of common other ones; a backslash before them in a text undoes their meaning.
_CONTROL = re.compile(r"\\|<turn|</turn>|###|<\|")
_ROLE_CONTROL = re.compile(r"\\|<turn|###|<\||>|\n")
_ESCAPED = re.compile(r"\\(\\|<turn|</turn>|###|<\||>|\n)")
_TURN = re.compile(r"<turn ((?:[^\\>]++|\\.)*+)>((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.DOTALL)
FOLDED = "conv_id long, formatted string, loss_starts array<int>, loss_ends array<int>"


def escape(text: str) -> str:
    return _CONTROL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def _escape_role(role: str) -> str:
    return _ROLE_CONTROL.sub(lambda m: "\\" + m[0], role)


def render(messages: Iterable[tuple[str, str]], loss_role: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and where the texts of ``loss_role`` start and end in it (code points)."""
    parts: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for role, text in messages:
        head, body = f"<turn {_escape_role(role)}>", escape(text)
        if role == loss_role:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        parts += (head, body, "</turn>\n")
        at += len(head) + len(body) + len("</turn>\n")
    return "".join(parts), starts, ends


def parse(formatted: str) -> list[tuple[str, str]]:
    """The messages of a formatted conversation: the inverse of ``render``."""
    found, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return found


def fold(events: Iterable[tuple[str, object, str | None, str | None]]) -> list[tuple[str, str]]:
    """The final messages (role, text) of one conversation's events (kind, turn, role, text) in order.

    An event on a message that was never started starts it; unknown kinds are errors.
    """
    messages: dict[object, tuple[str, list[str]]] = {}  # in order; each event takes time for its own message and those that it ends
    for kind, turn, role, text in events:
        if turn not in messages or kind == "start":
            messages.pop(turn, None)
            messages[turn] = role or "", []
        said = messages[turn][1]
        if kind == "delta":
            said.append(text or "")
        elif kind == "edit":
            said[:] = [text or ""]
            while next(reversed(messages)) != turn:
                messages.popitem()
        elif kind == "regenerate":
            said.clear()
        elif kind == "remove":
            del messages[turn]
        elif kind != "start":
            raise ValueError(f"unknown kind of event: {kind}")
    return [(role, "".join(said)) for role, said in messages.values()]


def _fold_partition(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows (conv_id, kind, turn, role, text), sorted: folded as they come, the messages of one conversation are held at a time."""
    for conv, events in groupby(rows, key=lambda row: row[0]):
        yield conv, *render(fold(row[1:] for row in events))


def format_conversations(events: DataFrame) -> DataFrame:
    """One row for each conversation: conv_id, formatted, loss_starts, loss_ends.

    The log is dealt by conv_id and sorted by seq (then kind, turn, role and
    text, so that ties have one order); each task folds one conversation after
    another and holds one at a time. A null conv_id is one conversation; null
    roles and texts are empty; an empty log gives no rows; other columns are
    not read. A conversation is one output row, so its size is bounded by what
    a row can hold; its events are sorted on disk where they must be.
    """
    log = events.select(F.col("conv_id").cast("long").alias("conv_id"), "seq", "kind", "turn", "role", "text")
    log = log.repartition("conv_id").sortWithinPartitions("conv_id", "seq", "turn", "kind", "role", "text")
    return map_rows(log.select("conv_id", "kind", "turn", "role", "text"), _fold_partition, FOLDED)


def events_of_turns(conversations: DataFrame, chunk: int = 512) -> DataFrame:
    """The event log of finished rows (conv_id, turn, role, text): a start, then deltas of ``chunk`` code points.

    ``turn`` of an event is (turn, role, text) together, so rows that share a turn number stay messages of their own;
    fully equal rows are told apart by a count. Null texts and roles are empty, and an empty message is a start alone;
    null ids and turns are values like others; long texts are cut in one pass; an empty table gives no events; other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("n"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"))
    rows = rows.groupBy("conv_id", "n", "role", "text").agg(F.count(F.lit(1)).alias("copies")).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    # the text is cut and digested once for each message; "." is a code point
    pieces = F.concat(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{chunk}}}"), F.lit(0)))
    cut = rows.select("conv_id", "n", "role", "copy", F.md5("text").alias("of"), F.xxhash64("n", "role", "text", "copy").alias("turn"), pieces.alias("pieces"))
    events = cut.select("conv_id", "n", "role", "copy", "of", "turn", F.posexplode("pieces").alias("part", "piece"))
    return events.select("conv_id", F.struct("n", "role", "of", "copy", "part").alias("seq"), F.when(F.col("part") == 0, "start").otherwise("delta").alias("kind"), "turn", "role", F.col("piece").alias("text"))


def _digests(rows: Iterator[tuple]) -> Iterator[tuple]:
    for conv, formatted, starts, ends in rows:
        turns = parse(formatted)
        loss = "".join(unescape(formatted[a:b]) for a, b in zip(starts, ends, strict=True))
        whole = "".join(f"{role}\n{text}\n" for role, text in turns)
        yield conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(formatted)


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    stated = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", stated), (-7, 1, "assistant", stated)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    formatted = format_conversations(events_of_turns(rows.unionByName(extra)))
    return map_rows(formatted, _digests, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


OP3_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), e AS (
  SELECT *, regexp_replace(text, '(\\|<turn|</turn>|###|<\|)', '\\\1', 'g') AS escaped,
         regexp_replace(role, '(\\|<turn|###|<\||>|\n)', '\\\1', 'g') AS escaped_role FROM c
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, md5(text))) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, md5(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(length(escaped) + length(escaped_role) + length('<turn ></turn>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
