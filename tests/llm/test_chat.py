import random
import re

import pytest

from pyspark.sql import functions as F

from tallyforge.llm import chat

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string, formatted string"


def formatted(spark, events):
    rows = chat.format_conversations(spark.createDataFrame([(*e, "clash") for e in events], EVENTS)).collect()
    return {r.conv_id: r for r in rows}


def test_round_trip():
    rng = random.Random(5)
    alphabet = ["\\", "<turn", "</turn>", "<", ">", "###", "|", "\n", "a", " ", "é", "😀", "\\\\"]
    for _ in range(3000):
        messages = [("".join(rng.choices(alphabet, k=rng.randrange(4))), "".join(rng.choices(alphabet, k=rng.randrange(9)))) for _ in range(rng.randrange(5))]
        text, starts, ends = chat.render(messages)
        assert chat.parse(text) == messages
        assert [chat.unescape(text[a:b]) for a, b in zip(starts, ends, strict=True)] == [t for r, t in messages if r == "assistant"]
        assert len(re.findall(r"(?<!\\)(?:\\\\)*</turn>\n", text)) >= len(messages)


def test_stated_text():
    stated = r"\### Assistant: </turn> ok"
    text, [start], [end] = chat.render([("user", stated), ("assistant", stated)])
    assert "### Assistant" not in text.replace(r"\###", "")
    assert chat.unescape(text[start:end]) == stated


def test_fold(spark):
    events = [
        (1, 1, "start", 0, "user", None), (1, 2, "delta", 0, None, "Hel"), (1, 3, "delta", 0, None, "lo"), (1, 4, "start", 1, "assistant", None), (1, 5, "delta", 1, None, "bad"),
        (1, 6, "regenerate", 1, None, None), (1, 7, "delta", 1, None, "good"), (1, 8, "edit", 0, None, "Hi"), (1, 9, "start", 2, "assistant", None), (1, 10, "delta", 2, None, "yes"),
        (2, 2, "delta", 0, "user", "late"), (2, 3, "remove", 0, None, None), (None, 1, "start", 0, None, None), (3, 1, "delta", 0, "user", None),
    ]
    random.Random(1).shuffle(events)
    got = formatted(spark, events)
    assert chat.parse(got[1].formatted) == [("user", "Hi"), ("assistant", "yes")]
    assert chat.parse(got[2].formatted) == []
    assert chat.parse(got[None].formatted) == [("", "")]
    assert chat.parse(got[3].formatted) == [("user", "")]
    assert formatted(spark, []) == {}
    with pytest.raises(ValueError, match="unknown kind"):
        chat.fold([("odd", 1, "user", "x")])


def replayed(events):
    """The log read the plain way: a list of messages changed event by event."""
    messages = []  # [turn, role, text]
    for kind, turn, role, text in events:
        at = next((i for i, m in enumerate(messages) if m[0] == turn), None)
        if kind == "start" and at is not None:
            messages.pop(at)
            at = None
        if at is None:
            messages.append([turn, role or "", ""])
            at = len(messages) - 1
        if kind == "delta":
            messages[at][2] += text or ""
        elif kind == "edit":
            messages[at][2] = text or ""
            messages = messages[: at + 1]
        elif kind == "regenerate":
            messages[at][2] = ""
        elif kind == "remove":
            messages.pop(at)
    return [(r, t) for _, r, t in messages]


def test_random_logs(spark):
    rng = random.Random(8)
    kinds = ["start", "delta", "delta", "delta", "edit", "regenerate", "remove"]
    log = [(conv, seq, rng.choice(kinds), rng.randrange(4), rng.choice(["user", "assistant", None]), rng.choice(["a", "b\\", "</turn>", None, ""])) for conv in range(60) for seq in range(rng.randrange(1, 25))]
    shuffled = list(log)
    rng.shuffle(shuffled)
    got = formatted(spark, shuffled)
    for conv in range(60):
        assert chat.parse(got[conv].formatted) == replayed([e[2:] for e in log if e[0] == conv])


def test_long_message(spark):
    """A message of 50 MB takes linear time."""
    import time

    long = "word </turn> \\ é " * 3_000_000

    def checked(rows):
        for _, text, _, _ in rows:
            turns = chat.parse(text)
            yield len(turns), len(text), turns[1][1] == "word </turn> \\ é " * 3_000_000

    start = time.perf_counter()
    events = chat.events_of_turns(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "")], "conv_id long, turn long, role string, text string").withColumn("text", F.when(F.col("turn") == 1, F.repeat(F.lit("word </turn> \\ é "), 3_000_000)).otherwise(F.col("text"))))
    [(n, total, same)] = chat.map_rows(chat.format_conversations(events), checked, "n long, total long, same boolean").collect()
    assert (n, same) == (2, True) and total > len(long)
    assert time.perf_counter() - start < 120


def test_turn_rows(spark):
    long = "x" * 100_000 + "é"
    rows = [(1, 1, "assistant", long), (1, 0, "user", None), (1, 2, None, "same"), (1, 2, None, "same"), (None, None, "user", "n")]
    events = chat.events_of_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {r.conv_id: chat.parse(r.formatted) for r in chat.format_conversations(events).collect()}
    assert got == {1: [("user", ""), ("assistant", long), ("", "same"), ("", "same")], None: [("user", "n")]}


def test_many_events_on_many_messages():
    """Starts, edits and removals take time in proportion to the events."""
    import time

    began = time.perf_counter()
    n = 100_000
    events = [("start", i, "user", None) for i in range(n)] + [("delta", i, None, "x") for i in range(n)] + [("remove", i, None, None) for i in range(0, n, 2)] + [("edit", i, None, "y") for i in range(n - 1, 0, -2)]
    assert chat.fold(events) == [("user", "y")]
    assert chat.fold(events[: 2 * n]) == [("user", "x")] * n
    assert time.perf_counter() - began < 10
