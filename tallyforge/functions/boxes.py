r"""Matching of ``\boxed{...}`` in one pass over the boxes, braces and numbers of a text, as Column functions.

The text is cut into pieces once. A running depth gives each brace its level; sorted by level and place, an opening
brace stands right before the one that closes it. So the work grows with the text, however many boxes it has and
however deep they lie in each other, and no stack is kept.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.text import NUM, S, let, parse_number, strip

OPENING = rf"\\boxed{S}*\{{"
#: A box without braces inside; an opening; a brace; a number; other text. Together they cover the text.
_PIECES = rf"(?s){OPENING}[^{{}}]*\}}|{OPENING}|[{{}}]|{NUM}|[^\\{{}}0-9$\-]+|."
#: Values that are added up together.
CHUNK = 16
#: What a number adds to a running sum, beside the 1 of an opening and the -1 of a closing brace.
_TOKEN = 1 << 32
_OTHER, _NUMBER, _OPEN, _CLOSE, _BOX, _WHOLE = range(6)


def running(values: Column) -> Column:
    """The sum of whole numbers up to and with each one. Sums run inside chunks, onto the sums of the chunks before, which run inside chunks of chunks."""
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)
    first = lambda xs, n: F.slice(xs, F.lit(1), n)
    starts = lambda xs: F.filter(F.transform(xs, lambda _, i: F.when(i % CHUNK == 0, i + 1)), F.isnotnull)
    cut = lambda xs: F.transform(starts(xs), lambda at: F.slice(xs, at, F.lit(CHUNK)))
    whole = lambda i: (i / CHUNK).cast("int")

    def onto(chunks: Column) -> Column:
        def with_sums(sums: Column) -> Column:
            def with_tops(tops: Column) -> Column:
                before = F.transform(sums, lambda _, i: total(first(tops, whole(i))) + total(F.slice(sums, whole(i) * CHUNK + 1, i % CHUNK)))
                return let(before, lambda b: F.flatten(F.transform(chunks, lambda chunk, i: F.transform(chunk, lambda _, j: F.get(b, i) + total(first(chunk, j + 1))))))

            return let(F.transform(cut(sums), total), with_tops)

        return let(F.transform(chunks, total), with_sums)

    return let(cut(values), onto)


def first_token(text: Column) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(NUM), F.lit(0)), F.lit(1))


def _content(box: Column) -> Column:
    """What a box without braces inside holds."""
    return F.regexp_replace(box, r"\A[^{]*\{|\}\z", "")


def _piece(text: Column, at: Column) -> Column:
    boxed, last = text.startswith("\\boxed"), F.right(text, F.lit(1))
    kind = (
        F.when(boxed & (last == "}"), _WHOLE).when(boxed & (last == "{"), _BOX).when(text == "{", _OPEN).when(text == "}", _CLOSE)
        .when(F.regexp_like(text, F.lit(r"\A-?\$?\d")) & ((F.length(text) > 1) | F.regexp_like(text, F.lit(NUM))), _NUMBER).otherwise(_OTHER)
    )
    return let(kind, lambda k: let(F.when(k == _NUMBER, text).when(k == _WHOLE, first_token(_content(text))), lambda token: F.struct(at.alias("at"), k.alias("kind"), token.alias("token"), _step(k, token).alias("step"))))


def _step(kind: Column, token: Column) -> Column:
    return F.when(token.isNotNull(), _TOKEN).when((kind == _OPEN) | (kind == _BOX), 1).when(kind == _CLOSE, -1).otherwise(0).cast("long")


def match_boxes(text: Column) -> Column:
    r"""Struct of ``pieces`` (the text, cut) and ``boxes``: for each ``\boxed{`` in order the places ``at`` and ``end`` of the pieces that open and close it, and ``value``.

    ``end`` is null where a box never closes; it is ``at`` where one piece holds
    the whole box. ``value`` is the number that the box is, else the first one
    in it, null if that does not parse.
    """

    def of(pieces: Column) -> Column:
        marked = F.filter(F.transform(pieces, _piece), lambda p: p["kind"] != _OTHER)

        def with_marks(marks: Column) -> Column:
            tokens = F.filter(F.transform(marks, lambda m: m["token"]), F.isnotnull)
            steps = F.transform(marks, lambda m: m["step"])
            counted = let(running(steps), lambda sums: _braces(marks, sums))
            return let(tokens, lambda t: let(counted, lambda c: F.sort_array(F.concat(_nested(c, t), _whole(marks, pieces)))))

        return F.struct(pieces.alias("pieces"), let(marked, with_marks).alias("boxes"))

    return let(F.regexp_extract_all(text, F.lit(_PIECES), F.lit(0)), of)


def _braces(marks: Column, sums: Column) -> Column:
    """Openings and closing braces with their level, the depth inside an opening and before a closing brace, and the numbers seen so far."""

    def of(mark: Column, i: Column) -> Column:
        seen = F.shiftright(F.get(sums, i) + (_TOKEN >> 1), 32)
        level = F.get(sums, i) - seen * _TOKEN + F.when(mark["kind"] == _CLOSE, 1).otherwise(0)
        return F.when(mark["kind"].between(_OPEN, _BOX), F.struct(level.alias("level"), mark["at"].alias("at"), mark["kind"].alias("kind"), seen.cast("int").alias("seen")))

    return F.filter(F.transform(marks, of), F.isnotnull)


def _nested(counted: Column, tokens: Column) -> Column:
    """Boxes with braces inside, and those that never close."""

    def of(by_level: Column) -> Column:
        def pair(x: Column, i: Column) -> Column:
            def with_next(y: Column) -> Column:
                closed = y["level"] == x["level"]
                return F.struct(x["at"].alias("at"), F.when(closed, y["at"]).alias("end"), F.when(closed & (y["seen"] > x["seen"]), parse_number(F.get(tokens, x["seen"]))).alias("value"))

            return F.when(x["kind"] == _BOX, let(F.get(by_level, i + 1), with_next))

        return F.filter(F.transform(by_level, pair), F.isnotnull)

    return let(F.sort_array(counted), of)


def _whole(marks: Column, pieces: Column) -> Column:
    def of(mark: Column) -> Column:
        value = F.coalesce(parse_number(strip(_content(F.get(pieces, mark["at"])))), parse_number(mark["token"]))
        return F.struct(mark["at"].alias("at"), mark["at"].alias("end"), value.alias("value"))

    return F.transform(F.filter(marks, lambda m: m["kind"] == _WHOLE), of)


def content(matched: Column, box: Column) -> Column:
    """The text inside a box of ``match_boxes``; null where it never closes."""
    at, end = box["at"], box["end"]
    return F.when(at == end, _content(F.get(matched["pieces"], at))).when(end.isNotNull(), F.array_join(F.slice(matched["pieces"], at + 2, F.greatest(end - at - 1, F.lit(0))), ""))


def find_boxed(text: Column) -> Column:
    r"""What stands in the balanced braces of each ``\boxed{``, in order of the openings; null where they never close."""
    return let(match_boxes(text), lambda m: F.transform(m["boxes"], lambda b: content(m, b)))
