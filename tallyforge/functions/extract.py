r"""Versioned answer extraction: the rule set ``extract_v1``.

A result is a struct: extraction_version, status (parsed, unparsed, malformed,
ambiguous), prediction_num or prediction_str, strategy, candidates_num or
candidates_str, unit, flags. Numbers are found by the first strategy that has
one, in the order boxed, answer_is, answer_colon, final_answer, bold, equals,
last_number; within a strategy the last match wins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.boxes import OPENING, content, find_boxed, first_token, match_boxes
from tallyforge.functions.text import NUM, S, WS, first_paragraph, is_blank, let, normalize_text, number_tokens, parse_number, strip

VERSION = "extract_v1"
ANSWER_TYPES = ("number", "yesno", "label", "name", "string", "code")
#: A unit right after a number, seen without being consumed.
_UNIT = rf"(?=(?:{S}*([A-Za-z²³%][\p{{L}}\p{{N}}_²³%/^\- ]{{0,19}}))?)"
MARKERS = {
    "answer_is": rf"(?i)answer{S}+(?:is{S}+|=+{S}*)?(?:approximately{S}+)?({NUM})",
    "answer_colon": rf"(?i)answer{S}*:{S}*({NUM})",
    "final_answer": rf"(?i)final{S}+answer[^\d\-]*({NUM})",
    "equals": rf"={S}*({NUM})",
    "last_number": rf"({NUM})",
}
_BOLD = r"\*\*([^*]+)\*\*"


def _no_numbers() -> Column:
    return F.array().cast("array<double>")


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def result(status, *, number=None, string=None, strategy=None, numbers=None, strings=None, unit=None, flags=None) -> Column:
    none = lambda kind: F.lit(None).cast(kind)
    lit = lambda x: x if isinstance(x, Column) else F.lit(x).cast("string")
    return F.struct(
        F.lit(VERSION).alias("extraction_version"), lit(status).alias("status"),
        (none("double") if number is None else number).alias("prediction_num"), (none("string") if string is None else string).alias("prediction_str"),
        lit(strategy).alias("strategy"),
        (_no_numbers() if numbers is None else numbers).alias("candidates_num"), (_no_strings() if strings is None else strings).alias("candidates_str"),
        lit(unit).alias("unit"), (_no_strings() if flags is None else flags).alias("flags"),
    )


def _last(values: Column) -> Column:
    return F.element_at(values, -1)


def _several(values: Column) -> Column:
    return F.when(F.size(F.array_distinct(values)) > 1, F.array(F.lit("multiple_distinct_values"))).otherwise(_no_strings())


def _unit_after(scope: Column, part: Column) -> Column:
    """The unit after the last place where ``part`` stands in the scope."""
    end = F.length(scope) + 2 - F.instr(F.reverse(scope), F.reverse(part))
    return _unless_empty(F.regexp_extract(F.substring(scope, end, F.length(scope)), rf"\A{S}*([A-Za-z²³%][\p{{L}}\p{{N}}_²³%/^\- ]{{0,19}})", 1))


def _unless_empty(unit: Column) -> Column:
    return let(strip(unit), lambda u: F.when(u != "", u))


def _decide(scope: Column, values: Column, malformed: Column, last_box: Column) -> Column:
    """The result of boxes with these numbers; ``last_box`` is the content of the last box that is closed."""

    def of(v: Column) -> Column:
        flags = F.when(malformed, F.array(F.lit("boxed_malformed"))).otherwise(_no_strings())
        distinct = F.array_sort(F.array_distinct(v))
        return (
            F.when(F.size(v) == 0, result("malformed", strategy="boxed", flags=F.array(F.lit("boxed_malformed"))))
            .when(F.size(distinct) > 1, result("ambiguous", strategy="boxed", numbers=distinct, flags=flags))
            .otherwise(result("parsed", number=_last(v), strategy="boxed", numbers=v, unit=_unit_after(scope, last_box), flags=flags))
        )

    return let(values, of)


def _boxed(scope: Column) -> Column:
    """By its boxes; those of most texts have no braces inside, and only the others need matching."""

    def plain(contents: Column) -> Column:
        values = F.filter(F.transform(contents, lambda b: F.coalesce(parse_number(strip(b)), parse_number(first_token(b)))), F.isnotnull)
        return _decide(scope, values, F.lit(False), _last(contents))

    def matched(m: Column) -> Column:
        closed = content(m, F.element_at(F.filter(m["boxes"], lambda b: b["end"].isNotNull()), -1))
        return _decide(scope, F.filter(F.transform(m["boxes"], lambda b: b["value"]), F.isnotnull), F.exists(m["boxes"], lambda b: b["end"].isNull()), closed)

    whole = F.regexp_extract_all(scope, F.lit(rf"{OPENING}([^{{}}]*)\}}"), F.lit(1))
    by = let(whole, lambda contents: F.when(F.size(contents) == F.regexp_count(scope, F.lit(OPENING)), plain(contents)).otherwise(let(match_boxes(scope), matched)))
    return F.when(F.contains(scope, F.lit(r"\boxed")) & F.regexp_like(scope, F.lit(OPENING)), by)


def _marked(name: str, scope: Column) -> Column:
    pattern = F.lit(MARKERS[name] + _UNIT)
    values = F.filter(F.transform(F.regexp_extract_all(scope, pattern, F.lit(1)), parse_number), F.isnotnull)
    unit = _unless_empty(_last(F.regexp_extract_all(scope, pattern, F.lit(2))))
    return let(values, lambda v: F.when(F.size(v) > 0, result("parsed", number=_last(v), strategy=name, numbers=v, unit=unit, flags=_several(v))))


def _bold(scope: Column) -> Column:
    values = F.filter(F.transform(F.regexp_extract_all(scope, F.lit(_BOLD), F.lit(1)), lambda x: parse_number(first_token(x))), F.isnotnull)
    return let(values, lambda v: F.when(F.size(v) > 0, result("parsed", number=_last(v), strategy="bold", numbers=v, flags=_several(v))))


def extract_number(scope: Column) -> Column:
    """The number by the first strategy that finds one; the scope, which may be costly to make, is made once."""
    return let(scope, _number)


def _number(scope: Column) -> Column:
    """A text without a strategy's marker is not searched by it."""
    answer = F.regexp_like(scope, F.lit("(?i)answer"))
    return F.coalesce(
        _boxed(scope),
        F.when(answer, F.coalesce(_marked("answer_is", scope), _marked("answer_colon", scope), _marked("final_answer", scope))),
        F.when(F.contains(scope, F.lit("**")), _bold(scope)), F.when(F.contains(scope, F.lit("=")), _marked("equals", scope)), _marked("last_number", scope),
        result("unparsed", flags=F.array(F.lit("no_numeric_candidate"))),
    )


def first_yesno(scope: Column) -> Column:
    """The first whole word yes or no, lowered; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(scope, r"(?iU)\b(yes|no)\b", 1)), F.lit(""))


def extract_yesno(scope: Column) -> Column:
    found = result("parsed", string=first_yesno(scope), strategy="first_yesno", strings=F.array(first_yesno(scope)))
    return F.when(first_yesno(scope).isNotNull(), found).otherwise(result("unparsed", flags=F.array(F.lit("no_yesno_candidate"))))


def label_hits(scope: Column, labels: Column) -> Column:
    """(place, label) of every label in the lowered scope, longer labels masked out before shorter ones are searched, in order of place."""
    ordered = F.transform(F.array_sort(F.transform(labels, lambda x, i: F.struct((-F.length(x)).alias("n"), i.alias("i"), x.alias("label")))), lambda s: s["label"])
    start = F.struct(F.lower(scope).alias("masked"), F.array().cast("array<struct<at:int,label:string>>").alias("hits"))

    def step(s, label):
        at = F.instr(s["masked"], label) - 1
        masked = F.replace(s["masked"], label, F.repeat(F.lit("#"), F.length(label)))
        return F.when(at >= 0, F.struct(masked.alias("masked"), F.array_append(s["hits"], F.struct(at.cast("int").alias("at"), label.alias("label"))).alias("hits"))).otherwise(s)

    return F.array_sort(F.aggregate(ordered, start, step, lambda s: s["hits"]))


def extract_label(scope: Column, labels: Column) -> Column:
    def of(hits):
        found = result("parsed", string=F.element_at(hits, 1)["label"], strategy="first_label", strings=F.transform(hits, lambda h: h["label"]))
        return F.when(F.size(hits) > 0, found).otherwise(result("unparsed", flags=F.array(F.lit("no_label_candidate"))))

    return let(label_hits(scope, F.transform(labels, F.lower)), of)


def extract_containment(scope: Column, gold: Column) -> Column:
    """The gold itself if the normalized scope contains it. It uses the gold, so it measures mention, not free extraction."""

    def of(g):
        found = result("parsed", string=g, strategy="gold_containment", strings=F.array(g))
        return F.when(F.contains(normalize_text(scope), g), found).otherwise(result("unparsed", strategy="gold_containment", flags=F.array(F.lit("gold_not_found_in_scope"))))

    return let(normalize_text(gold), of)


def scope_for_condition(condition: Column) -> Column:
    return F.when(condition.startswith("few_shot"), F.lit("first_paragraph")).otherwise(F.lit("full"))


def extract_answer(text: Column, answer_type: Column, scope: Column, labels: Column, gold: Column) -> Column:
    """Extraction by answer type from the whole text or its first paragraph. Blank texts are unparsed; code and missing labels or gold are errors."""
    error = lambda message: F.raise_error(F.lit(message)).cast("struct<extraction_version:string,status:string,prediction_num:double,prediction_str:string,strategy:string,candidates_num:array<double>,candidates_str:array<string>,unit:string,flags:array<string>>")

    def by_type(scoped):
        return (
            F.when(answer_type == "number", _number(scoped))
            .when(answer_type == "yesno", extract_yesno(scoped))
            .when(answer_type == "label", F.when(F.coalesce(F.size(labels), F.lit(0)) > 0, extract_label(scoped, labels)).otherwise(error("label extraction needs labels")))
            .when(answer_type.isin("name", "string"), F.when(gold.isNotNull(), extract_containment(scoped, gold)).otherwise(error("containment needs the gold answer")))
            .otherwise(error("answer type is not extracted from text"))
        )

    scoped = F.when(scope == "first_paragraph", first_paragraph(text)).otherwise(text)
    return F.when(is_blank(text), result("unparsed", flags=F.array(F.lit("empty_output")))).otherwise(let(scoped, by_type))


def answers_match(extraction: Column, gold: Column, answer_type: Column) -> Column:
    """Whether a parsed answer equals the gold: numbers within 1e-6, other types after normalization; never null."""
    number = F.abs(extraction["prediction_num"] - parse_number(gold)) < 1e-6
    string = normalize_text(extraction["prediction_str"]) == normalize_text(gold)
    return F.coalesce((extraction["status"] == "parsed") & F.when(answer_type == "number", number).otherwise(string), F.lit(False))


RULE_SETS = {VERSION: extract_answer}
__all__ = ["MARKERS", "RULE_SETS", "VERSION", "WS", "answers_match", "extract_answer", "extract_number", "find_boxed", "number_tokens"]
