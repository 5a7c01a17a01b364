"""Older rule sets, each under its own name: ``eval20``, ``ablation`` and ``audit``, and behaviour measures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.extract import first_yesno, label_hits
from tallyforge.functions.text import NUM_PLAIN, S, WS, clean_number, first_paragraph, is_blank, let, lines, nonempty_lines, normalize_audit, normalize_text, quote_regex, strip

#: Fixed patterns: text a model writes when it starts a task of its own, and refusals.
DRIFT = r"(?id)(^|\n)\s*(answer|sentiment|subject|review|text|question)\s*:|(^|\n).*\?\s*($|\n)|you are (a|an) (helpful |ai )?assistant"
REFUSAL = r"(?i)unable to|cannot provide|can't provide|i'm sorry|as an ai"


def _last_of(text: Column, pattern: str, group: int) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def number_final(text: Column) -> Column:
    """Number of prose: after ``answer is``, else in bold, else after ``=``, else the last; a marker that is there decides even if it does not parse."""
    marked = (rf"(?i)answer is{S}*({NUM_PLAIN})", rf"\*\*[^*\d]*({NUM_PLAIN})[^*]*\*\*", rf"={S}*({NUM_PLAIN})", rf"({NUM_PLAIN})")
    return clean_number(F.coalesce(*[_last_of(text, p, 1) for p in marked]))


def number_completion(text: Column) -> Column:
    """The first number after an optional leading ``Answer:``."""
    bare = F.regexp_replace(text, rf"(?i)\A{S}*answer{S}*:{S}*", "")
    return clean_number(F.nullif(F.regexp_extract(bare, NUM_PLAIN, 0), F.lit("")))


def first_label(scope: Column, labels: Column) -> Column:
    return F.try_element_at(label_hits(scope, labels), F.lit(1))["label"]


def _grade(correct, *, number=None, string=None, flags=None) -> Column:
    none = F.array().cast("array<string>")
    return F.struct(
        F.coalesce(correct, F.lit(False)).alias("correct"), (F.lit(None).cast("double") if number is None else number).alias("extracted_num"),
        (F.lit(None).cast("string") if string is None else string).alias("extracted_str"), (none if flags is None else flags).alias("flags"),
    )


def _review(when: Column) -> Column:
    return F.when(when, F.array(F.lit("needs_review"))).otherwise(F.array().cast("array<string>"))


def _grade_text(text: Column, gold: Column, kind: Column, labels: Column, short: Column, number: Column, fell_back: Column) -> Column:
    """The part that eval20 and ablation share. ``short``: only the first paragraph counts."""
    para, all_lines = first_paragraph(text), nonempty_lines(text)
    tail = F.slice(all_lines, F.greatest(F.size(all_lines) - 2, F.lit(1)), F.lit(3))
    yesno = first_yesno(F.when(short, para).otherwise(text))
    label = first_label(F.when(short, para).otherwise(F.array_join(F.slice(all_lines, 1, 2), " ")), labels)
    mentioned = lambda scope: _grade(F.contains(normalize_text(scope), normalize_text(gold)), string=F.left(scope, F.lit(80)))
    return (
        F.when(is_blank(text), _grade(F.lit(False), flags=F.array(F.lit("empty_output"))))
        .when(kind == "number", _grade(number == clean_number(gold), number=number, flags=_review(fell_back)))
        .when(kind == "yesno", _grade(yesno == F.lower(gold), string=yesno, flags=_review(yesno.isNull())))
        .when(kind == "label", _grade(label == F.lower(gold), string=label, flags=_review(label.isNull())))
        .when(kind == "name", mentioned(F.when(short, para).otherwise(F.array_join(tail, " "))))
        .when(kind == "string", mentioned(F.when(short, para).otherwise(text)))
    )


def grade_eval20(text: Column, gold: Column, kind: Column, labels: Column, condition: Column) -> Column:
    """Rule set eval20: few-shot completions take the first number of the first paragraph, prose its final number."""
    short = condition.endswith("few_shot")
    first = number_completion(first_paragraph(text))
    return _grade_text(text, gold, kind, labels, short, F.when(short, F.coalesce(first, number_final(text))).otherwise(number_final(text)), short & first.isNull())


def grade_ablation(text: Column, gold: Column, kind: Column, labels: Column, condition: Column) -> Column:
    """Rule set ablation: the first number everywhere; only conditions ``A_...`` are completions."""
    short = condition.startswith("A_")
    first = number_completion(first_paragraph(text))
    return _grade_text(text, gold, kind, labels, short, F.when(short, F.coalesce(first, number_completion(text))).otherwise(number_completion(text)), short & first.isNull())


def _audit_number(text: Column, completion: Column) -> Column:
    whole = _last_of(text, r"(-?\d+)", 1)
    return F.when(completion, F.coalesce(_last_of(first_paragraph(text), r"(-?\d+)", 1), whole)).otherwise(whole)


def _is_integer(gold: Column) -> Column:
    return F.regexp_like(strip(gold), F.lit(r"\A-?\d+\z"))


def audit_judge(text: Column, gold: Column, category: Column, completion: Column) -> Column:
    """Rule set audit: correct, wrong, or review for code. Integers compare the last number as a string, others search the gold as whole words."""
    whole_words = F.concat(F.lit(r"(?U)\b"), quote_regex(normalize_audit(gold)), F.lit(r"\b"))
    right = F.when(_is_integer(gold), _audit_number(text, completion) == strip(gold)).otherwise(F.regexp_like(normalize_audit(text), whole_words))
    return F.when(category == "code", F.lit("review")).when(F.coalesce(right, F.lit(False)), F.lit("correct")).otherwise(F.lit("wrong"))


def audit_fingerprint(text: Column, gold: Column, completion: Column) -> Column:
    """What an output answered: its last number, else the text after the last ``answer:``, else its end."""
    marker = rf"(?is)\A.*answer{S}*:"
    words = F.when(F.regexp_like(text, F.lit(marker)), F.left(normalize_audit(F.regexp_replace(text, marker, "")), F.lit(60))).otherwise(F.right(normalize_audit(text), F.lit(60)))
    return F.when(_is_integer(gold), F.coalesce(_audit_number(text, completion), F.lit("<no-number>"))).otherwise(words)


def audit_class(n_correct: Column, n_samples: Column, n_wrong_answers: Column) -> Column:
    return (
        F.when(n_correct == n_samples, "all correct (greedy was unlucky)")
        .when(n_correct > 0, "mixed (greedy was unlucky; sampling recovers it)")
        .when(n_wrong_answers <= 1, "STABLE failure (same wrong answer every run)")
        .otherwise("UNSTABLE failure (different wrong answers each run)")
    )


def drifted(text: Column) -> Column:
    """Whether the text after the first line that is not blank starts tasks of its own."""
    full = F.filter(lines(text), lambda x: ~is_blank(x))
    return let(full, lambda f: (F.size(f) >= 2) & F.regexp_like(F.array_join(F.slice(f, 2, F.greatest(F.size(f) - 1, F.lit(1))), "\n"), F.lit(DRIFT)))


def repetition_score(text: Column) -> Column:
    """Share of repeated lines among stripped lines of over three characters, to three places; 0 below two lines."""
    kept = F.filter(F.transform(lines(text), strip), lambda x: F.length(x) > 3)
    return let(kept, lambda k: F.when(F.size(k) < 2, F.lit(0.0)).otherwise(F.round(1 - F.size(F.array_distinct(k)).cast("double") / F.size(k), 3)))


def refused(text: Column) -> Column:
    return F.regexp_like(first_paragraph(text), F.lit(REFUSAL))


__all__ = ["DRIFT", "REFUSAL", "WS", "audit_class", "audit_fingerprint", "audit_judge", "drifted", "grade_ablation", "grade_eval20", "number_completion", "number_final", "refused", "repetition_score"]
