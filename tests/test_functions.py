import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import extract as x
from tallyforge.functions import legacy, prompts, stats, text


def values(spark, rows, schema, **columns):
    df = spark.createDataFrame(rows, schema)
    return [r.asDict(recursive=True) for r in df.select(*[c.alias(n) for n, c in columns.items()]).collect()]


NUMBERS = [
    # text, status, number, strategy, unit, flags
    ("10", "parsed", 10.0, "last_number", None, []),
    ("The answer is $10.", "parsed", 10.0, "answer_is", None, []),
    (r"\boxed{24 \text{ cm}^2}", "parsed", 24.0, "boxed", None, []),
    ("So Maria pays **$24** in total.", "parsed", 24.0, "bold", None, []),
    ("The area is 24 cm^2", "parsed", 24.0, "last_number", "cm^2", []),
    ("There are 1,234 apples", "parsed", 1234.0, "last_number", "apples", []),
    ("The answer is 3/4", "parsed", 0.75, "answer_is", None, []),
    ("5\n\nSome other question\nAnswer: 99", "parsed", 99.0, "answer_colon", None, []),
    ("The answer is 5. Wait, the answer is 6.", "parsed", 6.0, "answer_is", None, ["multiple_distinct_values"]),
    (r"The answer is \boxed{}", "malformed", None, "boxed", None, ["boxed_malformed"]),
    (r"\boxed{5} or maybe \boxed{6}", "ambiguous", None, "boxed", None, []),
    (r"\boxed{5} and \boxed{7", "parsed", 5.0, "boxed", None, ["boxed_malformed"]),
    (r"\boxed{x} then \boxed{7}", "parsed", 7.0, "boxed", None, []),
    (r"\boxed{\boxed{3}}", "parsed", 3.0, "boxed", None, []),
    (r"\boxed{12} = 12 kg", "parsed", 12.0, "boxed", "kg", []),
    ("answer 42", "parsed", 42.0, "answer_is", None, []),
    ("answer is approximately 42 km", "parsed", 42.0, "answer_is", "km", []),
    ("answer is: 42", "parsed", 42.0, "last_number", None, []),
    ("The final answer, after all: 42", "parsed", 42.0, "final_answer", None, []),
    ("2 + 2 = 4 apples", "parsed", 4.0, "equals", "apples", []),
    ("5-3", "parsed", -3.0, "last_number", None, ["multiple_distinct_values"]),
    ("cm^2", "unparsed", None, None, None, ["no_numeric_candidate"]),
    ("10^23", "parsed", 3.0, "last_number", None, ["multiple_distinct_values"]),
    ("no numbers", "unparsed", None, None, None, ["no_numeric_candidate"]),
    (" \n ", "unparsed", None, None, None, ["empty_output"]),
    ("answer is 1/0", "unparsed", None, None, None, ["no_numeric_candidate"]),
]


def test_numbers(spark):
    got = values(spark, [(t,) for t, *_ in NUMBERS], "t string", e=x.extract_answer(F.col("t"), F.lit("number"), F.lit("full"), F.lit(None).cast("array<string>"), F.lit(None).cast("string")))
    for (t, *want), row in zip(NUMBERS, got, strict=True):
        e = row["e"]
        assert [e["status"], e["prediction_num"], e["strategy"], e["unit"], e["flags"]] == want, t
    assert got[10]["e"]["candidates_num"] == [5.0, 6.0]
    assert {r["e"]["extraction_version"] for r in got} == {"extract_v1"}


def boxes_by_hand(t):
    found = []
    for m in re.finditer(r"\\boxed\s*\{", t):
        depth, end = 1, m.end()
        while end < len(t) and depth:
            depth += {"{": 1, "}": -1}.get(t[end], 0)
            end += 1
        found.append(None if depth else t[m.end() : end - 1])
    return found


def test_boxes_of_random_braces(spark):
    rng = random.Random(1)
    parts = ["\\boxed{", "\\boxed {", "\\boxed\u2003{", "\\boxed", "{", "}", "}", "12", "^3", " 4 / 5 ", "-$1,200.50", "x", "\\", "\U0001f600", "\n", "a-b", "7"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(0, 25))) for _ in range(1500)] + ["", "{" * 300 + "\\boxed{1}" + "}" * 400]
    got = values(spark, [(t,) for t in texts], "t string", t=F.col("t"), b=x.find_boxed(F.col("t")))
    assert [r["b"] for r in got] == [boxes_by_hand(r["t"]) for r in got]


@pytest.mark.parametrize(
    ("t", "status", "number", "n"),
    [
        ("\\boxed{7} " * 10_000, "parsed", 7.0, 10_000), ("\\boxed{" * 10_000 + "7" + "}" * 10_000, "parsed", 7.0, 10_000), ("\\boxed{" * 10_000, "malformed", None, 0),
        ("\\boxed{a{b}7} " * 3000, "parsed", 7.0, 3000), ("\\boxed{5}" + "{" * 20_000 + "}" * 20_000, "parsed", 5.0, 1), ("".join(f"\\boxed{{{i}}}" for i in range(4000)), "ambiguous", None, 4000),
    ],
)
def test_very_many_boxes(spark, t, status, number, n):
    [row] = values(spark, [(t,)], "t string", e=x.extract_number(F.col("t")))
    assert (row["e"]["status"], row["e"]["prediction_num"], len(row["e"]["candidates_num"])) == (status, number, n)


def test_first_paragraph_scope(spark):
    got = values(spark, [("5\n\nSome other question\nAnswer: 99",)], "t string", e=x.extract_answer(F.col("t"), F.lit("number"), x.scope_for_condition(F.lit("few_shot_x")), F.lit(None).cast("array<string>"), F.lit(None).cast("string")))
    assert got[0]["e"]["prediction_num"] == 5.0


@pytest.mark.parametrize(
    ("kind", "t", "gold", "status", "prediction"),
    [
        ("label", "This is not spam at all", "spam", "parsed", "not spam"),
        ("label", "spam but not spam", "spam", "parsed", "spam"),
        ("label", "nothing", "spam", "unparsed", None),
        ("yesno", "Whiskers is an animal.", "no", "unparsed", None),
        ("yesno", "YES, and no", "yes", "parsed", "yes"),
        ("yesno", "éyes", "yes", "unparsed", None),
        ("string", "The meeting is next Friday.", "June 14, 2026", "unparsed", None),
        ("name", 'It is  "The   KNIGHT".', " knight. ", "parsed", "knight"),
    ],
)
def test_words(spark, kind, t, gold, status, prediction):
    labels = F.array(F.lit("spam"), F.lit("not spam"))
    [row] = values(spark, [(t, gold)], "t string, gold string", e=x.extract_answer(F.col("t"), F.lit(kind), F.lit("full"), labels, F.col("gold")))
    assert (row["e"]["status"], row["e"]["prediction_str"]) == (status, prediction)


def test_match(spark):
    e = lambda v: x.result("parsed", number=F.lit(v))
    [row] = values(spark, [(1,)], "a int", half=x.answers_match(e(0.5), F.lit("1/2"), F.lit("number")), off=x.answers_match(e(0.5), F.lit("0.6"), F.lit("number")), none=x.answers_match(x.result("unparsed"), F.lit("1"), F.lit("number")), bad=x.answers_match(e(0.5), F.lit("June"), F.lit("number")))
    assert row == {"half": True, "off": False, "none": False, "bad": False}


def test_errors(spark):
    with pytest.raises(Exception, match="needs labels"):
        values(spark, [("a",)], "t string", e=x.extract_answer(F.col("t"), F.lit("label"), F.lit("full"), F.lit(None).cast("array<string>"), F.lit("a")))


def test_text_primitives(spark):
    rows = [("\n \n  a b \n\n c",), ("",), (" \t\n",), ("x\r\ny\x0bz  w ",)]
    got = values(spark, rows, "t string", p=text.first_paragraph(F.col("t")), n=text.nonempty_lines(F.col("t")), blank=text.is_blank(F.col("t")))
    for (t,), row in zip(rows, got, strict=True):
        lines = [ln.strip() for ln in t.splitlines() if ln.strip()]
        assert row["n"] == lines
        assert row["blank"] == (not t.strip())
    assert [r["p"] for r in got] == ["a b", "", "", "x\r\ny\x0bz  w"]
    [row] = values(spark, [(' " A  b.. " ',)], "t string", n=text.normalize_text(F.col("t")), a=text.normalize_audit(F.col("t")))
    assert row == {"n": "a b", "a": '" a b.. "'}


def test_parse_number(spark):
    tokens = ["$1,234.50", "-3.", "3/4", "1/0", "a", "", "5d", "1_000", "1/2/3", ".5", "2 / 4", "-"]
    got = [r["v"] for r in values(spark, [(t,) for t in tokens], "t string", v=text.parse_number(F.col("t")))]
    assert got == [1234.5, -3.0, 0.75, None, None, None, None, None, None, 0.5, 0.5, None]


def test_wilson_and_mcnemar(spark):
    import math

    pairs = [(31, 50), (0, 0), (0, 10), (10, 10), (14, 20)]
    low, high = stats.wilson_bounds(F.col("k"), F.col("n"))
    got = [(r["lo"], r["hi"]) for r in values(spark, pairs, "k long, n long", lo=low, hi=high)]
    assert got[0] == (0.482, 0.741)
    assert got[1] == (0.0, 0.0)
    assert got[4] == (0.481, 0.855)
    cases = [(0, 0), (2, 5), (1, 3), (3, 1), (4, 5), (0, 7), (50, 90), (300, 420), (5000, 5200)]
    for (b, c), row in zip(cases, values(spark, cases, "b long, c long", p=stats.mcnemar_exact_p(F.col("b"), F.col("c"))), strict=True):
        n = b + c
        exact = min(1.0, 2 * sum(math.comb(n, i) for i in range(min(b, c) + 1)) / 2**n) if n else 1.0
        assert row["p"] == pytest.approx(exact, abs=6e-5), (b, c)


def test_mcnemar_of_any_size(spark):
    import math
    from fractions import Fraction

    def exact(b, c):
        n, k = b + c, min(b, c)
        return float(min(Fraction(1), Fraction(2 * sum(math.comb(n, i) for i in range(k + 1)), 2**n))) if n else 1.0

    def summed(b, c):  # terms from the largest down, by their logarithms
        n, k = b + c, min(b, c)
        log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2)
        return min(1.0, 2 * math.fsum(math.exp(log(i)) for i in range(max(0, k - 40_000), k + 1)))

    rng = random.Random(2)
    small = [(b, c) for b in range(22) for c in range(22)] + [(rng.randrange(60), rng.randrange(2000)) for _ in range(60)]
    middle = [(2500 + d, 2700 - d) for d in range(0, 260, 20)] + [(0, 5200), (1, 5199), (40, 5000), (2000, 3200)]
    large = [(500_000 - d, 500_000 + d) for d in (1, 10, 300, 900, 1500, 3000)] + [(100_000, 101_000)]
    pairs = small + middle + large
    got = [r["p"] for r in values(spark, pairs, "b long, c long", p=stats.mcnemar_exact_p(F.col("b"), F.col("c"), None))]
    for (b, c), p in zip(pairs, got, strict=True):
        want = (summed if b + c > 6000 else exact)(b, c)
        assert p == pytest.approx(want, abs=1e-9), (b, c)
        if b + c <= 50:
            assert p == want, (b, c)
        if b + c <= 6000 and want > 1e-290:
            assert p == pytest.approx(want, rel=1e-9), (b, c)
    # around the middle of a thousand million pairs the normal curve is exact to eight places
    n = 1_000_000_000
    cases = [(n // 2 - int(z * math.sqrt(n) / 2), n // 2 + int(z * math.sqrt(n) / 2)) for z in (0.1, 0.5, 1.0, 2.0, 3.0, 5.0)]
    got = [r["p"] for r in values(spark, cases, "b long, c long", p=stats.mcnemar_exact_p(F.col("b"), F.col("c"), None))]
    for (b, c), p in zip(cases, got, strict=True):
        assert p == pytest.approx(math.erfc((c - b - 1) / math.sqrt(2 * (b + c))), rel=1e-7)
    [row] = values(spark, [(None, 3)], "b long, c long", p=stats.mcnemar_exact_p(F.col("b"), F.col("c")))
    assert row["p"] is None


def test_legacy_numbers(spark):
    rows = [("answer is 5, no, answer is 6",), ("so **about 7 kg** and = 9",), ("a = 3 b = 4, 8",), ("1 2 3",), ("none",), ("Answer: 12 then 13",)]
    got = values(spark, rows, "t string", final=legacy.number_final(F.col("t")), first=legacy.number_completion(F.col("t")))
    assert [r["final"] for r in got] == [6.0, 7.0, 4.0, 3.0, None, 13.0]
    assert [r["first"] for r in got] == [5.0, 7.0, 3.0, 1.0, None, 12.0]


def test_grade_eval20_scopes(spark):
    none = F.lit(None).cast("array<string>")
    rows = [("4\n\nAnswer: 9", "4", "number", "base_few_shot"), ("4\n\nAnswer: 9", "9", "number", "base_zero_shot"), ("none\n\n7", "7", "number", "base_few_shot"), ("a\nb\nc\nd Ann", "ann", "name", "base_zero_shot"), ("Ann\nb\nc\nd", "ann", "name", "base_zero_shot"), ("", "1", "number", "base_zero_shot")]
    got = values(spark, rows, "t string, g string, k string, c string", g=legacy.grade_eval20(F.col("t"), F.col("g"), F.col("k"), none, F.col("c")), a=legacy.grade_ablation(F.col("t"), F.col("g"), F.col("k"), none, F.lit("A_original")))
    assert [r["g"]["correct"] for r in got] == [True, True, True, True, False, False]
    assert got[2]["g"]["flags"] == ["needs_review"]
    assert got[5]["g"]["flags"] == ["empty_output"]


def test_audit(spark):
    rows = [("so 3, then 10", "10", "math"), ("10 or 3", "10", "math"), ("Ann is a knight", "knight", "logic"), ("knights", "knight", "logic"), ("x", "y", "code"), ("a (b) c", "(b)", "logic")]
    got = values(spark, rows, "t string, g string, c string", v=legacy.audit_judge(F.col("t"), F.col("g"), F.col("c"), F.lit(False)), f=legacy.audit_fingerprint(F.col("t"), F.col("g"), F.lit(False)))
    assert [r["v"] for r in got] == ["correct", "wrong", "correct", "wrong", "review", "wrong"]
    assert got[1]["f"] == "3"
    assert values(spark, [("x Answer:  The END",)], "t string", f=legacy.audit_fingerprint(F.col("t"), F.lit("z"), F.lit(False)))[0]["f"] == "the end"


def test_behavior(spark):
    rows = [("4\nQuestion: what?",), ("4",), ("4\nis it so?\nyes",), ("abcd\nabcd\nefgh\nab",), ("I'm sorry, as an AI",), ("a\n\nI'm sorry",)]
    got = values(spark, rows, "t string", d=legacy.drifted(F.col("t")), r=legacy.repetition_score(F.col("t")), x=legacy.refused(F.col("t")))
    assert [r["d"] for r in got] == [True, False, True, False, False, False]
    assert got[3]["r"] == 0.333
    assert [r["x"] for r in got] == [False, False, False, False, True, False]


PREFIX = "Q: 1+1?\nAnswer: 2\n\nQ: 2+2?\nCode:\ndef f():\n  return 4\n\n"


def test_prompts(spark):
    rows = [(7, PREFIX, "Q: 3+3?\nAnswer:")]
    p, q = F.col("p"), F.col("q")
    [row] = values(
        spark, rows, "i long, p string, q string", cot=prompts.cot_prompt(q), few=prompts.few_shot_prompt(p, q), form=prompts.few_shot_format_only(p, q),
        rand=prompts.few_shot_random_label(F.col("i"), p, q), hashed=prompts.few_shot_hashed_label(F.col("i"), p, q), formats=prompts.ablation_prompts(p, q),
    )
    assert row["cot"] == "Q: 3+3?\n" + prompts.COT_INSTRUCTION
    assert row["few"] == PREFIX + rows[0][2]
    assert row["form"] == "Q: 1+1?\nAnswer: ?\n\nQ: 2+2?\nCode: ?\n\nQ: 3+3?\nAnswer:"
    answers = ["2", "def f():\n  return 4"]
    random.Random(prompts.PERMUTATION_SEED + 7).shuffle(answers)
    assert row["rand"] == f"Q: 1+1?\nAnswer: {answers[0]}\n\nQ: 2+2?\nCode: {answers[1]}\n\nQ: 3+3?\nAnswer:"
    assert sorted(row["formats"]) == ["A_original", "B_delimiters", "C_delimiters_and_instruction", "D_instruction_only"]
    assert row["formats"]["B_delimiters"] == f"<EXAMPLES>\n{PREFIX.rstrip()}\n</EXAMPLES>\n\n<TARGET>\nQ: 3+3?\n</TARGET>\n\nAnswer:"
    with pytest.raises(Exception, match="answer marker"):
        values(spark, [("no marker here",)], "p string", f=prompts.few_shot_format_only(F.col("p"), F.lit("q")))


def test_seed(spark):
    import hashlib

    [row] = values(spark, [("m", 3)], "m string, i long", s=prompts.sample_seed(F.lit(42), F.col("m"), F.col("i")))
    assert row["s"] == int(hashlib.sha256(b"42|m|3").hexdigest()[:8], 16)


def test_plain_numbers_and_strips_need_no_pattern(spark):
    """What is stripped and parsed on the short way is as before."""
    from tallyforge.functions import boxes

    shown = text.strip(F.col("t"))._jc.toString()
    assert "btrim" in shown and "regexp" not in shown
    got = values(spark, [(t,) for t in ("  7\x1c", "7", "-7.50", "7.", "$1,0.", "3/4", "")], "t string", s=text.strip(F.col("t")), n=text.parse_number(F.col("t")))
    assert [r["s"] for r in got] == ["7", "7", "-7.50", "7.", "$1,0.", "3/4", ""]
    assert [r["n"] for r in got] == [7.0, 7.0, -7.5, 7.0, 10.0, 0.75, None]
    many = [((i * 7) % 5 - 2) for i in range(1000)]
    [r] = values(spark, [(many,)], "a array<long>", r=boxes.running(F.col("a")))
    assert list(r["r"]) == [sum(many[: i + 1]) for i in range(1000)]
