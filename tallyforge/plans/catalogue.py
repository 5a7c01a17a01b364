"""The catalogue of engine queries over the driver's tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions import extract, legacy, prompts, stats, text
from tallyforge.operators import compare, contain, grade, metrics, report, runs, validate
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import ORACLES, QUERIES, query

#: strip() and the word borders of the oracle's regular expressions.
_STRIP = r"regexp_replace({}, '^\s+|\s+$', '', 'g')"


def _col(name: str):
    return F.col(name)


def _null_labels():
    return F.lit(None).cast("array<string>")


def _graded(spark, d) -> DataFrame:
    """Number completions with their extraction and whether they are right."""
    rows = b.completions(spark, d).withColumn("e", extract.extract_answer(_col("completion_text"), F.lit("number"), F.lit("full"), _null_labels(), _col("gold_answer")))
    return rows.withColumn("correct", extract.answers_match(_col("e"), _col("gold_answer"), F.lit("number"))).withColumn("status", _col("e.status"))


# ---- text


@query("first_paragraph", f"WITH {b.TRANSCRIPTS_SQL} SELECT conv_id, coalesce(list_filter(list_transform(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1], '') AS paragraph FROM transcripts")
def first_paragraph(spark, d):
    return b.transcripts(spark, d).select("conv_id", text.first_paragraph(_col("text")).alias("paragraph"))


@query("nonempty_lines", f"SELECT doc_id, len(l)::BIGINT AS n_lines, coalesce(l[1], '') AS first_line FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '') AS l FROM documents)")
def nonempty_lines(spark, d):
    lines = text.nonempty_lines(_col("text"))
    return b.table(spark, d, "documents").select("doc_id", F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.try_element_at(lines, F.lit(1)), F.lit("")).alias("first_line"))


@query("normalize_text", rf"""SELECT doc_id, md5(lower(regexp_replace(regexp_replace({_STRIP.format("regexp_replace(" + _STRIP.format("text") + ", '^\"+|\"+$', '', 'g')")}, '\.+$', ''), '\s+', ' ', 'g'))) AS digest FROM documents""")
def normalize_text(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.md5(text.normalize_text(_col("text"))).alias("digest"))


@query("number_tokens", rf"SELECT doc_id, len(t)::BIGINT AS n_tokens, array_to_string(t, ';') AS tokens FROM (SELECT doc_id, regexp_extract_all(text, '{b._N}') AS t FROM documents)")
def number_tokens(spark, d):
    tokens = text.number_tokens(_col("text"))
    return b.table(spark, d, "documents").select("doc_id", F.size(tokens).cast("long").alias("n_tokens"), F.array_join(tokens, ";").alias("tokens"))


@query(
    "parse_number",
    """SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 1000.0 + p_size WHEN 1 THEN -1.0 * p_size WHEN 2 THEN p_size / 4.0 WHEN 3 THEN NULL ELSE round(p_retailprice, 2) END AS number FROM part""",
)
def parse_number(spark, d):
    size = _col("p_size").cast("string")
    token = (
        F.when(_col("p_partkey") % 5 == 0, F.concat(F.lit("$1,"), F.lpad(size, 3, "0"), F.lit(".")))
        .when(_col("p_partkey") % 5 == 1, F.concat(F.lit("-"), size)).when(_col("p_partkey") % 5 == 2, F.concat(size, F.lit(" / 4")))
        .when(_col("p_partkey") % 5 == 3, F.concat(size, F.lit("/0"))).otherwise(F.format_string("%.2f", "p_retailprice"))
    )
    return b.table(spark, d, "part").select("p_partkey", text.parse_number(token).alias("number"))


# ---- extraction of the current rule set


@query("extract_number_v1", f"WITH {b.EXTRACTED_SQL} SELECT problem_id, line, model_id, status, strategy, prediction FROM graded")
def extract_number_v1(spark, d):
    return _graded(spark, d).select("problem_id", "line", "model_id", "status", _col("e.strategy").alias("strategy"), _col("e.prediction_num").alias("prediction"))


@query("extract_number_candidates", f"WITH {b.EXTRACTED_SQL} SELECT strategy, count(*)::BIGINT AS n, sum(len(vals))::BIGINT AS n_candidates, sum(CASE WHEN len(list_distinct(vals)) > 1 THEN 1 ELSE 0 END)::BIGINT AS n_several FROM graded GROUP BY 1")
def extract_number_candidates(spark, d):
    several = F.array_contains("e.flags", "multiple_distinct_values")
    return _graded(spark, d).groupBy(_col("e.strategy").alias("strategy")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("e.candidates_num")).cast("long").alias("n_candidates"), F.count_if(several).cast("long").alias("n_several"))


@query("extract_number_unit", f"WITH {b.COMPLETIONS_SQL} SELECT line, CASE line WHEN 1 THEN 'units' WHEN 4 THEN 'kg' WHEN 6 THEN 'boxes' WHEN 7 THEN 'apples' END AS unit, count(*)::BIGINT AS n FROM completions GROUP BY 1")
def extract_number_unit(spark, d):
    return _graded(spark, d).groupBy("line", _col("e.unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "extract_yesno",
    r"""SELECT doc_id, nullif(lower(regexp_extract(t, '(?i)(?:^|[^\p{L}\p{N}_])(yes|no)(?:$|[^\p{L}\p{N}_])', 1)), '') AS answer
    FROM (SELECT d.doc_id, CASE l.quality WHEN 1 THEN 'Yes. ' WHEN 0 THEN 'No, ' ELSE '' END || d.text AS t FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)""",
)
def extract_yesno(spark, d):
    docs, labels = b.table(spark, d, "documents"), b.table(spark, d, "labels").select("doc_id", "quality")
    lead = F.when(_col("quality") == 1, "Yes. ").when(_col("quality") == 0, "No, ").otherwise("")
    return docs.join(labels, "doc_id", "left").select("doc_id", extract.extract_yesno(F.concat(lead, "text"))["prediction_str"].alias("answer"))


@query(
    "extract_label",
    """WITH t AS (SELECT event_id, lower(CASE event_id % 3 WHEN 0 THEN 'This is NOT error but ' || event_type WHEN 1 THEN event_type || ' then error' ELSE 'nothing' END) AS s FROM events
    ), m AS (SELECT event_id, instr(s, 'not error') AS p1, replace(s, 'not error', '#########') AS s2 FROM t
    ), n AS (SELECT event_id, p1, instr(s2, 'error') AS p2, instr(replace(s2, 'error', '#####'), 'click') AS p3 FROM m)
    SELECT event_id, CASE WHEN p1 > 0 AND (p2 = 0 OR p1 < p2) AND (p3 = 0 OR p1 < p3) THEN 'not error' WHEN p2 > 0 AND (p3 = 0 OR p2 < p3) THEN 'error' WHEN p3 > 0 THEN 'click' END AS label,
      ((p1 > 0)::INT + (p2 > 0)::INT + (p3 > 0)::INT)::BIGINT AS n_candidates FROM n""",
)
def extract_label(spark, d):
    kind = _col("event_type")
    said = F.when(_col("event_id") % 3 == 0, F.concat(F.lit("This is NOT error but "), kind)).when(_col("event_id") % 3 == 1, F.concat(kind, F.lit(" then error"))).otherwise("nothing")
    labels = F.array(F.lit("error"), F.lit("Not error"), F.lit("click"))
    found = b.table(spark, d, "events").select("event_id", extract.extract_label(said, labels).alias("e"))
    return found.select("event_id", _col("e.prediction_str").alias("label"), F.size("e.candidates_str").cast("long").alias("n_candidates"))


_NORM_SQL = rf"lower(regexp_replace(regexp_replace({_STRIP.format("regexp_replace(" + _STRIP.format("{0}") + ", '^\"+|\"+$', '', 'g')")}, '\.+$', ''), '\s+', ' ', 'g'))"


@query(
    "contains_gold",
    f"""WITH t AS (SELECT d.doc_id, d.text, CASE WHEN d.doc_id % 2 = 0 THEN '  ' || substr(d.text, 5, 30) || '.' ELSE b.text END AS gold FROM documents d JOIN (SELECT text, row_number() OVER (ORDER BY item_id) - 1 AS place, count(*) OVER () AS n FROM benchmark) b ON d.doc_id % b.n = b.place)
    SELECT doc_id, contains({_NORM_SQL.format("text")}, {_NORM_SQL.format("gold")}) AS found FROM t""",
)
def contains_gold(spark, d):
    items = b.table(spark, d, "benchmark")
    n = items.count()
    placed = items.select((F.row_number().over(Window.orderBy("item_id")) - 1).alias("place"), _col("text").alias("item"))  # a benchmark is small
    docs = b.table(spark, d, "documents").join(placed, _col("doc_id") % n == _col("place"))
    gold = F.when(_col("doc_id") % 2 == 0, F.concat(F.lit("  "), F.substring("text", 5, 30), F.lit("."))).otherwise(_col("item"))
    return docs.select("doc_id", (extract.extract_containment(_col("text"), gold)["status"] == "parsed").alias("found"))


@query(
    "containments",
    f"""WITH golds AS (SELECT item_id AS gold_id, text AS gold FROM benchmark UNION ALL SELECT 1000000 + item_id, left(text, 8) FROM benchmark UNION ALL SELECT 2000000 + n_nationkey, n_name FROM nation),
      t AS (SELECT doc_id AS text_id, {_NORM_SQL.format("text")} AS t FROM documents WHERE text IS NOT NULL), g AS (SELECT gold_id, {_NORM_SQL.format("gold")} AS g FROM golds)
    SELECT text_id, gold_id FROM t JOIN g ON contains(t, g)""",
)
def containments(spark, d):
    """Every document against every item, the beginning of every item, and the names of nations: all pairs of which one contains the other."""
    items, nations = b.table(spark, d, "benchmark"), b.table(spark, d, "nation")
    golds = items.select(_col("item_id").alias("gold_id"), _col("text").alias("gold")).unionByName(items.select((1_000_000 + _col("item_id")).alias("gold_id"), F.left("text", F.lit(8)).alias("gold")))
    golds = golds.unionByName(nations.select((2_000_000 + _col("n_nationkey")).alias("gold_id"), _col("n_name").alias("gold")))
    return contain.containments(b.table(spark, d, "documents"), golds, text_id="doc_id", text="text", gold_id="gold_id", gold="gold")


@query("answers_match", f"WITH {b.EXTRACTED_SQL} SELECT model_id, line, count(*)::BIGINT AS n, sum(correct::INT)::BIGINT AS n_correct FROM graded GROUP BY 1, 2")
def answers_match(spark, d):
    return _graded(spark, d).groupBy("model_id", "line").agg(*metrics.accuracy_columns())


@query("parse_failures", rf"WITH {b.TRANSCRIPTS_SQL} SELECT conv_id, CASE WHEN regexp_matches(text, '\S') THEN 'no_numeric_candidate' ELSE 'empty_output' END AS flag FROM transcripts WHERE NOT regexp_matches(text, '\d')")
def parse_failures(spark, d):
    e = extract.extract_answer(_col("text"), F.lit("number"), F.lit("full"), _null_labels(), F.lit("1"))
    rows = b.transcripts(spark, d).select("conv_id", e.alias("e")).select("conv_id", "e.*")
    return grade.parse_failures(rows).filter("status = 'unparsed'").select("conv_id", _col("flags")[0].alias("flag"))


# ---- older rule sets


@query("eval20_number_final", "SELECT l_linenumber::BIGINT AS line, count(*)::BIGINT AS n, sum(l_quantity::BIGINT)::BIGINT AS total FROM lineitem GROUP BY 1")
def eval20_number_final(spark, d):
    return b.completions(spark, d).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum(legacy.number_final(_col("completion_text"))).cast("long").alias("total"))


@query("eval20_first_number", rf"WITH {b.COMPLETIONS_SQL} SELECT line, count(*)::BIGINT AS n, sum(try_cast(regexp_extract(completion_text, '-?\$?\d[\d,]*\.?\d*') AS DOUBLE))::BIGINT AS total FROM completions GROUP BY 1")
def eval20_first_number(spark, d):
    return b.completions(spark, d).groupBy("line").agg(F.count(F.lit(1)).alias("n"), F.sum(legacy.number_completion(_col("completion_text"))).cast("long").alias("total"))


@query(
    "eval20_scope",
    rf"""WITH {b.TRANSCRIPTS_SQL}, s AS (SELECT conv_id, text, coalesce(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_matches(x, '\S'))[1], '') AS para FROM transcripts)
    SELECT conv_id, contains(lower(para), 'the') AS in_paragraph, contains(lower(text), 'the') AS in_text FROM s""",
)
def eval20_scope(spark, d):
    g = lambda c: legacy.grade_eval20(_col("text"), F.lit("The"), F.lit("string"), _null_labels(), F.lit(c))["correct"]
    return b.transcripts(spark, d).select("conv_id", g("x_few_shot").alias("in_paragraph"), g("x_zero_shot").alias("in_text"))


@query("ablation_grade", f"WITH {b.COMPLETIONS_SQL} SELECT line, count(*)::BIGINT AS n, sum((regexp_extract(completion_text, '\\d+') = gold_answer)::INT)::BIGINT AS n_correct FROM completions GROUP BY 1")
def ablation_grade(spark, d):
    g = legacy.grade_ablation(_col("completion_text"), _col("gold_answer"), F.lit("number"), _null_labels(), F.lit("D_instruction_only"))
    return b.completions(spark, d).withColumn("correct", g["correct"]).groupBy("line").agg(*metrics.accuracy_columns())


_AUDIT_SQL = f"{b.COMPLETIONS_SQL}, judged AS (SELECT problem_id, line, regexp_extract_all(completion_text, '-?\\d+')[-1] AS fingerprint, gold_answer FROM completions)"


@query("audit_judge", f"WITH {_AUDIT_SQL} SELECT line, CASE WHEN fingerprint = gold_answer THEN 'correct' ELSE 'wrong' END AS verdict, count(*)::BIGINT AS n FROM judged GROUP BY 1, 2")
def audit_judge(spark, d):
    verdict = legacy.audit_judge(_col("completion_text"), _col("gold_answer"), F.lit("math"), F.lit(False))
    return b.completions(spark, d).groupBy("line", verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


@query("audit_fingerprint", f"WITH {_AUDIT_SQL} SELECT line, fingerprint, count(*)::BIGINT AS n FROM judged GROUP BY 1, 2")
def audit_fingerprint(spark, d):
    return b.completions(spark, d).groupBy("line", legacy.audit_fingerprint(_col("completion_text"), _col("gold_answer"), F.lit(False)).alias("fingerprint")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "audit_classify",
    f"""WITH {_AUDIT_SQL}, g AS (SELECT problem_id, count(*)::BIGINT AS n_samples, count(*) FILTER (WHERE fingerprint = gold_answer)::BIGINT AS n_correct,
      list_sort(list_distinct(list(fingerprint) FILTER (WHERE fingerprint <> gold_answer))) AS w FROM judged GROUP BY 1)
    SELECT problem_id, n_samples, n_correct, coalesce(array_to_string(w, ','), '') AS wrong_answers, CASE WHEN n_correct = n_samples THEN 'all correct (greedy was unlucky)'
      WHEN n_correct > 0 THEN 'mixed (greedy was unlucky; sampling recovers it)' WHEN len(w) <= 1 THEN 'STABLE failure (same wrong answer every run)'
      ELSE 'UNSTABLE failure (different wrong answers each run)' END AS verdict FROM g""",
)
def audit_classify(spark, d):
    samples = b.completions(spark, d).select("problem_id", F.lit("math").alias("category"), "gold_answer", _col("completion_text").alias("output"))
    return grade.audit_samples(samples, ["problem_id"]).select("problem_id", "n_samples", "n_correct", F.array_join("unique_wrong_answers", ",").alias("wrong_answers"), "verdict")


_DRIFT_SQL = r"(?i)(^|\n)\s*(answer|sentiment|subject|review|text|question)\s*:|(^|\n)[^\n]*\?\s*($|\n)|you are (a|an) (helpful |ai )?assistant"
_LINES_SQL = r"list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '\S'))"


@query("drift", f"WITH {b.TRANSCRIPTS_SQL} SELECT conv_id, len(l) >= 2 AND regexp_matches(array_to_string(l[2:], chr(10)), '{_DRIFT_SQL}') AS drifted FROM (SELECT conv_id, {_LINES_SQL} AS l FROM transcripts)")
def drift(spark, d):
    return b.transcripts(spark, d).select("conv_id", legacy.drifted(_col("text")).alias("drifted"))


_REPETITION_SQL = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: length(x) > 3)"


@query("repetition", f"SELECT doc_id, CASE WHEN len(l) < 2 THEN 0.0::DOUBLE ELSE round(1 - len(list_distinct(l))::DOUBLE / len(l), 3) END AS score FROM (SELECT doc_id, {_REPETITION_SQL} AS l FROM documents)")
def repetition(spark, d):
    return b.table(spark, d, "documents").select("doc_id", legacy.repetition_score(_col("text")).alias("score"))


@query("refusal", rf"WITH {b.TRANSCRIPTS_SQL} SELECT conv_id, regexp_matches(coalesce(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_matches(x, '\S'))[1], ''), '(?i)unable to|cannot provide|can''t provide|i''m sorry|as an ai') AS refused FROM transcripts")
def refusal(spark, d):
    return b.transcripts(spark, d).select("conv_id", legacy.refused(_col("text")).alias("refused"))


@query(
    "behavior_summary",
    rf"""WITH {b.TRANSCRIPTS_SQL}, m AS (SELECT 'c' || conv_id % 3 AS condition, conv_id, length(text) AS chars, {_REPETITION_SQL} AS r, {_LINES_SQL} AS l,
      coalesce(list_filter(regexp_split_to_array(text, '\n\s*\n'), lambda x: regexp_matches(x, '\S'))[1], '') AS para FROM transcripts
    ), f AS (SELECT *, len(l) >= 2 AND regexp_matches(array_to_string(l[2:], chr(10)), '{_DRIFT_SQL}') AS drift, CASE WHEN len(r) < 2 THEN 0 ELSE round(1 - len(list_distinct(r))::DOUBLE / len(r), 3) END AS rep,
      regexp_matches(para, '(?i)i''m sorry|as an ai') AS ref FROM m)
    SELECT condition, round(avg(drift::INT), 3) AS drift_rate, round(avg(rep), 3) AS mean_repetition, sum(ref::INT)::BIGINT AS n_refusals,
      coalesce(array_to_string(list_sort(list(conv_id) FILTER (WHERE ref)), ','), '') AS refusals, round(avg(chars), 1) AS mean_chars, median(chars)::DOUBLE AS median_chars FROM f GROUP BY 1""",
)
def behavior_summary(spark, d):
    cells = b.transcripts(spark, d).select(F.concat(F.lit("c"), (_col("conv_id") % 3).cast("string")).alias("condition"), _col("conv_id").alias("task_id"), _col("text").alias("output"))
    return metrics.behavior(cells).select("condition", "drift_rate", "mean_repetition", F.size("refusals").cast("long").alias("n_refusals"), F.array_join("refusals", ",").alias("refusals"), "mean_chars", "median_chars")


# ---- statistics and aggregates

_WILSON_SQL = """CASE WHEN n = 0 THEN 0.0 ELSE round((n_correct / n::DOUBLE + 1.96 * 1.96 / (2.0 * n) - 1.96 * sqrt(n_correct / n::DOUBLE * (1 - n_correct / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 3) END AS ci_low,
  CASE WHEN n = 0 THEN 0.0 ELSE round((n_correct / n::DOUBLE + 1.96 * 1.96 / (2.0 * n) + 1.96 * sqrt(n_correct / n::DOUBLE * (1 - n_correct / n::DOUBLE) / n + 1.96 * 1.96 / (4.0 * n * n))) / (1 + 1.96 * 1.96 / n), 3) END AS ci_high"""
_RATES_SQL = f"CASE WHEN n = 0 THEN 0.0 ELSE round(n_correct / n::DOUBLE, 3) END AS accuracy, {_WILSON_SQL}"


@query(
    "model_summary",
    f"""WITH {b.EXTRACTED_SQL}, g AS (SELECT model_id, count(*)::BIGINT AS n, sum(correct::INT)::BIGINT AS n_correct, sum((status = 'parsed')::INT)::BIGINT AS n_parsed, round(avg(coalesce(n_output_tokens, 0)), 1) AS mean_output_tokens FROM graded GROUP BY 1)
    SELECT model_id, n, n_correct, n_parsed, n - n_parsed AS n_unparsed_or_failed, mean_output_tokens, {_RATES_SQL} FROM g""",
)
def model_summary(spark, d):
    return metrics.model_summary(_graded(spark, d))


@query(
    "model_category_rollup",
    f"""WITH {b.EXTRACTED_SQL} SELECT model_id, category, CASE WHEN grouping(category) = 1 THEN 'model' ELSE 'category' END AS level, count(*)::BIGINT AS n, sum(correct::INT)::BIGINT AS n_correct
    FROM graded GROUP BY GROUPING SETS ((model_id), (model_id, category))""",
)
def model_category_rollup(spark, d):
    return metrics.model_category_rollup(_graded(spark, d))


@query(
    "grouping_sets_accuracy",
    f"""WITH {b.CELLS_SQL}, l AS (SELECT condition, 'overall' AS dimension, NULL AS value, final_correct FROM cells UNION ALL SELECT condition, 'category', category, final_correct FROM cells
      UNION ALL SELECT condition, 'difficulty', difficulty, final_correct FROM cells), g AS (SELECT condition, dimension, value, count(*)::BIGINT AS n, sum(final_correct::INT)::BIGINT AS n_correct FROM l GROUP BY 1, 2, 3)
    SELECT condition, dimension, value, n, n_correct, {_RATES_SQL} FROM g""",
)
def grouping_sets_accuracy(spark, d):
    return metrics.accuracy_by(b.cells(spark, d), "condition", ["category", "difficulty"])


@query("wilson", f"WITH g AS (SELECT p_brand, count(*)::BIGINT AS n, count(*) FILTER (WHERE p_size > 25)::BIGINT AS n_correct FROM part GROUP BY 1) SELECT p_brand, n, n_correct, {_RATES_SQL} FROM g")
def wilson(spark, d):
    counted = b.table(spark, d, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.count_if(_col("p_size") > 25).cast("long").alias("n_correct"))
    return metrics.with_rates(counted)


_P_SQL = """CASE WHEN {b} + {c} = 0 THEN 1.0 ELSE round(least(1.0, 2 * list_sum(list_transform(range(least({b}, {c}) + 1), lambda i: exp(lgamma({b} + {c} + 1) - lgamma(i + 1) - lgamma({b} + {c} - i + 1) - ({b} + {c}) * ln(2.0))))), 4) END"""


@query("mcnemar", f"WITH g AS (SELECT p_brand, count(*) FILTER (WHERE p_size <= 20)::BIGINT AS x, count(*) FILTER (WHERE p_size > 28)::BIGINT AS y FROM part GROUP BY 1) SELECT p_brand, x, y, {_P_SQL.format(b='x', c='y')} AS p FROM g")
def mcnemar(spark, d):
    g = b.table(spark, d, "part").groupBy("p_brand").agg(F.count_if(_col("p_size") <= 20).cast("long").alias("x"), F.count_if(_col("p_size") > 28).cast("long").alias("y"))
    return g.withColumn("p", stats.mcnemar_exact_p(_col("x"), _col("y")))


@query(
    "mcnemar_large",
    """WITH g AS (SELECT p_brand, 100000 + 7 * count(*) FILTER (WHERE p_size <= 20)::BIGINT AS x, 100000 + 7 * count(*) FILTER (WHERE p_size > 28)::BIGINT AS y FROM part GROUP BY 1),
      terms AS (SELECT p_brand, x, y, least(x, y) AS k, x + y AS n, unnest(range(least(x, y) - 20000, least(x, y) + 1)) AS i FROM g)
      SELECT p_brand, x, y, round(CASE WHEN x = y THEN 1 ELSE least(1, 2 * sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2::DOUBLE)))) END, 4) AS p FROM terms GROUP BY 1, 2, 3""",
)
def mcnemar_large(spark, d):
    """Hundreds of thousands of discordant pairs: the same work as for a few."""
    g = b.table(spark, d, "part").groupBy("p_brand").agg((100_000 + 7 * F.count_if(_col("p_size") <= 20)).cast("long").alias("x"), (100_000 + 7 * F.count_if(_col("p_size") > 28)).cast("long").alias("y"))
    return g.withColumn("p", stats.mcnemar_exact_p(_col("x"), _col("y")))


@query(
    "pairwise_conditions",
    f"""WITH {b.CELLS_SQL}, p AS (SELECT a.condition || '__vs__' || b.condition AS pair, count(*) FILTER (WHERE a.final_correct AND NOT b.final_correct)::BIGINT AS x, count(*) FILTER (WHERE b.final_correct AND NOT a.final_correct)::BIGINT AS y
      FROM cells a JOIN cells b ON a.task_id = b.task_id AND a.condition < b.condition GROUP BY 1) SELECT pair, x AS n_only_first, y AS n_only_second, {_P_SQL.format(b='x', c='y')} AS mcnemar_exact_p FROM p""",
)
def pairwise_conditions(spark, d):
    return metrics.pairwise(b.cells(spark, d), ["c1", "c2", "c3", "c4"], lists=False).select("pair", "n_only_first", "n_only_second", "mcnemar_exact_p")


# ---- comparison of runs

_SIDE_SQL = "(SELECT model_id, count(*)::BIGINT AS n, sum(correct::INT)::BIGINT AS k, sum((status = 'parsed')::INT)::BIGINT AS p, round(avg(coalesce(n_output_tokens, 0)), 1) AS t FROM {} GROUP BY 1)"


@query(
    "compare_runs",
    f"""WITH {b.RUNS_SQL} SELECT b.model_id, b.n AS baseline_n, b.k AS baseline_n_correct, round(b.k / b.n::DOUBLE, 3) AS baseline_accuracy, b.p AS baseline_n_parsed, b.t AS baseline_mean_output_tokens, t.n AS treatment_n, t.k AS treatment_n_correct,
      round(t.k / t.n::DOUBLE, 3) AS treatment_accuracy, t.p AS treatment_n_parsed, t.t AS treatment_mean_output_tokens, round(round(t.k / t.n::DOUBLE, 3) - round(b.k / b.n::DOUBLE, 3), 3) AS delta_accuracy,
      round((round(t.k / t.n::DOUBLE, 3) - round(b.k / b.n::DOUBLE, 3)) * 100, 1) AS delta_percentage_points FROM {_SIDE_SQL.format('baseline')} b JOIN {_SIDE_SQL.format('treatment')} t ON b.model_id = t.model_id""",
)
def compare_runs(spark, d):
    kept = [f"{s}_{c}" for s in ("baseline", "treatment") for c in ("n", "n_correct", "accuracy", "n_parsed", "mean_output_tokens")]
    return compare.compare_runs(*b.runs(spark, d)).select("model_id", *kept, "delta_accuracy", "delta_percentage_points")


@query("flips", f"WITH {b.RUNS_SQL} SELECT model_id, problem_id, category, flip FROM pairs WHERE flip IS NOT NULL")
def flips(spark, d):
    return compare.flips(compare.paired(*b.runs(spark, d)))


@query(
    "flip_lists",
    f"""WITH {b.RUNS_SQL}, g AS (SELECT model_id, count(*) FILTER (WHERE flip = 'regression')::BIGINT AS x, count(*) FILTER (WHERE flip = 'fix')::BIGINT AS y, md5(coalesce(string_agg(problem_id, ',' ORDER BY problem_id) FILTER (WHERE flip = 'fix'), '')) AS fixes FROM pairs GROUP BY 1)
    SELECT model_id, x AS n_regressions, y AS n_fixes, fixes, {_P_SQL.format(b='x', c='y')} AS mcnemar_exact_p FROM g""",
)
def flip_lists(spark, d):
    lists = compare.flip_lists(compare.paired(*b.runs(spark, d)))
    return lists.select("model_id", "n_regressions", "n_fixes", F.md5(F.array_join(F.transform("fixes", lambda s: s["problem_id"].cast("string")), ",")).alias("fixes"), "mcnemar_exact_p")


@query("flip_by_category", f"WITH {b.RUNS_SQL} SELECT model_id, category, count(*)::BIGINT AS n, sum(b_correct::INT)::BIGINT AS baseline_correct, sum(t_correct::INT)::BIGINT AS treatment_correct, count(flip)::BIGINT AS n_flips FROM pairs GROUP BY 1, 2")
def flip_by_category(spark, d):
    return compare.by_category(compare.paired(*b.runs(spark, d)))


_SAMPLES_SQL = """samples AS (
  SELECT l_orderkey AS problem_id, 'm' || (l_orderkey % 3) AS model_id, l_linenumber AS sample_index, l_linenumber % 2 AS side, l_returnflag <> 'R' AS correct, l_linestatus = 'O' AS parsed, l_partkey % 220 AS tokens, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem
  WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_linenumber % 2) = 2)
), cells AS (
  SELECT * FROM samples QUALIFY row_number() OVER (PARTITION BY problem_id, model_id, side ORDER BY sample_index DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) = 1
), compared AS (
  SELECT b.model_id, b.correct AS b, t.correct AS t, b.parsed AS bp, t.parsed AS tp, b.tokens AS bt, t.tokens AS tt FROM cells b JOIN cells t USING (problem_id, model_id) WHERE b.side = 1 AND t.side = 0
)"""


@query(
    "compare_samples",
    f"""WITH {_SAMPLES_SQL} SELECT model_id, count(*)::BIGINT AS n, sum(b::INT)::BIGINT AS baseline_correct, sum(t::INT)::BIGINT AS treatment_correct, sum((NOT bp)::INT)::BIGINT AS baseline_unparsed, sum((NOT tp)::INT)::BIGINT AS treatment_unparsed,
      round(avg(bt), 1) AS baseline_tokens, round(avg(tt), 1) AS treatment_tokens, sum((b AND NOT t)::INT)::BIGINT AS n_regressions, sum((t AND NOT b)::INT)::BIGINT AS n_fixes FROM compared GROUP BY 1""",
)
def compare_samples(spark, d):
    """Two runs with several records of a cell, all lines of an order: the last record of each cell counts."""
    lines = b.table(spark, d, "lineitem")
    both = lines.groupBy(_col("l_orderkey").alias("k")).agg(F.count_distinct(_col("l_linenumber") % 2).alias("sides")).filter("sides = 2")
    samples = lines.join(both, _col("l_orderkey") == _col("k"), "left_semi").select(
        F.concat(F.lit("m"), (_col("l_orderkey") % 3).cast("string")).alias("model_id"), _col("l_orderkey").alias("problem_id"), _col("l_linenumber").cast("long").alias("sample_index"), (_col("l_returnflag") != "R").alias("correct"),
        F.when(_col("l_linestatus") == "O", "parsed").otherwise("unparsed").alias("status"), F.lit("all").alias("category"), (_col("l_partkey") % 220).alias("n_output_tokens"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("log_position"),
    )
    sides = samples.filter("sample_index % 2 = 1"), samples.filter("sample_index % 2 = 0")
    flips = compare.paired(*sides).groupBy("model_id").agg(F.count_if(_col("flip") == "regression").cast("long").alias("n_regressions"), F.count_if(_col("flip") == "fix").cast("long").alias("n_fixes"))
    named = {"n": "baseline_n", "baseline_correct": "baseline_n_correct", "treatment_correct": "treatment_n_correct", "baseline_unparsed": "baseline_n_unparsed_or_failed", "treatment_unparsed": "treatment_n_unparsed_or_failed", "baseline_tokens": "baseline_mean_output_tokens", "treatment_tokens": "treatment_mean_output_tokens"}
    return compare.compare_runs(*sides).select("model_id", *(_col(v).alias(k) for k, v in named.items())).join(flips, "model_id")


@query(
    "inspect_records",
    f"WITH {b.RUNS_SQL} SELECT b.problem_id, b.model_id, t.status AS prediction_status, t.correct AS prediction_correct, b.n_output_tokens >= 200 AS truncated FROM baseline b LEFT JOIN (SELECT * FROM treatment WHERE correct) t ON b.problem_id = t.problem_id AND b.model_id = t.model_id",
)
def inspect_records(spark, d):
    one, two = b.runs(spark, d)
    return compare.inspect_records(one.withColumn("max_new_tokens", F.lit(200)), two.filter("correct")).select("problem_id", "model_id", "prediction_status", "prediction_correct", "truncated")


# ---- run logs

_KEYS = ["problem_id", "condition"]


def _picked(order: str) -> str:
    return f"WITH {b.LOG_SQL} SELECT problem_id, condition, event_id, value FROM log QUALIFY row_number() OVER (PARTITION BY problem_id, condition ORDER BY {order}) = 1"


@query("dedup_first", _picked("position, event_id"))
def dedup_first(spark, d):
    return runs.dedup(b.log(spark, d), _KEYS, ["position", "event_id"]).select(*_KEYS, "event_id", "value")


@query("cell_last", _picked("position DESC, event_id DESC"))
def cell_last(spark, d):
    return runs.dedup(b.log(spark, d), _KEYS, ["position", "event_id"], policy="last").select(*_KEYS, "event_id", "value")


@query("dedup_prefer_success", f"WITH {b.LOG_SQL} SELECT problem_id, event_id, error FROM log QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY error IS NOT NULL, position, event_id) = 1")
def dedup_prefer_success(spark, d):
    return runs.dedup(b.log(spark, d), ["problem_id"], ["position", "event_id"], policy="prefer_success").select("problem_id", "event_id", "error")


@query("dup_counts", "SELECT count(*)::BIGINT AS n_records, count(DISTINCT (l_orderkey, l_linenumber))::BIGINT AS n_keys, (count(*) - count(DISTINCT (l_orderkey, l_linenumber)))::BIGINT AS n_duplicates FROM lineitem")
def dup_counts(spark, d):
    return runs.duplicate_counts(b.table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


_GRID_SQL = f"{b.LOG_SQL}, grid AS (SELECT m.model_id, p.problem_id, s.sample_index FROM (SELECT DISTINCT model_id FROM log) m, (SELECT DISTINCT problem_id FROM log) p, (SELECT unnest(range(2)) AS sample_index) s)"


def _grid(spark, d):
    log = b.log(spark, d)
    return runs.expected_grid(log.select("model_id").distinct(), log.select("problem_id").distinct(), 2), log.withColumn("sample_index", _col("event_id") % 2)


@query("expected_grid", f"WITH {_GRID_SQL} SELECT * FROM grid")
def expected_grid(spark, d):
    return _grid(spark, d)[0]


@query("resume_missing", f"WITH {_GRID_SQL} SELECT * FROM grid g WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.model_id = g.model_id AND l.problem_id = g.problem_id AND l.event_id % 2 = g.sample_index AND l.error IS NULL)")
def resume_missing(spark, d):
    grid, log = _grid(spark, d)
    return runs.resume(grid, log, ["model_id", "problem_id", "sample_index"])


@query(
    "run_summary",
    f"WITH {_GRID_SQL} SELECT (SELECT count(*) FROM grid)::BIGINT AS expected_records, (SELECT count(*) FROM log)::BIGINT AS n_records_written, (SELECT count(*) FROM log WHERE error IS NOT NULL)::BIGINT AS n_errors, (SELECT count(*) FROM grid g WHERE NOT EXISTS (SELECT 1 FROM log l WHERE l.model_id = g.model_id AND l.problem_id = g.problem_id AND l.event_id % 2 = g.sample_index AND l.error IS NULL))::BIGINT AS n_missing",
)
def run_summary(spark, d):
    grid, log = _grid(spark, d)
    return runs.run_summary(grid, log, ["model_id", "problem_id", "sample_index"])


@query("non_error", f"WITH {b.LOG_SQL} SELECT model_id, count(*)::BIGINT AS n FROM log WHERE error IS NULL GROUP BY 1")
def non_error(spark, d):
    return b.log(spark, d).filter(runs.succeeded(_col("error"))).groupBy("model_id").agg(F.count(F.lit(1)).alias("n"))


@query("truncation_summary", f"WITH {b.COMPLETIONS_SQL} SELECT model_id, count(*)::BIGINT AS n, round(avg(n_output_tokens), 1) AS mean_tokens, max(n_output_tokens)::BIGINT AS max_tokens, count(*) FILTER (WHERE n_output_tokens >= max_new_tokens)::BIGINT AS n_truncated FROM completions GROUP BY 1")
def truncation_summary(spark, d):
    return metrics.truncation_summary(b.completions(spark, d).withColumn("error", F.lit(None).cast("string")))


@query(
    "majority_vote",
    f"WITH {b.LOG_SQL}, v AS (SELECT problem_id, condition, count(*)::BIGINT AS votes FROM log GROUP BY 1, 2) SELECT problem_id, condition AS answer, votes, sum(votes) OVER (PARTITION BY problem_id)::BIGINT AS n_samples FROM v QUALIFY row_number() OVER (PARTITION BY problem_id ORDER BY votes DESC, condition) = 1",
)
def majority_vote(spark, d):
    return metrics.majority_vote(b.log(spark, d), ["problem_id"], "condition")


# ---- corrections and reports


@query(
    "override_apply",
    "SELECT d.doc_id AS task_id, coalesce(l.quality = 1, length(d.text) > 1500) AS final_correct, l.quality IS NOT NULL AS overridden FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id",
)
def override_apply(spark, d):
    return _reviewed(spark, d).select("task_id", "final_correct", "overridden")


def _reviewed(spark, d):
    docs = b.table(spark, d, "documents")
    auto = docs.select(_col("doc_id").alias("task_id"), F.lit("c").alias("condition"), (F.length("text") > 1500).alias("auto_correct"), F.when(_col("lang") == "en", F.array(F.lit("needs_review"))).otherwise(F.array().cast("array<string>")).alias("flags"))
    fixed = b.table(spark, d, "labels").select(_col("doc_id").alias("task_id"), F.lit("c").alias("condition"), (_col("quality") == 1).alias("correct"), F.lit("label").alias("reason"))
    return grade.apply_overrides(auto, fixed)


@query("needs_review", "SELECT d.doc_id AS task_id FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id WHERE d.lang = 'en' AND l.doc_id IS NULL")
def needs_review(spark, d):
    return grade.needs_review(_reviewed(spark, d)).select("task_id")


@query("unpivot_conditions", "SELECT o_orderkey AS task_id, 'o_orderstatus' AS condition, o_orderstatus AS output FROM orders UNION ALL SELECT o_orderkey, 'o_orderpriority', o_orderpriority FROM orders")
def unpivot_conditions(spark, d):
    return grade.unpivot_conditions(b.table(spark, d, "orders").select(_col("o_orderkey").alias("task_id"), "o_orderstatus", "o_orderpriority"), ["o_orderstatus", "o_orderpriority"])


@query(
    "pivot_report",
    f"WITH {b.CELLS_SQL}, k AS (SELECT category, condition, count(*) FILTER (WHERE final_correct) || '/' || count(*) AS cell FROM cells GROUP BY 1, 2) SELECT category, max(cell) FILTER (WHERE condition = 'c1') AS c1, max(cell) FILTER (WHERE condition = 'c2') AS c2, max(cell) FILTER (WHERE condition = 'c3') AS c3, max(cell) FILTER (WHERE condition = 'c4') AS c4 FROM k GROUP BY 1",
)
def pivot_report(spark, d):
    return report.pivot_accuracy(b.cells(spark, d), "category", ["c1", "c2", "c3", "c4"])


@query("rank_conditions", f"WITH {b.CELLS_SQL}, g AS (SELECT condition, count(*)::BIGINT AS n, sum(final_correct::INT)::BIGINT AS n_correct FROM cells GROUP BY 1) SELECT condition, n, n_correct, {_RATES_SQL} FROM g ORDER BY accuracy DESC, condition")
def rank_conditions(spark, d):
    return metrics.ranked(metrics.with_rates(b.cells(spark, d).groupBy("condition").agg(*metrics.accuracy_columns("final_correct"))), ["c1", "c2", "c3", "c4"])


@query(
    "head_to_head",
    f"""WITH {b.CELLS_SQL}, p AS (SELECT count(*) FILTER (WHERE a.final_correct AND NOT b.final_correct)::BIGINT AS x, count(*) FILTER (WHERE b.final_correct AND NOT a.final_correct)::BIGINT AS y
      FROM cells a JOIN cells b ON a.task_id = b.task_id WHERE a.condition = 'c3' AND b.condition = 'c1') SELECT 'third against first' AS title, x AS n_only_first, y AS n_only_second, {_P_SQL.format(b='x', c='y')} AS mcnemar_exact_p FROM p""",
)
def head_to_head(spark, d):
    pairs = metrics.pairwise(b.cells(spark, d), ["c1", "c2", "c3", "c4"], lists=False)
    return report.head_to_head(pairs, [("third against first", "c3", "c1")]).select("title", "n_only_first", "n_only_second", "mcnemar_exact_p")


@query("verdict_marks", f"WITH {b.CELLS_SQL} SELECT task_id, string_agg(CASE WHEN final_correct THEN 'C' ELSE '.' END, '' ORDER BY condition) AS marks FROM cells GROUP BY 1")
def verdict_marks(spark, d):
    return report.verdict_marks(b.cells(spark, d), ["task_id"], "condition", "final_correct")


# ---- prompts


@query("seed_policy", "SELECT doc_id, ('0x' || substr(sha256('42|' || lang || '|' || source || '|' || doc_id || '|0'), 1, 8))::BIGINT AS seed FROM documents")
def seed_policy(spark, d):
    return b.table(spark, d, "documents").select("doc_id", prompts.sample_seed(F.lit(42), _col("lang"), _col("source"), _col("doc_id"), F.lit(0)).alias("seed"))


@query("cot_prompt", rf"WITH {b.TASKS_SQL} SELECT id, regexp_replace(text, '\s+$', '') || chr(10) || 'Think step by step, then give the final answer.' AS prompt_text FROM tasks")
def cot_prompt(spark, d):
    return prompts.build_prompts(b.tasks(spark, d), "cot").select("id", "prompt_text")


@query("few_shot_prompt", f"WITH {b.TASKS_SQL} SELECT id, few_shot_prefix || prompt AS prompt_text FROM tasks")
def few_shot_prompt(spark, d):
    return prompts.build_prompts(b.tasks(spark, d), "few_shot").select("id", "prompt_text")


@query("format_only_prompt", f"WITH {b.TASKS_SQL} SELECT id, 'Q: one?' || chr(10) || 'Answer: ?' || chr(10) || chr(10) || 'Q: two?' || chr(10) || 'Sentiment: ?' || chr(10) || chr(10) || prompt AS prompt_text FROM tasks")
def format_only_prompt(spark, d):
    return prompts.build_prompts(b.tasks(spark, d), "few_shot_format_only").select("id", "prompt_text")


@query("random_label_prompt")
def random_label_prompt(spark, d):
    return prompts.build_prompts(b.tasks(spark, d), "few_shot_random_label").select("id", "prompt_text")


@query(
    "ablation_prompts",
    rf"""WITH {b.TASKS_SQL}, x AS (SELECT id, rtrim(few_shot_prefix, chr(10)) AS e, regexp_replace(text, '\s+$', '') AS body, CASE id % 3 WHEN 0 THEN 'Answer:' WHEN 1 THEN 'Code:' ELSE '' END AS cue FROM tasks)
    SELECT id, md5('<EXAMPLES>' || chr(10) || e || chr(10) || '</EXAMPLES>' || chr(10) || chr(10) || '<TARGET>' || chr(10) || body || chr(10) || '</TARGET>' || CASE WHEN cue <> '' THEN chr(10) || chr(10) || cue ELSE '' END) AS delimited FROM x""",
)
def ablation_prompts(spark, d):
    return b.tasks(spark, d).select("id", F.md5(prompts.ablation_prompts(_col("few_shot_prefix"), _col("prompt"))["B_delimiters"]).alias("delimited"))


@query("chat_messages", f"WITH {b.TASKS_SQL} SELECT id, CASE WHEN id % 2 = 0 THEN 'You are a helpful assistant.|' || prompt END AS rendered FROM tasks")
def chat_messages(spark, d):
    mode = F.when(_col("id") % 2 == 0, "chat").otherwise("raw")
    messages = prompts.chat_messages(_col("prompt"), mode)
    return b.tasks(spark, d).select("id", F.array_join(F.transform(messages, lambda m: m["content"]), "|").alias("rendered"))


# ---- validation


@query("leak_check", f"WITH {b.TASKS_SQL} SELECT id AS task_id, 'leaks' AS rule FROM tasks WHERE gold_answer = (id % 7)::VARCHAR")
def leak_check(spark, d):
    return validate.leaks(b.tasks(spark, d)).select("task_id", "rule")


def _documents_as_tasks(spark, d):
    docs = b.table(spark, d, "documents")
    return docs.select(_col("doc_id").alias("id"), _col("lang").alias("category"), F.lit("easy").alias("difficulty"), F.lit("string").alias("answer_type"), _col("text").alias("prompt"), F.lit("").alias("few_shot_prefix"), F.lit("x").alias("gold_answer"))


@query("dup_prompts", "SELECT doc_id AS task_id, 'duplicate prompt of task ' || lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) AS message FROM documents QUALIFY lag(doc_id) OVER (PARTITION BY text ORDER BY doc_id) IS NOT NULL")
def dup_prompts(spark, d):
    return validate.duplicate_prompts(_documents_as_tasks(spark, d)).select("task_id", "message")


@query(
    "validate_all",
    f"""WITH {b.TASKS_SQL} SELECT rule, count(*)::BIGINT AS n FROM (SELECT 'known_values' AS rule FROM tasks WHERE difficulty = 'extreme' UNION ALL SELECT 'gold_format' FROM tasks WHERE answer_type = 'number' AND gold_answer = 'none'
      UNION ALL SELECT 'self_extraction' FROM tasks WHERE answer_type = 'number' AND gold_answer = 'none' UNION ALL SELECT 'leaks' FROM tasks WHERE gold_answer = (id % 7)::VARCHAR
      UNION ALL SELECT 'duplicate_prompts' FROM (SELECT prompt FROM tasks QUALIFY row_number() OVER (PARTITION BY prompt ORDER BY id) > 1)) GROUP BY 1""",
)
def validate_all(spark, d):
    return validate.validate_all(b.tasks(spark, d)).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("manifest", f"WITH {b.TASKS_SQL} SELECT 'category' AS dimension, category AS value, count(*)::BIGINT AS n FROM tasks GROUP BY 2 UNION ALL SELECT 'difficulty', difficulty, count(*)::BIGINT FROM tasks GROUP BY 2")
def manifest(spark, d):
    return validate.manifest(b.tasks(spark, d))


@query("cot_audit", "SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE item_id % 3 < 2)::BIGINT AS n_had_cue, count(*) FILTER (WHERE item_id % 3 = 2)::BIGINT AS n_append_only FROM benchmark")
def cot_audit(spark, d):
    return validate.cot_audit(b.tasks(spark, d))


# ---- code, generation, streams


@query(
    "code_grade",
    """SELECT item_id, k = 0 AS correct, CASE k WHEN 0 THEN '2/2 tests passed' WHEN 1 THEN '1/2 tests passed' WHEN 6 THEN '0/2 tests passed' END AS extracted,
      CASE k WHEN 2 THEN 'function_not_defined' WHEN 3 THEN 'exec_error: SyntaxError' WHEN 4 THEN 'empty_output' WHEN 5 THEN 'exec_error: SystemExit' WHEN 7 THEN 'exec_error: BlockingIOError' WHEN 8 THEN 'exec_error: SystemExit' ELSE '' END AS flags
    FROM (SELECT item_id, item_id % 9 AS k FROM benchmark)""",
)
def code_grade(spark, d):
    """An answer for each item: right, half right, without the function, no code, empty, forged verdicts, equal to everything, forking."""
    from tallyforge.operators.sandbox import grade_code_rows

    item = _col("item_id")
    answers = (
        "```python\ndef add(a, b):\n    return a + b\n```\n", "def add(a, b):\n    return #\n", "x = 1", "def add(a, b)", "  ", "import os\nos.write(1, b'{\"passed\": 2}')\nos._exit(0)",
        "class Same:\n    def __eq__(self, other):\n        return True\n\ndef add(a, b):\n    return Same()\n", "import os\nos.fork()\ndef add(a, b):\n    return a + b\n", "print('{\"passed\": 2}')\nraise SystemExit",
    )
    said = F.replace(F.element_at(F.array(*map(F.lit, answers)), (item % 9 + 1).cast("int")), F.lit("#"), (item + 2).cast("string"))
    tests = F.format_string('{"fn": "add", "tests": [[[2, %d], %d], [[-1, %d], %d]]}', item, item + 2, item, item - 1)
    rows = b.table(spark, d, "benchmark").select("item_id", said.alias("completion_text"), tests.alias("code_tests"))
    return grade_code_rows(rows, enabled=True).select("item_id", "code_grade.correct", "code_grade.extracted", F.array_join("code_grade.flags", ",").alias("flags"))


@query("generate_stub", f"WITH {b.TASKS_SQL} SELECT id AS problem_id, model_id, sample_index::BIGINT AS sample_index FROM tasks, (VALUES ('a'), ('b')) m(model_id), (VALUES (0), (1)) s(sample_index)")
def generate_stub(spark, d):
    options = runs.RunOptions((("a", "raw"), ("b", "chat")), "few_shot", n_samples=2, do_sample=True, temperature=0.7)
    cells = runs.plan_run(spark, b.tasks(spark, d).withColumn("benchmark_version", F.lit("v1")), options)
    return runs.generate(cells, options).filter("error IS NULL").select("problem_id", "model_id", "sample_index")


@query("stream_dedup", f"WITH {b.LOG_SQL} SELECT DISTINCT problem_id, condition FROM log")
def stream_dedup(spark, d):
    from tallyforge.streaming import log as streams

    folder = b.new_folder(spark, "dedup")
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    b.table(spark, d, "events").write.parquet(f"{folder}/log")
    events = spark.readStream.schema(schema).parquet(f"{folder}/log").select(_col("user_id").alias("problem_id"), _col("event_type").alias("condition"), "event_id")
    streams.run_available(streams.dedup_stream(events, _KEYS), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select(*_KEYS)


@query("stream_grade", f"WITH {b.EXTRACTED_SQL} SELECT model_id, count(*)::BIGINT AS n, sum(correct::INT)::BIGINT AS n_correct FROM graded GROUP BY 1")
def stream_grade(spark, d):
    from tallyforge.streaming import log as streams

    folder = b.new_folder(spark, "grade")
    rows = b.completions(spark, d).select("model_id", "gold_answer", "completion_text")
    rows.write.json(f"{folder}/log")
    stream = streams.read_log_stream(spark, f"{folder}/log", "model_id string, gold_answer string, completion_text string")

    def judged(batch: DataFrame) -> DataFrame:
        e = extract.extract_answer(_col("completion_text"), F.lit("number"), F.lit("full"), _null_labels(), _col("gold_answer"))
        return batch.select("model_id", extract.answers_match(e, _col("gold_answer"), F.lit("number")).alias("correct"))

    streams.grade_stream(stream, judged, f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").groupBy("model_id").agg(*metrics.accuracy_columns())


from tallyforge.plans import jobs  # noqa: E402, F401  registers the queries over files and run folders
