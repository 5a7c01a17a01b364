"""Queries over files, run folders and streams, and over answers of every type, each with its SQL oracle.

The files are written from the driver's tables first, so that reading them back
can be held against SQL over those tables. A file that is one JSON document
holds a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import extract, legacy, prompts, text
from tallyforge.operators import compare, drivers, durable, grade, report, runs, validate
from tallyforge.plans import bindings as b
from tallyforge.plans.registry import query
from tallyforge.sources import files

_NL = "chr(10)"
_col = F.col


def _array_document(df: DataFrame, path: str) -> str:
    """Writes the table as a file that is one array of objects."""
    return files.write_array(df, path)


def _task_document(tasks: DataFrame, path: str) -> str:
    """Writes the tasks as a task file of version v1."""
    whole = F.struct(F.lit("v1").alias("version"), F.array_sort(F.collect_list(F.struct(*tasks.columns))).alias("prompts"))
    tasks.agg(F.to_json(whole).alias("value")).coalesce(1).write.text(path)
    return path


# ---- sources and sinks


@query("task_file", f"WITH {b.TASKS_SQL} SELECT id, 'v1' AS benchmark_version, category, answer_type, md5(prompt) AS prompt_text, replace(right(prompt, 90), {_NL}, ' / ') AS preview FROM tasks")
def task_file(spark, d):
    read = files.read_tasks(spark, _task_document(b.tasks(spark, d), b.new_folder(spark, "tasks")))
    return prompts.build_prompts(read, "direct").select("id", "benchmark_version", "category", "answer_type", F.md5("prompt_text").alias("prompt_text"), prompts.preview(_col("prompt")).alias("preview"))


@query("selected_tasks", f"WITH {b.TASKS_SQL} SELECT id, category FROM tasks WHERE id IN (2, 3, 5, 7, 11, 13)")
def selected_tasks(spark, d):
    return runs.select_tasks(b.tasks(spark, d), runs.parse_ids("2,3,5,7,11,13")).select("id", "category")


_WIDE_SQL = """wide AS (
  SELECT s_suppkey AS task_id, 'n' || s_nationkey AS category, s_name AS base_zero_shot, 'is ' || s_nationkey AS base_few_shot, '' AS instruct_zero_shot, 'é "q" ' || s_suppkey AS instruct_few_shot, s_nationkey::VARCHAR AS gold_answer, s_acctbal FROM supplier
)"""


def _wide(spark, d) -> DataFrame:
    nation = _col("s_nationkey").cast("string")
    return b.table(spark, d, "supplier").select(
        _col("s_suppkey").alias("task_id"), F.concat(F.lit("n"), nation).alias("category"), F.lit("easy").alias("difficulty"), nation.alias("gold_answer"), _col("s_name").alias("base_zero_shot"),
        F.concat(F.lit("is "), nation).alias("base_few_shot"), F.lit("").alias("instruct_zero_shot"), F.concat(F.lit('é "q" '), _col("s_suppkey").cast("string")).alias("instruct_few_shot"),
    )


@query(
    "wide_outputs_file",
    f"""WITH {_WIDE_SQL} SELECT task_id, 'base_zero_shot' AS condition, base_zero_shot AS output, s_acctbal FROM wide UNION ALL SELECT task_id, 'base_few_shot', base_few_shot, s_acctbal FROM wide
      UNION ALL SELECT task_id, 'instruct_zero_shot', instruct_zero_shot, s_acctbal FROM wide UNION ALL SELECT task_id, 'instruct_few_shot', instruct_few_shot, s_acctbal FROM wide""",
)
def wide_outputs_file(spark, d):
    read = files.read_outputs_wide(spark, _array_document(_wide(spark, d), b.new_folder(spark, "wide")))
    raw = b.table(spark, d, "supplier").select(_col("s_suppkey").alias("task_id"), "s_acctbal")
    return grade.unpivot_conditions(read).join(raw, "task_id").select("task_id", "condition", "output", "s_acctbal")


@query("wide_outputs_lines", f"WITH {_WIDE_SQL} SELECT task_id, category, gold_answer, base_few_shot, instruct_few_shot FROM wide")
def wide_outputs_lines(spark, d):
    folder = b.new_folder(spark, "lines")
    files.append_jsonl(_wide(spark, d), folder)
    return spark.read.schema(schemas.OUTPUTS_WIDE).json(folder).select("task_id", "category", "gold_answer", "base_few_shot", "instruct_few_shot")


@query(
    "jsonl_log",
    "SELECT 'record' AS kind, event_type AS what, count(*)::BIGINT AS n, sum(user_id)::BIGINT AS total FROM events GROUP BY 2 UNION ALL SELECT 'no record', left(event_type, 1), count(*)::BIGINT, 0::BIGINT FROM events WHERE event_id % 7 = 0 GROUP BY 2",
)
def jsonl_log(spark, d):
    """Records in two appends, with blank lines and lines cut off between them."""
    folder, events = b.new_folder(spark, "jsonl"), b.table(spark, d, "events")
    good = events.select(_col("user_id").alias("problem_id"), _col("event_type").alias("condition"), "event_id")
    files.append_jsonl(good.filter("event_id % 2 = 0"), folder)
    bad = events.filter("event_id % 7 = 0").select(F.concat(F.lit(" \n"), F.left("event_type", F.lit(1)), F.lit('{"problem_id": 3, "cut')).alias("value"))
    bad.write.mode("append").text(folder)
    files.append_jsonl(good.filter("event_id % 2 = 1"), folder)
    records, broken = files.read_jsonl(spark, folder, "problem_id long, condition string")
    counted = records.groupBy(F.lit("record").alias("kind"), _col("condition").alias("what")).agg(F.count(F.lit(1)).alias("n"), F.sum("problem_id").alias("total"))
    return counted.unionByName(broken.groupBy(F.lit("no record").alias("kind"), F.left("value", F.lit(1)).alias("what")).agg(F.count(F.lit(1)).alias("n"), F.lit(0).cast("long").alias("total")))


@query("predictions_file", "SELECT s_suppkey AS problem_id, s_acctbal > 0 AS correct, 'n' || s_nationkey AS prediction, (SELECT count(*) FROM supplier WHERE s_acctbal <= 0)::BIGINT AS n_failures, 0::BIGINT AS n_without_file FROM supplier")
def predictions_file(spark, d):
    folder = b.new_folder(spark, "predictions")
    rows = b.table(spark, d, "supplier").select(_col("s_suppkey").alias("problem_id"), (_col("s_acctbal") > 0).alias("correct"), F.concat(F.lit("n"), _col("s_nationkey").cast("string")).alias("prediction"))
    whole = F.struct(F.lit("2026-01-01T00:00:00Z").alias("graded_utc"), F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct(*rows.columns))).alias("predictions"))
    rows.agg(F.to_json(whole).alias("value")).coalesce(1).write.text(f"{folder}/predictions")
    rows.filter("NOT correct").agg(F.to_json(F.struct(F.count(F.lit(1)).alias("n"))).alias("value")).coalesce(1).write.text(f"{folder}/parse_failures")
    none = files.read_predictions_or_none(spark, f"{folder}/nothing").count() + files.count_parse_failures(spark, f"{folder}/nothing")
    failures = files.count_parse_failures(spark, f"{folder}/parse_failures")
    return files.read_predictions(spark, f"{folder}/predictions").select("problem_id", "correct", "prediction", F.lit(failures).cast("long").alias("n_failures"), F.lit(none).cast("long").alias("n_without_file"))


@query("run_config", "SELECT 'run-' || r_regionkey AS run_id, 'cot' AS condition, r_regionkey + 1 AS n_samples, 2 AS n_models, r_name AS system_prompt FROM region")
def run_config(spark, d):
    folder = b.new_folder(spark, "config")
    key = _col("r_regionkey")
    models = F.array(*[F.struct(F.lit(m).alias("model_id"), F.lit("raw").alias("mode")) for m in ("a", "b")])
    rows = b.table(spark, d, "region").select(F.concat(F.lit("run-"), key.cast("string")).alias("run_id"), F.lit("cot").alias("condition"), (key + 1).cast("long").alias("n_samples"), models.alias("models"), _col("r_name").alias("system_prompt"))
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value"), "run_id").repartition("run_id").write.partitionBy("run_id").text(folder)
    return files.read_config(spark, f"{folder}/run_id=*/*").select("run_id", "condition", "n_samples", F.size("models").alias("n_models"), "system_prompt")


@query("overrides_file", "SELECT doc_id AS task_id, CASE WHEN doc_id % 2 = 0 THEN 'base_few_shot' ELSE 'base_zero_shot' END AS condition, max(quality) = 1 AS correct, 'say \"é\"' AS reason FROM labels GROUP BY 1, 2")
def overrides_file(spark, d):
    rows = b.table(spark, d, "labels").groupBy("doc_id").agg((F.max("quality") == 1).alias("correct"))
    condition = F.when(_col("doc_id") % 2 == 0, "base_few_shot").otherwise("base_zero_shot")
    cell = F.create_map(condition, F.struct("correct", F.lit('say "é"').alias("reason")))
    folder = b.new_folder(spark, "overrides")
    rows.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(_col("doc_id").cast("string"), cell)))).alias("value")).coalesce(1).write.text(folder)
    return files.read_overrides(spark, folder)


@query("file_digests", f"SELECT sha256(n_name || {_NL}) AS sha256, n_regionkey % 1 AS changed FROM nation")
def file_digests(spark, d):
    """Digests of files, stored as a manifest and held against the files read again."""
    folder = b.new_folder(spark, "digests")
    b.table(spark, d, "nation").select("n_name", "n_nationkey").repartition("n_nationkey").write.partitionBy("n_nationkey").text(folder)
    manifest = b.new_folder(spark, "manifest")
    files.file_digests(spark, f"{folder}/n_nationkey=*/*").write.parquet(manifest)
    found = files.changed_files(spark, f"{folder}/n_nationkey=*/*", spark.read.parquet(manifest))
    return found.select("sha256", _col("changed").cast("int").alias("changed"))


@query("clock", "SELECT n_nationkey, true AS well_formed, true AS now FROM nation")
def clock(spark, d):
    """Records stamped as they are written, and read back: the stamps have the form of a log's and are at most ten minutes old."""
    folder = b.new_folder(spark, "clock")
    files.append_jsonl(b.table(spark, d, "nation").select("n_nationkey", files.utc_now().alias("told")), folder)
    read, _ = files.read_jsonl(spark, folder, "n_nationkey long, told string")
    age = F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp(F.to_timestamp("told"))
    return read.select("n_nationkey", F.regexp_like("told", F.lit(r"\A\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ\z")).alias("well_formed"), age.between(0, 600).alias("now"))


@query("report_document", f"""SELECT '[' || {_NL} || string_agg('  {{' || {_NL} || '    "name": "é ' || r_name || '",' || {_NL} || '    "n": ' || n || {_NL} || '  }}', ',' || {_NL} ORDER BY r_name) || {_NL} || ']' || {_NL} AS document
  FROM (SELECT r_name, count(*) AS n FROM region JOIN nation ON r_regionkey = n_regionkey GROUP BY 1)""")
def report_document(spark, d):
    joined = b.table(spark, d, "region").join(b.table(spark, d, "nation"), _col("r_regionkey") == _col("n_regionkey"))
    rows = joined.groupBy(F.concat(F.lit("é "), "r_name").alias("name")).agg(F.count(F.lit(1)).alias("n")).orderBy("name")
    path = f"{b.new_folder(spark, 'report')}/report.json"
    files.write_json(spark, path, drivers.rows_of(rows))
    return spark.read.text(path, wholetext=True).select(_col("value").alias("document"))


# ---- reports


@query(
    "comparison_page",
    rf"""WITH {b.RUNS_SQL}, s AS (SELECT b.model_id, b.k AS bk, b.n AS bn, t.k AS tk, t.n AS tn, round((round(t.k / t.n::DOUBLE, 3) - round(b.k / b.n::DOUBLE, 3)) * 100, 1) AS points
      FROM (SELECT model_id, count(*) AS n, sum(correct::INT) AS k FROM baseline GROUP BY 1) b JOIN (SELECT model_id, count(*) AS n, sum(correct::INT) AS k FROM treatment GROUP BY 1) t ON b.model_id = t.model_id),
    c AS (SELECT model_id, category, count(*) AS n, sum(b_correct::INT) AS x, sum(t_correct::INT) AS y FROM pairs GROUP BY 1, 2)
    SELECT '# Comparison' || {_NL} || {_NL} || '| Model | Baseline | Treatment | Points |' || {_NL} || '|---|---|---|---|' || {_NL} || (SELECT string_agg('| ' || model_id || ' | ' || bk || '/' || bn || ' | ' || tk || '/' || tn || ' | ' || format('{{:+.1f}}', points) || ' |', {_NL} ORDER BY model_id) FROM s)
      || {_NL} || {_NL} || '## By category' || {_NL} || {_NL} || '| Model | Category | n | Baseline | Treatment |' || {_NL} || '|---|---|---|---|---|' || {_NL} || (SELECT string_agg('| ' || model_id || ' | ' || category || ' | ' || n || ' | ' || x || ' | ' || y || ' |', {_NL} ORDER BY model_id, category) FROM c) || {_NL} AS page""",
)
def comparison_page(spark, d):
    sides = b.runs(spark, d)
    page = report.comparison_markdown(compare.compare_runs(*sides), compare.by_category(compare.paired(*sides)))
    return spark.createDataFrame([(page,)], "page string")


@query("run_gap", f"WITH {b.LOG_SQL}, x AS (SELECT DISTINCT problem_id FROM log WHERE condition = 'error'), y AS (SELECT DISTINCT problem_id FROM log WHERE condition <> 'error') SELECT problem_id, problem_id IN (SELECT * FROM x) AS in_first, problem_id IN (SELECT * FROM y) AS in_second FROM (SELECT * FROM x UNION SELECT * FROM y)")
def run_gap(spark, d):
    """The union of two sets of problems, in order, and which of the two lacks each."""
    log = b.log(spark, d)
    one, two = log.filter("condition = 'error'").select("problem_id").distinct(), log.filter("condition <> 'error'").select("problem_id").distinct()
    gap = one.exceptAll(two).select("problem_id", F.lit(True).alias("in_first"), F.lit(False).alias("in_second")).union(two.exceptAll(one).select("problem_id", F.lit(False), F.lit(True)))
    both = one.intersect(two).select("problem_id", F.lit(True).alias("in_first"), F.lit(True).alias("in_second"))
    return gap.unionByName(both).orderBy("problem_id")


# ---- prompts and options


@query("cli_specs", "SELECT 'org/' || n_name AS model, CASE WHEN n_nationkey % 2 = 0 THEN 'chat' ELSE 'raw' END AS mode, n_nationkey % 3 + 1 AS n_ids, n_nationkey % 2 = 0 AS sampled FROM nation")
def cli_specs(spark, d):
    """Model specifications, id lists and options as a command line gives them; nations are 25 rows."""
    rows = []
    for r in b.table(spark, d, "nation").collect():
        even, n = r.n_nationkey % 2 == 0, r.n_nationkey % 3 + 1
        spec = runs.parse_model_spec(f"org/{r.n_name}:chat" if even else f"org/{r.n_name}")
        options = runs.RunOptions((spec,), n_samples=n if even else 1, do_sample=even, temperature=0.5 if even else None)
        rows.append((*options.models[0], len(runs.parse_ids(",".join(map(str, range(n))))), options.do_sample))
    return spark.createDataFrame(rows, "model string, mode string, n_ids int, sampled boolean")


_E = f"rtrim(few_shot_prefix, {_NL})"
_INSTRUCTION = prompts.EXPLICIT_INSTRUCTION.replace("\n", f"' || {_NL} || '")
_SQL_TARGET = r"regexp_replace(text, '\s+$', '') || CASE id % 3 WHEN 0 THEN chr(10) || 'Answer:' WHEN 1 THEN chr(10) || 'Code:' ELSE '' END"


@query(
    "ablation_plan",
    rf"""WITH {b.TASKS_SQL}, t AS (SELECT id, few_shot_prefix, prompt, {_E} AS e, {_SQL_TARGET} AS target FROM tasks)
    SELECT id, 'A_original' AS condition, 42 + 10000 * id AS seed, md5(few_shot_prefix || prompt) AS prompt FROM t
    UNION ALL SELECT id, 'D_instruction_only', 42 + 10000 * id + 3000, md5(e || {_NL} || {_NL} || '{_INSTRUCTION}' || {_NL} || {_NL} || target) FROM t""",
)
def ablation_plan(spark, d):
    """Prompts and seeds of the ablation's first and last format for every task, as its generation asks for them."""
    made = prompts.ablation_prompts(_col("few_shot_prefix"), _col("prompt"))
    rows = b.tasks(spark, d).select("id", F.posexplode(F.map_entries(made)).alias("place", "cell"))
    seed = prompts.ablation_seed(F.lit(42), _col("id"), _col("place"), F.lit(0))
    return rows.select("id", _col("cell.key").alias("condition"), seed.alias("seed"), F.md5("cell.value").alias("prompt")).filter("condition IN ('A_original', 'D_instruction_only')")


_MARKS = ("Answer:", "sentiment:", "Classify:", "SUBJECT:", "Extract the date:", "Code:")


@query("demonstration_answers", f"SELECT p_partkey, p_name || CASE WHEN p_partkey % 4 = 0 THEN {_NL} || 'second line' ELSE '' END AS answer FROM part")
def demonstration_answers(spark, d):
    mark = F.element_at(F.array(*map(F.lit, _MARKS)), (_col("p_partkey") % 6 + 1).cast("int"))
    block = F.concat(F.lit("Question: what?\n  "), mark, F.lit("   "), "p_name", F.when(_col("p_partkey") % 4 == 0, "\nsecond line").otherwise(""))
    return b.table(spark, d, "part").select("p_partkey", prompts.block_answer(block).alias("answer"))


# ---- text and extraction


@query("normalize_audit", r"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM documents")
def normalize_audit(spark, d):
    return b.table(spark, d, "documents").select("doc_id", F.md5(text.normalize_audit(_col("text"))).alias("digest"))


@query("clean_number", "SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 1000.0 + p_size WHEN 1 THEN -1.0 * p_size WHEN 4 THEN round(p_retailprice, 2) WHEN 5 THEN p_size * 10.0 END AS number FROM part")
def clean_number(spark, d):
    size, kind = _col("p_size").cast("string"), _col("p_partkey") % 6
    token = (
        F.when(kind == 0, F.concat(F.lit("$1,"), F.lpad(size, 3, "0"), F.lit("..."))).when(kind == 1, F.concat(F.lit("-$"), size)).when(kind == 2, F.concat(size, F.lit("/4")))
        .when(kind == 3, F.concat(size, F.lit("x"))).when(kind == 4, F.format_string("%.2f", "p_retailprice")).otherwise(F.concat(size, F.lit("e1")))
    )
    return b.table(spark, d, "part").select("p_partkey", text.clean_number(token).alias("number"))


@query("condition_scope", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'first_paragraph' ELSE 'full' END AS scope FROM events")
def condition_scope(spark, d):
    name = F.concat(F.when(_col("event_id") % 2 == 0, "few_shot_").otherwise("not_few_shot_"), "event_type")
    return b.table(spark, d, "events").select("event_id", extract.scope_for_condition(name).alias("scope"))


@query(
    "legacy_first_words",
    """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'not error' WHEN 1 THEN 'error' WHEN 2 THEN event_type END AS label, CASE event_id % 4 WHEN 0 THEN 'no' WHEN 2 THEN 'yes' END AS yesno
    FROM events""",
)
def legacy_first_words(spark, d):
    """The older rule sets' first label, searched as it is written, and first whole word yes or no."""
    events = b.table(spark, d, "events")
    kinds = [r[0] for r in events.select("event_type").distinct().orderBy("event_type").collect()]  # a handful
    kind = _col("event_type")
    said = F.when(_col("event_id") % 4 == 0, "It is NOT error, no yes").when(_col("event_id") % 4 == 1, "know error, yesterday").when(_col("event_id") % 4 == 2, F.concat(F.upper(kind), F.lit(": Yes/no"))).otherwise("nothing here")
    labels = F.array(*[F.lit(x) for x in dict.fromkeys(["not error", "error", *kinds])])
    return events.select("event_id", legacy.first_label(said, labels).alias("label"), extract.first_yesno(said).alias("yesno"))


@query(
    "boxed_forms",
    r"""SELECT p_partkey, CASE WHEN p_partkey % 7 = 2 THEN 'ambiguous' WHEN p_partkey % 7 = 3 THEN 'malformed' ELSE 'parsed' END AS status,
      CASE p_partkey % 7 WHEN 0 THEN p_size WHEN 1 THEN p_size WHEN 4 THEN p_size WHEN 5 THEN p_size WHEN 6 THEN 0.25 * p_size END::DOUBLE AS number FROM part""",
)
def boxed_forms(spark, d):
    r"""Boxes with text and braces inside, several that agree or differ, empty ones, and fractions."""
    q = _col("p_size").cast("string")
    kind = _col("p_partkey") % 7
    said = (
        F.when(kind == 0, F.concat(F.lit(r"So \boxed{"), q, F.lit(r" \text{ cm}^2} it is 99")))
        .when(kind == 1, F.concat(F.lit(r"\boxed{"), q, F.lit(r"} and again \boxed{"), q, F.lit("}")))
        .when(kind == 2, F.concat(F.lit(r"\boxed{"), q, F.lit(r"} or maybe \boxed{1"), q, F.lit("}")))
        .when(kind == 3, F.concat(F.lit(r"The answer is "), q, F.lit(r" \boxed{}")))
        .when(kind == 4, F.concat(F.lit(r"\boxed{"), q, F.lit(r"} \boxed{"), q))
        .when(kind == 5, F.concat(F.lit(r"\boxed{\mathrm{x} = {"), q, F.lit("}}")))
        .otherwise(F.concat(F.lit(r"\boxed{ "), q, F.lit(" / 4 }")))
    )
    e = extract.extract_number(said)
    return b.table(spark, d, "part").select("p_partkey", e.alias("e")).select("p_partkey", "e.status", F.when(_col("e.status") == "parsed", _col("e.prediction_num")).alias("number"))


@query(
    "boxed_storm",
    r"""SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN 'malformed' WHEN 3 THEN 'ambiguous' ELSE 'parsed' END AS status,
      CASE WHEN doc_id % 4 < 2 THEN (doc_id % 1000)::DOUBLE END AS number, CASE doc_id % 4 WHEN 2 THEN 0 WHEN 3 THEN 2 ELSE 1 + doc_id * 7 % 300 END::BIGINT AS n_candidates FROM documents""",
)
def boxed_storm(spark, d):
    r"""Whole documents that end in up to 300 boxes: in a row, inside each other, never closed, or with braces inside and differing."""
    q, n, kind = (_col("doc_id") % 1000).cast("string"), (1 + _col("doc_id") * 7 % 300).cast("int"), _col("doc_id") % 4
    storm = (
        F.when(kind == 0, F.repeat(F.concat(F.lit(r"\boxed{"), q, F.lit("} ")), n))
        .when(kind == 1, F.concat(F.repeat(F.lit(r"\boxed{"), n), q, F.repeat(F.lit("}"), n)))
        .when(kind == 2, F.concat(F.repeat(F.lit(r"\boxed{"), n), q))
        .otherwise(F.concat(F.lit(r"\boxed{"), q, F.lit("}"), F.repeat(F.concat(F.lit(r" \boxed{ {x} "), (_col("doc_id") % 1000 + 1).cast("string"), F.lit(" }")), n)))
    )
    said = F.concat(F.coalesce("text", F.lit("")), F.lit(" "), storm)
    found = b.table(spark, d, "documents").select("doc_id", extract.extract_number(said).alias("e"))
    return found.select("doc_id", "e.status", F.when(_col("e.status") == "parsed", _col("e.prediction_num")).alias("number"), F.size("e.candidates_num").cast("long").alias("n_candidates"))


# ---- older rule sets on every answer type

#: Text and gold by type: (type, text, gold); ``#`` stands for the row's quantity.
_TYPED = (
    ("number", "Answer: #\n\nThen = 1#", "#"), ("number", "none\n\nAnswer 7", "7"), ("yesno", "Well\n\nYes", "yes"), ("yesno", "No.\n\nYes", "no"), ("label", "x\n\nspam", "spam"),
    ("label", "this is NOT spam", "not spam"), ("name", "Alice\n\nb\nc\nd\nBob", "bob"), ("name", "Bob\n\nb\nc\nd", "bob"), ("string", "start\n\nThe  End", '"the end."'), ("string", "", "x"),
)


def _typed(spark, d) -> DataFrame:
    """Rows of ``lineitem`` with an answer of each type: kind (place in _TYPED), type, output, gold, few."""
    kind = (_col("l_orderkey") + _col("l_linenumber")) % len(_TYPED)
    pick = lambda i: F.replace(F.element_at(F.array(*[F.lit(t[i]) for t in _TYPED]), (kind + 1).cast("int")), F.lit("#"), _col("l_quantity").cast("long").cast("string"))
    return b.table(spark, d, "lineitem").select(kind.alias("kind"), pick(0).alias("type"), pick(1).alias("output"), pick(2).alias("gold"), (_col("l_partkey") % 2 == 0).alias("few"))


_TYPED_SQL = f"typed AS (SELECT (l_orderkey + l_linenumber) % {len(_TYPED)} AS kind, l_partkey % 2 = 0 AS few FROM lineitem)"


def _labels():
    return F.array(F.lit("spam"), F.lit("not spam"))


def _judged(rows: DataFrame, g) -> DataFrame:
    counted = rows.withColumn("g", g).groupBy("kind", "few", _col("g.correct").alias("correct"), F.array_join("g.flags", ",").alias("flags"))
    return counted.agg(F.count(F.lit(1)).alias("n"))


@query(
    "eval20_types",
    f"""WITH {_TYPED_SQL} SELECT kind, few, CASE kind WHEN 0 THEN few WHEN 1 THEN true WHEN 2 THEN NOT few WHEN 3 THEN true WHEN 4 THEN NOT few WHEN 5 THEN true WHEN 6 THEN NOT few WHEN 7 THEN few WHEN 8 THEN NOT few ELSE false END AS correct,
      CASE WHEN kind = 9 THEN 'empty_output' WHEN few AND kind IN (1, 2, 4) THEN 'needs_review' ELSE '' END AS flags, count(*)::BIGINT AS n FROM typed GROUP BY 1, 2""",
)
def eval20_types(spark, d):
    condition = F.when(_col("few"), "base_few_shot").otherwise("base_zero_shot")
    return _judged(_typed(spark, d), legacy.grade_eval20(_col("output"), _col("gold"), _col("type"), _labels(), condition))


@query(
    "ablation_types",
    f"""WITH {_TYPED_SQL} SELECT kind, few, CASE kind WHEN 2 THEN NOT few WHEN 4 THEN NOT few WHEN 6 THEN NOT few WHEN 7 THEN few WHEN 8 THEN NOT few WHEN 9 THEN false ELSE true END AS correct,
      CASE WHEN kind = 9 THEN 'empty_output' WHEN few AND kind IN (1, 2, 4) THEN 'needs_review' ELSE '' END AS flags, count(*)::BIGINT AS n FROM typed GROUP BY 1, 2""",
)
def ablation_types(spark, d):
    condition = F.when(_col("few"), "A_original").otherwise("D_instruction_only")
    return _judged(_typed(spark, d), legacy.grade_ablation(_col("output"), _col("gold"), _col("type"), _labels(), condition))


@query(
    "audit_words",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN 'review' WHEN event_id % 5 IN (0, 3) THEN 'correct' ELSE 'wrong' END AS verdict,
      CASE event_id % 5 WHEN 0 THEN 'a red fox (1)! ' || event_type WHEN 1 THEN right('redfox (1) ' || repeat('z', 70) || event_type, 60) WHEN 2 THEN 'red fox (2) ' || event_type WHEN 3 THEN left('red fox (1)! ' || repeat('y', 70), 60) ELSE 'x' END AS fingerprint FROM events""",
)
def audit_words(spark, d):
    """Golds that are words: whole-word search with a gold full of pattern characters, code apart, and fingerprints of text."""
    kind = _col("event_id") % 5
    said = (
        F.when(kind == 0, F.concat(F.lit("Answer: no\nANSWER :  A  Red\nfox (1)! "), "event_type")).when(kind == 1, F.concat(F.lit("redfox (1) "), F.repeat(F.lit("z"), F.lit(70)), "event_type"))
        .when(kind == 2, F.concat(F.lit("red fox (2) "), "event_type")).when(kind == 3, F.concat(F.lit("answer: red fox (1)! "), F.repeat(F.lit("y"), F.lit(70)))).otherwise("x")
    )
    category = F.when(kind == 4, "code").otherwise("extraction")
    gold = F.lit("red fox (1)!")
    # the gold ends in no word character, so a word must follow; see the reading of word borders in audit_judge
    verdict = legacy.audit_judge(F.concat(said, F.lit("")), F.lit("Red Fox (1"), category, F.lit(False))
    return b.table(spark, d, "events").select("event_id", verdict.alias("verdict"), legacy.audit_fingerprint(said, gold, F.lit(False)).alias("fingerprint"))


@query(
    "audit_candidates",
    """SELECT o_orderkey AS task_id, CASE WHEN o_orderkey % 6 = 5 THEN 'code' ELSE 'candidate' END AS found FROM orders WHERE o_orderkey % 6 IN (1, 5)""",
)
def audit_candidates(spark, d):
    key, kind = _col("o_orderkey").cast("string"), _col("o_orderkey") % 6
    say = lambda right: F.when(right, F.concat(F.lit("it is "), key)).otherwise(F.concat(F.lit("it is 1"), key, F.lit("\n\nno: "), key, F.lit(" 0")))
    wide = b.table(spark, d, "orders").select(_col("o_orderkey").alias("task_id"), key.alias("gold_answer"), F.when(kind == 5, "code").otherwise("math").alias("category"), say(kind.isin(0, 3)).alias("few"), say(kind.isin(0, 1)).alias("zero"))
    candidates, code = grade.audit_candidates(wide, "few", "zero")
    return candidates.select("task_id", F.lit("candidate").alias("found")).unionByName(code.select("task_id", F.lit("code").alias("found")))


# ---- validation


@query(
    "validate_violations",
    """SELECT rule, count(*)::BIGINT AS n FROM (
      SELECT 'unique_ids' AS rule FROM part WHERE p_partkey % 40 = 1 UNION ALL SELECT 'missing_fields' FROM part WHERE p_partkey % 40 IN (2, 3)
      UNION ALL SELECT 'known_values' FROM part WHERE p_partkey % 40 = 4 UNION ALL SELECT 'label_gold' FROM part WHERE p_partkey % 40 = 5 UNION ALL SELECT 'label_gold' FROM part WHERE p_partkey % 40 IN (5, 6)
      UNION ALL SELECT 'code_tests' FROM part WHERE p_partkey % 40 IN (8, 9) UNION ALL SELECT 'gold_format' FROM part WHERE p_partkey % 40 IN (11, 12) UNION ALL SELECT 'self_extraction' FROM part WHERE p_partkey % 40 IN (6, 11, 12)
      UNION ALL SELECT 'expected_count') GROUP BY 1""",
)
def validate_violations(spark, d):
    """Tasks of parts, valid but for a few of every forty: an id twice, missing fields, unknown types, labels without the gold, code without tests, golds of the wrong form."""
    kind = _col("p_partkey") % 40
    of = lambda default, **cases: F.coalesce(*[F.when(kind == int(k[1:]), F.lit(v)) for k, v in cases.items()], F.lit(default))
    answer = of("string", k4="riddle", k5="label", k6="label", k7="label", k8="code", k9="code", k10="code", k11="number", k12="yesno", k13="number", k14="yesno")
    gold = F.when(kind == 3, None).otherwise(of("gold", k6="other", k7="SPAM", k11="ten", k12="maybe", k13="$1,000", k14="YES"))
    tasks = b.table(spark, d, "part").select(
        _col("p_partkey").alias("id"), F.lit("c").alias("category"), F.lit("easy").alias("difficulty"), answer.alias("answer_type"), F.when(kind.isin(6, 7), F.array(F.lit("ham"), F.lit("Spam"))).alias("labels"),
        F.when(kind == 9, '{"fn": "f", "tests": []}').when(kind == 10, '{"fn": "f", "tests": [[[1], 1]]}').alias("code_tests"), F.when(kind != 2, F.concat(F.lit("prompt "), _col("p_partkey").cast("string"))).alias("prompt"),
        F.lit("Q\nAnswer: other thing\n\n").alias("few_shot_prefix"), gold.alias("gold_answer"),
    )
    again = tasks.filter(_col("id") % 40 == 1).withColumn("prompt", F.concat("prompt", F.lit(" again")))
    return validate.validate_all(tasks.unionByName(again), 1).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query("frozen_tasks", f"WITH {b.TASKS_SQL} SELECT 'category' AS dimension, category AS value, count(*)::BIGINT AS n, true AS same, true AS refused FROM tasks GROUP BY 2 UNION ALL SELECT 'difficulty', 'easy', count(*)::BIGINT, true, true FROM tasks")
def frozen_tasks(spark, d):
    """A valid task file is frozen, found the same, and refused once it has changed."""
    folder = b.new_folder(spark, "frozen")
    tasks = b.tasks(spark, d).withColumns({"gold_answer": F.lit("not shown"), "answer_type": F.lit("string"), "difficulty": F.lit("easy")})
    path, manifest = _task_document(tasks, f"{folder}/tasks"), f"{folder}/manifest.json"
    first = drivers.validate_tasks(spark, f"{path}/*.txt", manifest_path=manifest)
    stored = files.read_document(spark, manifest)
    digest = lambda p: files.file_digests(spark, f"{p}/*.txt").first()["sha256"]
    same = validate.frozen(digest(path), stored["sha256"]) == first["sha256"]
    changed = _task_document(tasks.withColumn("prompt", F.concat("prompt", F.lit("!"))), f"{folder}/changed")
    try:
        validate.frozen(digest(changed), stored["sha256"])
        refused = False
    except ValueError:
        refused = True
    return spark.createDataFrame([(r["dimension"], r["value"], r["n"], same, refused) for r in stored["counts"]], "dimension string, value string, n long, same boolean, refused boolean")


# ---- run folders and older experiments, from end to end


def _run_folder(spark, d) -> tuple[str, str]:
    """(task file, run folder): a log of three appends. First every third task failed; then the failures were run again; then every fifth task once more, wrongly, as a second sample and in the first's place."""
    folder = b.new_folder(spark, "run")
    tasks = b.tasks(spark, d).withColumn("gold_answer", (_col("id") % 5).cast("string")).withColumn("answer_type", F.lit("number"))
    path = _task_document(tasks, f"{folder}/tasks")
    models = spark.createDataFrame([("a",), ("b",)], "model_id string")
    right = F.concat(F.lit("The answer is "), "gold_answer", F.lit("."))

    def append(rows: DataFrame, said, error, sample: int = 0, n_files: int = 1) -> None:
        record = rows.crossJoin(models).select(F.lit("v1").alias("benchmark_version"), _col("id").alias("problem_id"), "model_id", F.lit("direct").alias("condition"), F.lit(sample).alias("sample_index"), said.alias("completion_text"), error.alias("error"), F.lit(4).alias("n_output_tokens"))
        files.append_jsonl(record.repartition(n_files), f"{folder}/generations")

    failed = _col("id") % 3 == 0
    append(tasks, F.when(failed, "").otherwise(right), F.when(failed, "timeout"), n_files=3)
    append(tasks.filter(failed), F.concat(F.repeat(F.lit("Well. "), F.lit(300)), right), F.lit(None).cast("string"))
    append(tasks.filter("id % 5 = 0"), F.lit("The answer is 77."), F.lit(None).cast("string"))
    append(tasks.filter("id % 10 = 0"), F.lit("The answer is 88."), F.lit(None).cast("string"), sample=1)
    return path, folder


def _graded_run(spark, d, policy: str) -> DataFrame:
    path, folder = _run_folder(spark, d)
    drivers.grade_run(spark, folder, path, policy=policy)
    return spark.read.parquet(f"{folder}/predictions")


_GRADED_SQL = "m AS (SELECT unnest(['a', 'b']) AS model_id), s AS (SELECT unnest([0, 1]) AS sample_index), cells AS (SELECT item_id AS id, model_id, sample_index FROM benchmark, m, s WHERE sample_index = 0 OR item_id % 10 = 0)"


@query(
    "grade_run",
    f"WITH {_GRADED_SQL} SELECT id AS problem_id, model_id, sample_index::BIGINT AS sample_index, CASE WHEN sample_index = 0 AND id % 3 = 0 THEN 'unparsed' ELSE 'parsed' END AS status, sample_index = 0 AND id % 3 <> 0 AS correct, CASE WHEN sample_index = 0 AND id % 3 = 0 THEN 'generation_error' ELSE '' END AS flags FROM cells",
)
def grade_run(spark, d):
    """The first record of each cell in the log's order, failures among them."""
    return _graded_run(spark, d, "first").select("problem_id", "model_id", "sample_index", "status", "correct", F.array_join("flags", ",").alias("flags"))


@query("grade_run_success", f"WITH {_GRADED_SQL} SELECT id AS problem_id, model_id, sample_index::BIGINT AS sample_index, 'parsed' AS status, sample_index = 0 AS correct, '' AS flags FROM cells")
def grade_run_success(spark, d):
    """The first record of each cell that succeeded."""
    return _graded_run(spark, d, "prefer_success").select("problem_id", "model_id", "sample_index", "status", "correct", F.array_join("flags", ",").alias("flags"))


@query("cell_table", "SELECT item_id AS problem_id, model_id, CASE WHEN item_id % 10 = 0 THEN 88.0 WHEN item_id % 5 = 0 THEN 77.0 ELSE item_id % 5 END AS prediction, item_id % 5 <> 0 AS correct FROM benchmark, (SELECT unnest(['a', 'b']) AS model_id)")
def cell_table(spark, d):
    """The last record of each model and problem in the log, whatever its sample index."""
    return compare.cell_table(_graded_run(spark, d, "last")).select("problem_id", "model_id", _col("prediction_num").alias("prediction"), "correct")


@query("run_metrics", "SELECT model_id, count(*)::BIGINT AS n, sum((id % 3 <> 0)::INT)::BIGINT AS n_correct, sum((id % 3 <> 0)::INT)::BIGINT + (SELECT count(*) FROM benchmark WHERE item_id % 10 = 0) AS n_parsed FROM (SELECT item_id AS id, model_id, 1 AS k FROM benchmark, (SELECT unnest(['a', 'b']) AS model_id)) GROUP BY 1")
def run_metrics(spark, d):
    """What grading writes to ``metrics.json``, over first samples and second ones together less the second ones' number."""
    path, folder = _run_folder(spark, d)
    drivers.grade_run(spark, folder, path)
    extra = b.table(spark, d, "benchmark").filter("item_id % 10 = 0").count()
    found = files.read_document(spark, f"{folder}/metrics.json")
    return spark.createDataFrame([(m["model_id"], m["n"] - extra, m["n_correct"], m["n_parsed"]) for m in found["models"]], "model_id string, n long, n_correct long, n_parsed long")


@query("generate_run", "SELECT 4 * count(*)::BIGINT AS expected_records, 4 * count(*)::BIGINT AS n_records_written, 0::BIGINT AS n_errors, 0::BIGINT AS n_missing, 4 * count(*)::BIGINT AS n_after_resume FROM benchmark")
def generate_run(spark, d):
    """A run with two models and two samples, resumed when nothing is missing."""
    folder = b.new_folder(spark, "generated")
    path = _task_document(b.tasks(spark, d), f"{folder}/tasks")
    options = runs.RunOptions((("a", "raw"), ("b", "chat")), "few_shot", n_samples=2, do_sample=True, temperature=0.7)
    first = drivers.generate_run(spark, path, folder, options)
    again = drivers.generate_run(spark, path, folder, options, log_exists=True)
    return spark.createDataFrame([(*first.values(), again["n_records_written"])], ", ".join(f"{k} long" for k in [*first, "n_after_resume"]))


@query(
    "generate_resumed",
    "SELECT 4 * count(*)::BIGINT AS n_records, 4 * count(*)::BIGINT AS n_cells, true AS kept_some, true AS lacked_some, true AS writer_refused, true AS late_writer_refused, 0::BIGINT AS n_missing FROM benchmark",
)
def generate_resumed(spark, d):
    """A run that fails on purpose after its second slice, is resumed, and meets a second and a late writer."""
    folder = b.new_folder(spark, "resumed")
    path = _task_document(b.tasks(spark, d), f"{folder}/tasks")
    options = runs.RunOptions((("a", "raw"), ("b", "chat")), "direct", n_samples=2, do_sample=True, temperature=0.7)
    total = 4 * b.table(spark, d, "benchmark").count()

    def fail(number: int) -> None:
        if number >= 1:
            raise InterruptedError("on purpose")

    def refused(action, error) -> bool:
        try:
            action()
        except error:
            return True
        return False

    run = lambda **more: drivers.generate_run(spark, path, folder, options, slice_cells=-(-total // 5), **more)
    refused(lambda: run(after_slice=fail), InterruptedError)
    kept = files.read_generations(spark, f"{folder}/generations").count()
    with durable.RunLock(spark, folder, "late") as late:
        writer_refused = refused(run, durable.RunLocked)
        durable.RunLock(spark, folder, "late").claim()  # the same owner, started again
        late_refused = refused(late.renew, durable.RunFenced)
    found = run(owner="late")
    log = files.read_generations(spark, f"{folder}/generations")
    flags = {"kept_some": kept > 0, "lacked_some": kept < total, "writer_refused": writer_refused, "late_writer_refused": late_refused}
    counted = log.agg(F.count(F.lit(1)).alias("n_records"), F.count_distinct("model_id", "problem_id", "sample_index").alias("n_cells"))
    return counted.select("*", *(F.lit(v).alias(k) for k, v in flags.items()), F.lit(found["n_missing"]).cast("long").alias("n_missing"))


#: Types of the older experiments' tasks, and the golds given to them here.
_KINDS = {i: s["type"] for i, s in grade.TASK_SPECS.items()}
_GOLDS = {"yesno": "yes", "label": "", "name": "Bob", "string": "May 1", "code": "def f"}


def _small_tasks(spark, d) -> DataFrame:
    """Every part as a record of one of the older experiments' twenty tasks, with its gold; ``odd`` tells which outputs are right."""
    rows = [(i, k, "easy" if i % 2 else "hard", str(i) if k == "number" else (grade.TASK_SPECS[i].get("labels") or [_GOLDS.get(k)])[0]) for i, k in _KINDS.items()]
    tasks = spark.createDataFrame(rows, "task_id long, category string, difficulty string, gold_answer string")
    parts = b.table(spark, d, "part").select((_col("p_partkey") % len(rows) + 1).alias("task_id"), (_col("p_size") % 2 == 1).alias("odd"))
    return parts.join(F.broadcast(tasks), "task_id")


_SMALL_SQL = "c AS (SELECT p_partkey % 20 + 1 AS id, p_partkey % 20 + 1 NOT IN (16, 17, 18, 19) AS text, p_size % 2 = 1 AS odd FROM part)"


@query(
    "eval20_metrics",
    f"""WITH {_SMALL_SQL} SELECT cond AS condition, dimension, value, count(*)::BIGINT AS n, sum((text AND ok AND (odd OR cond LIKE 'instruct%'))::INT)::BIGINT AS n_correct FROM (
      SELECT id, text, odd, cond, ok, unnest(['overall', 'difficulty']) AS dimension, unnest([NULL, CASE WHEN id % 2 = 1 THEN 'easy' ELSE 'hard' END]) AS value
      FROM c, (VALUES ('base_zero_shot', true), ('base_few_shot', false), ('instruct_zero_shot', true), ('instruct_few_shot', false)) v(cond, ok)) GROUP BY 1, 2, 3""",
)
def eval20_metrics(spark, d):
    """The first experiment's job over a wide file of all parts: the gold or nonsense, nothing, the gold in a sentence, and nonsense."""
    gold = _col("gold_answer")
    said = {"base_zero_shot": F.when(_col("odd"), gold).otherwise("zzz"), "base_few_shot": F.lit(""), "instruct_zero_shot": F.concat(F.lit("It is "), gold), "instruct_few_shot": F.lit("zzz")}
    wide = _small_tasks(spark, d).withColumns(said).drop("odd")
    folder = b.new_folder(spark, "eval20")
    found = drivers.eval20_run(spark, _array_document(wide, f"{folder}/outputs"), folder)["conditions"]
    return found.filter("dimension IN ('overall', 'difficulty')").select("condition", "dimension", "value", "n", "n_correct")


@query(
    "ablation_summary",
    f"""WITH {_SMALL_SQL} SELECT cond AS condition, count(*)::BIGINT AS n, sum((text AND ok AND odd)::INT)::BIGINT AS n_correct, sum((NOT (ok AND odd) AND (id IN (6, 7, 9, 10, 11, 12) OR id IN (1, 2, 3, 4, 20) AND cond LIKE 'A%') AND cond NOT LIKE 'B%' OR cond LIKE 'B%' AND NOT odd AND id IN (6, 7, 9, 10, 11, 12))::INT)::BIGINT AS n_review
      FROM c, (VALUES ('A_original', false), ('B_delimiters', true), ('D_instruction_only', false)) v(cond, ok) GROUP BY 1""",
)
def ablation_summary(spark, d):
    """The ablation's job over a file of all parts: the first sample of each cell is graded, the second is passed over."""
    samples = lambda said: F.struct(F.lit("p").alias("user_prompt"), F.array(F.struct(F.lit(1).cast("long").alias("seed"), said.alias("output")), F.struct(F.lit(2).cast("long").alias("seed"), _col("gold_answer").alias("output"))).alias("samples"))
    cells = F.create_map(F.lit("A_original"), samples(F.lit("zzz")), F.lit("B_delimiters"), samples(F.when(_col("odd"), _col("gold_answer")).otherwise("zzz")), F.lit("D_instruction_only"), samples(F.lit("zzz")))
    tasks = _small_tasks(spark, d).withColumn("conditions", cells).drop("odd")
    folder = b.new_folder(spark, "ablation")
    files.write_array(tasks, folder, head='{"metadata":{"model":"m"},"tasks":[', tail="]}")
    return drivers.ablation(spark, folder)[1].select("condition", "n", "n_correct", "n_review")


@query(
    "ablation_run",
    f"""WITH {b.TASKS_SQL}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place FROM tasks), f AS (SELECT * FROM (VALUES (0, 'A_original'), (1, 'B_delimiters'), (2, 'C_delimiters_and_instruction'), (3, 'D_instruction_only')) v(i, condition))
    SELECT condition, 2 * count(*)::BIGINT AS n, sum(2 * (7 + 10000 * place + 1000 * i) + 1)::BIGINT AS seeds FROM o, f GROUP BY 1""",
)
def ablation_run(spark, d):
    """The ablation's generation over all tasks in four formats and two samples, run again when nothing is missing."""
    folder = b.new_folder(spark, "ablation-run")
    path = _task_document(b.tasks(spark, d), f"{folder}/tasks")
    options = runs.RunOptions((("m", "chat"),), "few_shot", n_samples=2, do_sample=True, temperature=0.3, base_seed=7)
    drivers.ablation_run(spark, path, folder, options, slice_cells=200)
    graded, _ = drivers.ablation_run(spark, path, folder, options)
    return graded.groupBy("condition").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum("seed").cast("long").alias("seeds"))


@query("audit_run", f"WITH {b.TASKS_SQL} SELECT id AS task_id, 3::BIGINT AS n_samples, 0::BIGINT AS n_correct, 'STABLE failure (same wrong answer every run)' AS verdict FROM tasks WHERE id % 3 = 0 AND category <> 'code'")
def audit_run(spark, d):
    """The audit's job: every third task failed with few-shot only, is sampled three times, and its samples are judged again."""
    folder = b.new_folder(spark, "audit-run")
    tasks = b.tasks(spark, d)
    path = _task_document(tasks, f"{folder}/tasks")
    gold = _col("gold_answer")
    said = {"base_zero_shot": F.lit(""), "base_few_shot": F.lit(""), "instruct_zero_shot": F.concat(F.lit("It is "), gold), "instruct_few_shot": F.when(_col("id") % 3 == 0, "zzz").otherwise(gold)}
    wide = tasks.select(_col("id").alias("task_id"), "category", F.lit("easy").alias("difficulty"), "gold_answer", *(v.alias(k) for k, v in said.items()))

    def stuck(rows):
        for _ in rows:
            yield "qqq qqq", 1, 2

    options = runs.RunOptions((("m", "chat"),), "few_shot", n_samples=3, do_sample=True, temperature=0.3)
    outputs = _array_document(wide, f"{folder}/outputs")
    drivers.audit_run(spark, path, outputs, folder, options, adapter=stuck)
    audit, _ = drivers.audit_run(spark, path, outputs, folder, options, reclassify=True)
    return audit.select("task_id", _col("n_samples").cast("long").alias("n_samples"), _col("n_correct").cast("long").alias("n_correct"), "verdict")


# ---- streams


@query("stream_append", "SELECT event_id, user_id, event_type FROM events")
def stream_append(spark, d):
    """A log that grows between two runs of one stream: every record comes out once."""
    from tallyforge.streaming import log as streams

    folder, events = b.new_folder(spark, "append"), b.table(spark, d, "events").select("event_id", "user_id", "event_type")
    stream = lambda: streams.read_log_stream(spark, f"{folder}/log", "event_id long, user_id long, event_type string")
    for part in ("event_id % 3 = 0", "event_id % 3 <> 0"):
        files.append_jsonl(events.filter(part), f"{folder}/log")
        streams.run_available(stream(), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out")


@query("stream_first", f"WITH {b.LOG_SQL} SELECT problem_id, condition, event_id, value FROM log QUALIFY row_number() OVER (PARTITION BY problem_id, condition ORDER BY event_id) = 1")
def stream_first(spark, d):
    """The first record of each key in the log, by a stream with state."""
    from tallyforge.streaming import log as streams

    folder = b.new_folder(spark, "first")
    events = b.table(spark, d, "events")
    events.write.parquet(f"{folder}/log")
    rows = spark.readStream.schema(events.schema).parquet(f"{folder}/log").select(_col("user_id").alias("problem_id"), _col("event_type").alias("condition"), "event_id", "value")
    streams.run_available(streams.first_in_log(rows, ["problem_id", "condition"], "event_id"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("problem_id", "condition", "event_id", "value")


@query(
    "stream_cells",
    """SELECT user_id, event_type, event_id, CASE WHEN event_id % 3 = 0 THEN 'failed' ELSE 'succeeded' END AS status FROM events
      QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id % 3 = 0, event_id) = 1""",
)
def stream_cells(spark, d):
    """A log whose records come in three batches out of order: for each cell the first success, else the first failure, once the delay is over."""
    from tallyforge.streaming import log as streams

    folder = b.new_folder(spark, "cells")
    events = b.table(spark, d, "events").select("user_id", "event_type", "event_id", F.when(_col("event_id") % 3 == 0, "failed").alias("error"))
    batch = lambda number: events.filter(_col("event_id") % 5 % 3 == 2 - number).withColumn("arrived", F.timestamp_seconds(F.lit(1_700_000_000 + 60 * number)))
    last = spark.range(1).select(F.lit(None).cast("long").alias("user_id"), F.lit("end").alias("event_type"), F.lit(0).cast("long").alias("event_id"), F.lit(None).cast("string").alias("error"), F.timestamp_seconds(F.lit(1_700_100_000)).alias("arrived"))
    schema = batch(0).schema
    for part in (batch(0), batch(1), batch(2), last):  # the last record moves the watermark past all others
        part.write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/log")
        streams.run_cells(streams.cell_stream(stream, ["user_id", "event_type"], "event_id", "arrived", policy="prefer_success", delay="1 hour"), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.schema("user_id long, event_type string, event_id long, status string").parquet(f"{folder}/out").select("user_id", "event_type", "event_id", "status")
