"""Deterministic completions, runs and logs over the driver's tables, as DataFrames and as the same SQL for the oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Completion text by line number: one template for each strategy of number extraction.
_TEMPLATES = (
    ("The answer is ", " units."), ("Working...\nAnswer: ", ""), ("So we get \\boxed{", "} in total"), ("Now the final answer, as computed: ", " kg"),
    ("That makes **", "** of 500 parts"), ("3 + 4 = ", " boxes"), ("about 12 or rather ", " apples"),
)


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number completions of ``lineitem``: problem_id, model_id, condition, category, difficulty, gold_answer, completion_text, n_output_tokens, max_new_tokens."""
    rows = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("long").cast("string")
    text = F.lit("")
    for i, (head, tail) in enumerate(_TEMPLATES, 1):
        text = F.when(F.col("l_linenumber") == i, F.concat(F.lit(head), q, F.lit(tail))).otherwise(text)
    gold = F.when(F.col("l_orderkey") % 5 == 0, F.col("l_quantity").cast("long") + 1).otherwise(F.col("l_quantity").cast("long"))
    return rows.select(
        F.col("l_orderkey").alias("problem_id"), F.when(F.col("l_suppkey") % 2 == 0, "base").otherwise("instruct").alias("model_id"),
        F.col("l_linenumber").cast("long").alias("line"), F.col("l_returnflag").alias("category"), F.col("l_linestatus").alias("difficulty"),
        gold.cast("string").alias("gold_answer"), text.alias("completion_text"), (F.col("l_partkey") % 220).alias("n_output_tokens"), F.lit(200).cast("long").alias("max_new_tokens"),
    )


def _sql_text() -> str:
    cases = " ".join("WHEN {} THEN '{}' || q || '{}'".format(i, head.replace("\n", "' || chr(10) || '"), tail) for i, (head, tail) in enumerate(_TEMPLATES, 1))
    return f"CASE l_linenumber {cases} ELSE '' END"


COMPLETIONS_SQL = f"""completions AS (
  SELECT l_orderkey AS problem_id, CASE WHEN l_suppkey % 2 = 0 THEN 'base' ELSE 'instruct' END AS model_id, l_linenumber::BIGINT AS line,
    l_returnflag AS category, l_linestatus AS difficulty, (l_quantity::BIGINT + CASE WHEN l_orderkey % 5 = 0 THEN 1 ELSE 0 END)::VARCHAR AS gold_answer,
    {_sql_text()} AS completion_text, l_partkey % 220 AS n_output_tokens, 200::BIGINT AS max_new_tokens
  FROM (SELECT *, l_quantity::BIGINT::VARCHAR AS q FROM lineitem)
)"""
_N = r"-?\$?\d[\d,]*\.?\d*(?:\s*/\s*\d+)?"


def _sql_last(pattern: str, name: str) -> str:
    return f"list_transform(regexp_extract_all(completion_text, '{pattern}', 1), lambda x: try_cast(rtrim(replace(replace(x, ',', ''), '$', ''), '.') AS DOUBLE)) AS {name}"


#: The cascade of strategies, without boxes inside boxes and fractions, which the templates do not make.
EXTRACTED_SQL = rf"""{COMPLETIONS_SQL}, candidates AS (
  SELECT *, {_sql_last(r'\\boxed\s*\{([^{}]*)\}', 'c1')}, {_sql_last(rf'(?i)answer\s+(?:is\s+|=+\s*)?(?:approximately\s+)?({_N})', 'c2')},
    {_sql_last(rf'(?i)answer\s*:\s*({_N})', 'c3')}, {_sql_last(rf'(?i)final\s+answer[^\d\-]*({_N})', 'c4')}, {_sql_last(rf'\*\*[^*\d]*({_N})[^*]*\*\*', 'c5')},
    {_sql_last(rf'=\s*({_N})', 'c6')}, {_sql_last(rf'({_N})', 'c7')} FROM completions
), extracted AS (
  SELECT * EXCLUDE (c1, c2, c3, c4, c5, c6, c7),
    CASE WHEN len(c1) > 0 THEN 'boxed' WHEN len(c2) > 0 THEN 'answer_is' WHEN len(c3) > 0 THEN 'answer_colon' WHEN len(c4) > 0 THEN 'final_answer'
      WHEN len(c5) > 0 THEN 'bold' WHEN len(c6) > 0 THEN 'equals' WHEN len(c7) > 0 THEN 'last_number' END AS strategy,
    CASE WHEN len(c1) > 0 THEN c1 WHEN len(c2) > 0 THEN c2 WHEN len(c3) > 0 THEN c3 WHEN len(c4) > 0 THEN c4 WHEN len(c5) > 0 THEN c5 WHEN len(c6) > 0 THEN c6 ELSE c7 END AS vals
  FROM candidates
), graded AS (
  SELECT *, vals[-1] AS prediction, coalesce(abs(vals[-1] - gold_answer::DOUBLE) < 1e-6, false) AS correct, CASE WHEN len(vals) > 0 THEN 'parsed' ELSE 'unparsed' END AS status FROM extracted
)"""


def runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two runs over the same problems: of each order's lines with an odd and with an even number the first; orders that lack one kind are in neither run."""
    lines = table(spark, sf_dir, "lineitem").withColumn("side", F.col("l_linenumber") % 2)
    orders = table(spark, sf_dir, "orders")
    first = lines.groupBy("l_orderkey", "side").agg(F.min_by(F.struct("l_returnflag", "l_linestatus", "l_partkey"), F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("x"))
    both = first.groupBy("l_orderkey").agg(F.max(F.when(F.col("side") == 1, F.col("x"))).alias("one"), F.max(F.when(F.col("side") == 0, F.col("x"))).alias("two")).filter("one IS NOT NULL AND two IS NOT NULL")
    named = both.join(orders, both.l_orderkey == orders.o_orderkey).select(F.col("l_orderkey").alias("problem_id"), F.concat(F.lit("m"), (F.col("o_custkey") % 3).cast("string")).alias("model_id"), F.col("o_orderpriority").alias("category"), F.col("o_orderstatus").alias("difficulty"), "one", "two")
    side = lambda c: named.select("problem_id", "model_id", "category", "difficulty", F.lit(0).cast("long").alias("sample_index"), (F.col(f"{c}.l_returnflag") != "R").alias("correct"), F.when(F.col(f"{c}.l_linestatus") == "O", "parsed").otherwise("unparsed").alias("status"), (F.col(f"{c}.l_partkey") % 220).alias("n_output_tokens"))
    return side("one"), side("two")


RUNS_SQL = """lines AS (
  SELECT *, 2 - l_linenumber % 2 AS side FROM lineitem
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_partkey, l_suppkey, l_quantity, l_extendedprice) = 1
), sides AS (
  SELECT l_orderkey AS problem_id, 'm' || (o_custkey % 3) AS model_id, o_orderpriority AS category, o_orderstatus AS difficulty, side,
    l_returnflag <> 'R' AS correct, CASE WHEN l_linestatus = 'O' THEN 'parsed' ELSE 'unparsed' END AS status, l_partkey % 220 AS n_output_tokens
  FROM lines JOIN orders ON l_orderkey = o_orderkey WHERE l_orderkey IN (SELECT l_orderkey FROM lines GROUP BY 1 HAVING count(*) = 2)
), baseline AS (SELECT * FROM sides WHERE side = 1), treatment AS (SELECT * FROM sides WHERE side = 2),
pairs AS (
  SELECT b.problem_id, b.model_id, t.category, b.correct AS b_correct, t.correct AS t_correct,
    CASE WHEN b.correct AND NOT t.correct THEN 'regression' WHEN NOT b.correct AND t.correct THEN 'fix' END AS flip
  FROM baseline b JOIN treatment t ON b.problem_id = t.problem_id AND b.model_id = t.model_id
)"""


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks under four conditions: the order's lines by number, 4 standing for all above it, right if any line with that number was not returned."""
    rows = table(spark, sf_dir, "lineitem").withColumn("l_linenumber", F.least("l_linenumber", F.lit(4)))
    return rows.groupBy(F.col("l_orderkey").alias("task_id"), F.concat(F.lit("c"), F.col("l_linenumber").cast("string")).alias("condition")).agg(
        F.max("l_returnflag").alias("category"), F.max("l_linestatus").alias("difficulty"), (F.count_if(F.col("l_returnflag") != "R") > 0).alias("final_correct")
    )


CELLS_SQL = """cells AS (
  SELECT l_orderkey AS task_id, 'c' || l_linenumber AS condition, max(l_returnflag) AS category, max(l_linestatus) AS difficulty, count(*) FILTER (WHERE l_returnflag <> 'R') > 0 AS final_correct
  FROM (SELECT * REPLACE (least(l_linenumber, 4) AS l_linenumber) FROM lineitem) GROUP BY 1, 2
)"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a generation log: cells (model_id, problem_id), position, error."""
    e = table(spark, sf_dir, "events")
    return e.select((F.col("user_id") % 7).alias("model_id"), F.col("user_id").alias("problem_id"), F.col("event_type").alias("condition"), F.col("ts").alias("position"), F.col("event_id"), F.when(F.col("event_type") == "error", "failed").alias("error"), F.col("value").alias("value"))


LOG_SQL = """log AS (
  SELECT user_id % 7 AS model_id, user_id AS problem_id, event_type AS condition, ts AS position, event_id, CASE WHEN event_type = 'error' THEN 'failed' END AS error, value FROM events
)"""


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as one text of several paragraphs, with cues of behaviour added by rule."""
    c = table(spark, sf_dir, "conversations")
    turns = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("t"))
    text = F.array_join(F.transform("t", lambda x: x["text"]), "\n\n")
    cue = F.when(F.col("conv_id") % 5 == 0, "I'm sorry, as an AI I stop.\n\n").when(F.col("conv_id") % 5 == 1, "Well\nQuestion: why?\nsame line here\nsame line here\n").otherwise("")
    return turns.select("conv_id", F.concat(cue, text).alias("text"))


TRANSCRIPTS_SQL = """transcripts AS (
  SELECT conv_id, CASE conv_id % 5 WHEN 0 THEN 'I''m sorry, as an AI I stop.' || chr(10) || chr(10)
    WHEN 1 THEN 'Well' || chr(10) || 'Question: why?' || chr(10) || 'same line here' || chr(10) || 'same line here' || chr(10) ELSE '' END
    || string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id
)"""


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark texts as prompts, with two demonstrations made from the region and nation tables' size."""
    cue = F.when(F.col("item_id") % 3 == 0, "\nAnswer: ").when(F.col("item_id") % 3 == 1, "\nCode:").otherwise("")
    number = (F.col("item_id") % 7).cast("string")
    prefix = F.concat(F.lit("Q: one?\nAnswer: "), number, F.lit("\n\nQ: two?\nSentiment: good\nmore\n\n"))
    rows = table(spark, sf_dir, "benchmark")
    return rows.select(
        F.col("item_id").alias("id"), F.when(F.col("item_id") % 2 == 0, "math").otherwise("logic").alias("category"), F.when(F.col("item_id") % 4 == 0, "extreme").otherwise("easy").alias("difficulty"),
        F.when(F.col("item_id") % 2 == 0, "number").otherwise("string").alias("answer_type"), F.lit(None).cast("array<string>").alias("labels"), F.lit(None).cast("string").alias("code_tests"),
        F.concat("text", cue).alias("prompt"), prefix.alias("few_shot_prefix"), F.when(F.col("item_id") % 10 == 8, "none").otherwise((F.col("item_id") % 5).cast("string")).alias("gold_answer"),
    )


TASKS_SQL = """tasks AS (
  SELECT item_id AS id, CASE WHEN item_id % 2 = 0 THEN 'math' ELSE 'logic' END AS category, CASE WHEN item_id % 4 = 0 THEN 'extreme' ELSE 'easy' END AS difficulty, CASE WHEN item_id % 2 = 0 THEN 'number' ELSE 'string' END AS answer_type,
    text || CASE item_id % 3 WHEN 0 THEN chr(10) || 'Answer: ' WHEN 1 THEN chr(10) || 'Code:' ELSE '' END AS prompt, text,
    'Q: one?' || chr(10) || 'Answer: ' || item_id % 7 || chr(10) || chr(10) || 'Q: two?' || chr(10) || 'Sentiment: good' || chr(10) || 'more' || chr(10) || chr(10) AS few_shot_prefix,
    CASE WHEN item_id % 10 = 8 THEN 'none' ELSE (item_id % 5)::VARCHAR END AS gold_answer FROM benchmark
)"""


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder for files of a run or a stream, below the session's checkpoint folder or a local one in local mode."""
    import atexit
    import shutil
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tallyforge-stream-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
