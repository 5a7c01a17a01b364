"""URL filters: hash-prefix lookup of host-suffix and path-prefix expressions.

Each distinct (host, path) is expanded into every host suffix at a dot whose
number of labels some rule has, joined with every path prefix whose length
some rule has. The expressions meet the
rules in an equi-join on a short hash prefix; the full digest then confirms
the hit, and the longest rule decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm.common import staged

#: (action, host, path): the fixed rules of the query.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Rules of up to so many bytes together, their digests included, are sent to every executor; more are joined by a shuffle.
BROADCAST_BYTES = 16 << 20
#: Hex digits of the digest that the equi-join compares.
PREFIX = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://`` up to ``/ ? #``, A-Z lowered; path up to ``? #``. No ``://``: both empty."""
    has = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.regexp_extract(url, r"(?s)\A.*?://([^?#]*)", 1)
    host = F.translate(F.substring_index(rest, "/", 1), UPPER, LOWER)
    path = F.substring(rest, F.length(host) + 1, F.length(rest))
    empty = F.lit("")
    return F.when(has, host).otherwise(empty), F.when(has, path).otherwise(empty)


def rules_frame(spark: SparkSession, rules) -> DataFrame:
    """Rules as a table (action, rule_host, rule_path) from (action, host, path) tuples."""
    return spark.createDataFrame(list(rules), "action string, rule_host string, rule_path string")


def _keyed(df: DataFrame, host: str, path: str) -> DataFrame:
    digest = F.sha2(F.concat(F.col(host), F.lit("\n"), F.col(path)), 256)
    return df.withColumn("digest", digest).withColumn("prefix", F.substring("digest", 1, PREFIX))


def judge_urls(pages: DataFrame, rules: DataFrame, *, default: str = "allow", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Judges the ``url`` of every row.

    Returns page_id, host, path, rule (host and path of the rule, else null)
    and verdict (the rule's action, else ``default``). A rule fits its host and
    every subdomain if the url's path starts with the rule's path; the longest
    host and path together wins, then the longer host, then the action and
    rule text in order.

    Very long urls are read whole: each is expanded only to as many labels and
    lengths of paths as rules have. Null urls and urls without ``://`` have
    empty host and path and so meet no rule with a host; null page_ids are kept; repeated rows each get a verdict;
    empty tables and an empty rule table work; other columns are not read.
    Repeated urls are judged once: the rows then fetch the verdict by
    (host, path), where adaptive execution splits a frequent pair.
    """
    rules = _keyed(rules.filter("rule_host IS NOT NULL AND rule_host <> '' AND rule_path IS NOT NULL AND action IS NOT NULL").select("action", "rule_host", "rule_path").distinct(), "rule_host", "rule_path")
    size = F.octet_length("rule_host") + F.octet_length("rule_path") + F.octet_length("action") + 150
    n_bytes, lengths, labels_of_rules = rules.agg(F.coalesce(F.sum(size), F.lit(0)), F.array_sort(F.collect_set(F.length("rule_path"))), F.array_sort(F.collect_set(F.size(F.split("rule_host", r"\."))))).first()
    host, path = url_parts(F.col("url").cast("string"))
    urls = pages.select("page_id", host.alias("host"), path.alias("path"))
    # the lengths that rules have are few; a host suffix of another number of labels or a path prefix of another length cannot be a rule's
    suffixes = F.transform(F.filter(F.array(*map(F.lit, labels_of_rules)), lambda n: n <= F.size("labels")), lambda n: F.array_join(F.slice("labels", F.size("labels") - n + 1, n), ".")) if labels_of_rules else F.array().cast("array<string>")
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)) if lengths else F.array().cast("array<string>")
    expressions = urls.filter("host <> ''").select("host", "path").distinct().withColumn("labels", F.split("host", r"\.")).withColumn("x_host", F.explode(suffixes)).drop("labels").withColumn("x_path", F.explode(prefixes)).filter("x_host <> ''")
    looked_up = F.broadcast(rules) if n_bytes <= broadcast_bytes else rules
    hits = _keyed(expressions, "x_host", "x_path").join(looked_up.withColumnRenamed("digest", "rule_digest"), "prefix").filter("digest = rule_digest AND x_host = rule_host AND x_path = rule_path")
    rank = F.struct((F.length("rule_host") + F.length("rule_path")).alias("all"), F.length("rule_host").alias("of_host"), "action", F.concat("rule_host", "rule_path").alias("rule"))
    best = hits.groupBy("host", "path").agg(F.max(rank).alias("best"))
    # a written table, never broadcast: adaptive execution can split a pair that many rows share
    return urls.join(staged(best, "verdicts").hint("merge"), ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.action", F.lit(default)).alias("verdict"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules_frame(spark, RULES))


OP4_SQL = """
WITH u AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN regexp_extract(substr(url, instr(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(split_part(rest, '/', 1)) + 1) AS path FROM (SELECT page_id, coalesce(rest, '') AS rest FROM u)
), r(action, rule_host, rule_path) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), h AS (
  SELECT host, path, max_by(rule_host || rule_path, length(rule_host || rule_path)) AS rule, max_by(action, length(rule_host || rule_path)) AS action
  FROM (SELECT DISTINCT host, path FROM p) JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.action, 'allow') AS verdict FROM p LEFT JOIN h ON p.host = h.host AND p.path = h.path
"""
