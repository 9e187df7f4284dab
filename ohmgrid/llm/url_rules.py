"""URL filter by hashed expressions.

Every URL is expanded into (host suffix + path prefix) expressions, as in hash
prefix block lists: the expressions are joined to the rules by an equi-join on a
short digest prefix, survivors are confirmed by the full SHA-256 and the longest
confirmed rule decides.  All steps are built-in column functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm.common import ASCII_LOWER, ASCII_UPPER

#: Rules of the production query: (host, path prefix, verdict).
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]
PREFIX_HEX = 8
DEFAULT_VERDICT = "allow"
#: Rules up to this many are sent to every task; more are joined by a shuffle.
BROADCAST_RULES = 200_000


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.expr("substring(url_in, locate('://', url_in) + 3)")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    return F.when(F.instr(url, "://") > 0, F.translate(host, ASCII_UPPER, ASCII_LOWER)).otherwise("")


def path_of(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; empty without ``://``."""
    rest = F.expr("substring(url_in, locate('://', url_in) + 3)")
    return F.when(F.instr(url, "://") > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(rule, verdict, digest, prefix) of each rule."""
    table = spark.createDataFrame(rules, "rule_host string, rule_path string, rule_verdict string")
    digest = F.sha2(F.concat_ws("", "rule_host", "rule_path"), 256)
    return table.select(
        F.concat("rule_host", "rule_path").alias("rule"),
        "rule_verdict",
        digest.alias("rule_digest"),
        F.substring(digest, 1, PREFIX_HEX).alias("short"),
    )


def judge_urls(
    pages: DataFrame,
    rules: list[tuple[str, str, str]],
    key: str = "page_id",
    url: str = "url",
    default: str = DEFAULT_VERDICT,
) -> DataFrame:
    """One row per row of ``pages``: key, host, path, rule, verdict.

    A rule fits its host and all its subdomains if the path starts with the
    rule's path; the rule with the longest text wins, equal lengths by text.
    Nulls and URLs without ``://`` have an empty host and path, fit no rule and
    get ``default``; so do all rows if ``rules`` is empty.  Keys may repeat or be
    null: rows are told apart by their own number.  Other columns are ignored.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, path, _ in rules}) or [0]
    most_labels = max([1, *(host.count(".") + 1 for host, _, _ in rules)])
    rows = pages.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("page_key"),
        F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url_in"),
    )
    parts = rows.select("row", "page_key", host_of(F.col("url_in")).alias("host"), path_of(F.col("url_in")).alias("path"))
    labels = F.split("host", r"\.", -1)
    # A suffix longer than every rule's host can fit none of them.
    suffixes = F.transform(
        F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))),
        lambda n: F.array_join(F.slice(labels, F.size(labels) - n + 1, n), "."),
    )
    wanted = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    prefixes = F.transform(wanted, lambda n: F.expr("path").substr(F.lit(1), n))
    expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    expanded = parts.select("row", "page_key", "host", "path", F.explode_outer(expressions).alias("expression"))
    digested = expanded.withColumn("digest", F.sha2("expression", 256))
    table = rule_table(spark, rules)
    if len(rules) <= BROADCAST_RULES:
        table = F.broadcast(table)
    met = digested.join(table, F.substring("digest", 1, PREFIX_HEX) == F.col("short"), "left")
    confirmed = F.when(F.col("digest") == F.col("rule_digest"), F.struct(F.length("rule").alias("n"), "rule", "rule_verdict"))
    best = met.groupBy("row", "page_key", "host", "path").agg(F.max(confirmed).alias("best"))
    return best.select(
        F.col("page_key").alias(key),
        "host",
        "path",
        F.col("best.rule").alias("rule"),
        F.coalesce(F.col("best.rule_verdict"), F.lit(default)).alias("verdict"),
    )


def op9_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every URL of ``pages`` judged by the production rules."""
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE_SQL = r"""
WITH parts AS (
  SELECT page_id, row_number() OVER () AS n,
         CASE WHEN contains(url, '://') THEN
           translate(regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
         CASE WHEN contains(url, '://') THEN
           regexp_extract(substr(url, instr(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path
  FROM pages),
rules(rule_host, rule_path, rule_verdict) AS (VALUES
  ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
fits AS (
  SELECT p.n, r.rule_host || r.rule_path AS rule, r.rule_verdict,
         row_number() OVER (PARTITION BY p.n ORDER BY length(r.rule_host || r.rule_path) DESC) AS k
  FROM parts p JOIN rules r
    ON (p.host = r.rule_host OR suffix(p.host, '.' || r.rule_host)) AND starts_with(p.path, r.rule_path))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.rule_verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.n = p.n AND f.k = 1
"""
