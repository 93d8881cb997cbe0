"""URL filters: host-suffix and path-prefix expressions meet rules on short hash prefixes.

Every URL is expanded into (host suffix, path prefix) expressions, no longer than the longest
rule; the expressions equi-join the rules on the first 32 bits of SHA-256, and the full digest
and the rule's whole path confirm a match.  Of the confirmed rules the longest wins.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lower_ascii, read

#: Fixed by contract: (verdict, host, path).
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
BROADCAST_RULES = 20_000
SALTS = 32
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, _URL, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _URL, 2), F.lit(""))


def judge_urls(pages: DataFrame, rules: DataFrame | Sequence[tuple[str, str, str]] = RULES, default: str = "allow", key: str = "page_id", url: str = "url") -> DataFrame:
    """One row (key, host, path, rule, verdict) for each row of `pages`; other columns are ignored.

    Null URLs and URLs without "://" have empty host and path and take the default verdict.
    Repeated rows are judged once and returned as often as they occur; null keys stay null.
    An empty table or no rules are fine.  Of rules that fit, the longest text (host and path)
    wins, then the longer host, then block before allow.  Rules beyond BROADCAST_RULES are not
    broadcast but joined by shuffle, with salted expressions, as "net/" may hold most URLs.
    """
    spark = pages.sparkSession
    if not isinstance(rules, DataFrame):
        rules = spark.createDataFrame([tuple(r) for r in rules], "verdict string, host string, path string")
    rules = (
        rules.select(F.col("verdict").alias("r_verdict"), lower_ascii(F.col("host")).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"))
        .filter("r_host is not null and r_host <> ''")
        .distinct()
        .withColumn("r_dir", F.regexp_extract("r_path", r"(?s)^(.*/)?", 0))
        .withColumn("r_digest", F.sha2(F.concat("r_host", "r_dir"), 256))
        .withColumn("r_prefix", F.substring("r_digest", 1, 8))
    )
    n, labels, depth = rules.agg(F.count("*"), F.max(F.size(F.split("r_host", r"\."))), F.max(F.length("r_dir") - F.length(F.replace("r_dir", F.lit("/"), F.lit(""))))).first()
    rows = (
        pages.groupBy(F.col(key).alias("k"), F.col(url).alias("u")).agg(F.count("*").alias("copies")).withColumn("host", host_of(F.col("u"))).withColumn("path", path_of(F.col("u")))
    )
    if not n:
        judged = rows.withColumn("best", F.lit(None).cast("struct<rule:string,verdict:string>"))
    else:
        parts, steps = F.split("host", r"\."), F.split("path", "/")
        suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda i: F.array_join(F.slice(parts, F.size(parts) - i + 1, i), "."))
        prefixes = F.transform(F.sequence(F.lit(0), F.least(F.size(steps) - 1, F.lit(depth))), lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(steps, 1, i), "/"), F.lit("/"))).otherwise(F.lit("")))
        expressions = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
        opened = (
            rows.select("k", "u", "copies", "host", "path", F.explode(F.when(F.col("host") != "", expressions).otherwise(F.array(F.lit("")))).alias("expr"))
            .withColumn("digest", F.sha2("expr", 256))
            .withColumn("prefix", F.substring("digest", 1, 8))
        )
        on = [F.col("prefix") == F.col("r_prefix")]
        if n <= BROADCAST_RULES:
            rules = F.broadcast(rules)
        else:
            opened = opened.withColumn("salt", F.pmod(F.xxhash64("k", "u"), F.lit(SALTS)))
            rules = rules.withColumn("r_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            on.append(F.col("salt") == F.col("r_salt"))
        confirmed = (F.col("digest") == F.col("r_digest")) & F.startswith("path", F.col("r_path"))
        rule = F.concat("r_host", "r_path")
        best = F.when(confirmed, F.struct(F.length(rule).alias("n"), F.length("r_host").alias("h"), (F.col("r_verdict") == "block").alias("b"), rule.alias("rule"), F.col("r_verdict").alias("verdict")))
        judged = opened.join(rules, on, "left").groupBy("k", "u", "copies", "host", "path").agg(F.max(best).alias("best"))
    return judged.select(
        F.col("k").alias(key), "host", "path", F.col("best.rule").alias("rule"), F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    ).drop("copy")


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read(spark, sf_dir, "pages"))


SQL = {
    "op9_url_filter": f"""
WITH r(verdict, rhost, rpath) AS (VALUES {", ".join(str(r) for r in RULES)}),
u AS (
  SELECT row_number() OVER () AS rid, page_id,
    coalesce(translate(regexp_extract(url, '{_URL}', 1), '{UPPER}', '{LOWER}'), '') AS host,
    coalesce(regexp_extract(url, '{_URL}', 2), '') AS path
  FROM pages),
m AS (
  SELECT u.*, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC NULLS LAST, length(rhost) DESC, verdict DESC) AS k
  FROM u LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM m WHERE k = 1
"""
}
QUERIES = {"op9_url_filter": op9_url_filter}
