"""Exact deduplication by skew-safe combining.

1. Locally: each task combines its own equal rows (Spark's partial aggregate).
2. Salted: rows of a digest are dealt over SALTS tasks and combined there.
3. Globally: the salt winners of a digest are combined; at most SALTS rows a text.

The normalised text itself is a grouping key at every stage, so equality is equality of
content, never of digests alone.  Members then find their group by SHA-256, a second 64-bit
hash, the length and the salt, which spreads a group that holds a third of all rows.  Rows
without a key are dealt at random and find their group at every salt.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, flagged, keep, read

SALTS = 64
#: A rank orders texts by code points, then by smaller doc_id; a decimal stays in hash aggregates.
_SHIFT = "100000000000000000000"
_MAX = "9223372036854775808"


def _rank(n_chars: Column, doc_id: Column) -> Column:
    big = lambda c: c.cast("decimal(20,0)")
    return (big(n_chars) * F.lit(_SHIFT).cast("decimal(21,0)")).cast("decimal(38,0)") + F.coalesce(F.lit(_MAX).cast("decimal(20,0)") - big(doc_id), F.lit(0).cast("decimal(20,0)"))


def _doc_of(rank: Column) -> Column:
    rest = rank % F.lit(_SHIFT).cast("decimal(21,0)")
    return F.when(rest > 0, (F.lit(_MAX).cast("decimal(20,0)") - rest).cast("bigint"))


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def exact_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row (key, keep_id, group_size, kept, text_sha256) for each row of `docs`.

    Texts are equal when identical after deleting ASCII white space; null counts as empty.  Of
    equal texts the one with most code points stays, then the smallest key; null keys lose.
    Rows that repeat key and text all count in group_size and all are marked kept.  Empty
    tables give no rows; other columns are ignored.  `digest` can be replaced in tests.
    """
    digest = digest or (lambda t: F.sha2(t, 256))
    salts = max(SALTS, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = F.when(F.col("k").isNull(), F.floor(F.rand(2) * salts)).otherwise(F.pmod(F.xxhash64("k", "n"), F.lit(salts))).cast("int")
    rows = docs.select(F.col(key).cast("bigint").alias("k"), F.length(F.coalesce(F.col(text), F.lit(""))).alias("n"), normalised(F.col(text)).alias("norm"))
    rows = rows.withColumns({"digest": digest(F.col("norm")), "check": F.xxhash64("norm"), "size": F.length("norm"), "salt": dealt})
    salted = rows.groupBy("digest", "check", "size", "salt", "norm").agg(F.max(_rank(F.col("n"), F.col("k"))).alias("rank"), F.count("*").alias("rows"), F.bool_or(F.col("k").isNull()).alias("nameless"))
    whole = salted.groupBy("digest", "check", "size", "norm").agg(F.max("rank").alias("rank"), F.sum("rows").alias("group_size"), F.when(F.bool_or("nameless"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.collect_list("salt")).alias("salts"))
    groups = whole.select("digest", "check", "size", F.explode("salts").alias("salt"), _doc_of(F.col("rank")).alias("keep_id"), "group_size", F.sha2("norm", 256).alias("text_sha256"))
    found = rows.drop("norm").join(groups, ["digest", "check", "size", "salt"])
    return found.select(F.col("k").alias(key), "keep_id", "group_size", F.col("k").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def drop_exact(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that stay, with all columns; of rows that repeat key and text, one.

    Only rows that go or repeat, as told by a bitmap, are shuffled with their texts.
    """
    named = ["__jx_id", "__jx_sha"]
    groups = exact_groups(docs).select(F.col("doc_id").alias("__jx_id"), F.col("text_sha256").alias("__jx_sha"), "kept")
    odd = keep(groups.groupBy(*named).agg(F.bool_or("kept").alias("__jx_kept"), F.count("*").alias("n")).filter("not __jx_kept or n > 1").drop("n"))
    marked = flagged(docs.withColumns({"__jx_id": F.col("doc_id").cast("bigint"), "__jx_sha": F.sha2(normalised(F.col("text")), 256)}), named, odd)
    maybe = marked.filter("__jx_maybe").alias("m")
    told = odd.select(F.col("__jx_id").alias("o_id"), F.col("__jx_sha").alias("o_sha"), "__jx_kept")
    maybe = maybe.join(told, F.col("__jx_id").eqNullSafe(F.col("o_id")) & (F.col("__jx_sha") == F.col("o_sha")), "left")
    parts = [marked.filter("not __jx_maybe"), maybe.filter("__jx_kept is null"), maybe.filter("__jx_kept").dropDuplicates(named)]
    return reduce(DataFrame.unionByName, (part.select(docs.columns) for part in parts))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


SQL = {
    "op2_exact_dedup": r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
g AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
}
QUERIES = {"op2_exact_dedup": op2_exact_dedup}
