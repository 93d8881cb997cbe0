"""Mixing sources to target weights.

Sizes are summed per source; the mix's volume is poured over the sources by weight until each
is full at `cap` times its size; a document is emitted floor(rate) times and once more when a
hash-seeded uniform number falls below the fraction.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, flagged, keep, read, stash

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
CAP = 2.0
SEED = "mix"
SALTS = 64


def source_rates(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target, rate) for each source of (source, size).

    A source's share is weight times a common level, or its cap if less.  Ordered by cap over
    weight, full sources come first, so the level follows from running sums.  One task orders
    the sources: their number is that of labels, not of documents.
    """
    sums = sized.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    sums = sums.withColumn("pos", F.row_number().over(order) - 1).withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("pos") % len(weights) + 1).cast("int")))
    fill = Window.orderBy(F.col("full"), F.col("pos"))
    all_rows = Window.partitionBy()
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(all_rows) - F.coalesce(F.sum(F.lit(cap) * F.col("source_size")).over(before), F.lit(0.0))) / F.sum("w").over(after)
    levelled = sums.withColumn("full", F.lit(cap) * F.col("source_size") / F.col("w")).withColumn("level", level)
    fits = levelled.withColumn("level", F.min_by(F.when(F.col("level") <= F.col("full"), F.col("level")), F.when(F.col("level") <= F.col("full"), F.col("full"))).over(all_rows))
    target = F.when(F.col("level").isNull(), F.lit(cap) * F.col("source_size")).otherwise(F.least(F.lit(cap) * F.col("source_size"), F.col("level") * F.col("w")))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(cap), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    return fits.withColumn("target", target).withColumn("rate", rate).select("source", "source_size", "target", "rate")


def _unit(name: Column) -> Column:
    """A number in [0, 1) by the hash of a name."""
    return F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double") / F.lit(float(16**13))


def drawn(docs: DataFrame, seed: str) -> DataFrame:
    """`docs` with __jx_u, the number each row draws: by doc_id, or where that is null or repeated by id, text, source and a number among equal rows.

    Equal rows are numbered within salts, and salts follow each other, so no task holds a group.
    """
    sha = F.sha2(F.coalesce("text", F.lit("")), 256)
    repeated = keep(docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"))
    marked = flagged(docs, ["doc_id"], repeated)
    own = _unit(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")))
    sure = marked.filter("doc_id is not null and not __jx_maybe").select(*docs.columns, own.alias("__jx_u"))
    told = repeated.select(F.col("doc_id").alias("__jx_id"))
    maybe = marked.filter("doc_id is null or __jx_maybe").join(told, F.col("doc_id") == F.col("__jx_id"), "left")
    name = F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), sha, F.coalesce("source", F.lit("")))
    maybe = maybe.withColumns({"__jx_name": name, "__jx_salt": F.floor(F.rand(7) * SALTS).cast("int")})
    odd = stash(maybe.select(*docs.columns, "__jx_id", "__jx_name", "__jx_salt"), "repeated")
    of = ["__jx_name", "__jx_salt"]
    before = Window.partitionBy("__jx_name").orderBy("__jx_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = odd.filter("doc_id is null or __jx_id is not null").groupBy(*of).agg(F.count("*").alias("n")).select(*of, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__jx_before"))
    number = F.col("__jx_before") + F.row_number().over(Window.partitionBy(*of).orderBy(F.lit(0)))
    numbered = odd.filter("doc_id is null or __jx_id is not null").join(counts, of).withColumn("__jx_u", _unit(F.concat_ws(":", "__jx_name", number.cast("string"))))
    once = odd.filter("doc_id is not null and __jx_id is null").withColumn("__jx_u", own)
    return sure.unionByName(numbered.select(sure.columns)).unionByName(once.select(sure.columns))


def plan_mix(docs: DataFrame, seed: str = SEED, **options) -> DataFrame:
    """`docs` with the struct column __jx_mix (size, source_size, target, copies).

    Null texts have size 0, null sources form a source of their own.  A row draws by its doc_id,
    one without an id or with an id that repeats by id, text, source and its number among equal
    rows, so that many of them come near the target.  Reruns agree, but for which of equal rows is
    taken.  Texts are read whole; empty tables give no rows.  The rates meet the documents in an equi join whose key is salted at random, as one
    source may hold a third of the rows; every rate is at every salt, so results do not depend
    on the salt.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    rates = source_rates(docs.select("source", size.alias("size")), **options)
    rates = rates.select(F.struct("source_size", "target", "rate").alias("__jx_rate"), F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")).alias("__jx_src"))
    rates = rates.withColumn("__jx_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    marked = drawn(docs, seed).withColumns({
        "__jx_size": size,
        "__jx_src": F.struct(F.col("source").isNull().alias("n"), F.coalesce("source", F.lit("")).alias("s")),
        "__jx_salt": F.floor(F.rand(6) * SALTS).cast("int"),
    })
    joined = marked.join(rates, ["__jx_src", "__jx_salt"])
    rate = F.col("__jx_rate.rate")
    copies = F.floor(rate) + F.when(F.col("__jx_u") < rate - F.floor(rate), 1).otherwise(0)
    mixed = F.struct(F.col("__jx_size").alias("size"), F.col("__jx_rate.source_size").alias("source_size"), F.col("__jx_rate.target").alias("target"), copies.cast("bigint").alias("copies"))
    return joined.withColumn("__jx_mix", mixed).select(*docs.columns, "__jx_mix")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of `docs`, whatever their names, each row as often as it is taken.

    Nulls, repeated rows and empty tables as in `plan_mix`.
    """
    planned = plan_mix(docs, **options).filter("__jx_mix.copies > 0")
    return planned.withColumn("__jx_copy", F.explode(F.sequence(F.lit(1), F.col("__jx_mix.copies").cast("int")))).select(docs.columns)


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    m = F.col("__jx_mix")
    return planned.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["copies"] * m["size"]).alias("taken"))


SQL = {
    "op6_mix": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    CASE WHEN count(doc_id) OVER (PARTITION BY doc_id) = 1 THEN 'mix:' || doc_id
      ELSE concat('mix:', coalesce(doc_id::VARCHAR, ''), ':', sha256(coalesce(text, '')), ':', coalesce(source, ''), ':', row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), coalesce(source, ''))) END AS name FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS pos FROM d GROUP BY source),
w AS (SELECT *, CASE pos % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w FROM s),
f AS (SELECT *, 2.0::DOUBLE * source_size / w AS full_at FROM w),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (ORDER BY full_at, pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY full_at, pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM f),
t AS (
  SELECT source, source_size, least(2.0::DOUBLE * source_size, w * (SELECT arg_min(lv, full_at) FROM l WHERE lv <= full_at)) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(2.0::DOUBLE, target / source_size) ELSE 0 END AS rate FROM t)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate) + CASE WHEN ('0x' || substr(md5(name), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""
}
QUERIES = {"op6_mix": op6_mix}
