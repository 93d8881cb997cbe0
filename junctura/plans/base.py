"""The driver's tables seen as genomic ones; each view has a DataFrame and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

N_SAMPLES = 6
LABELS = {0: 0, 1: 0, 2: 0, 3: 1, 4: 1, 5: 1}

READS_SQL = """reads AS (
  SELECT l_suppkey % 6 AS sample_idx,
    CASE l_partkey % 16 WHEN 0 THEN 4 WHEN 1 THEN 256 WHEN 2 THEN 1024 WHEN 3 THEN 512 WHEN 4 THEN 2048 ELSE 0 END + CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END AS flag,
    'chr' || (l_suppkey % 3 + 1) AS chrom, (l_orderkey % 500) * 10 AS pos, l_partkey % 61 AS mapq, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE 1 + l_partkey % 3 END AS nh,
    4 + l_linenumber * 3 AS a, 100 + (l_partkey % 4) * 50 AS b, 5 + l_linenumber * 2 AS c, l_linenumber % 3 AS form
  FROM lineitem)"""
#: What filters and CIGARs of these reads come to, by arithmetic.
JUNCTIONS_SQL = (
    READS_SQL
    + """,
good AS (SELECT *, CASE WHEN flag % 32 >= 16 THEN '-' ELSE '+' END AS strand, pos + a + b + c AS q FROM reads WHERE flag % 16 < 4 AND flag % 512 < 256 AND flag % 1024 < 512 AND flag % 2048 < 1024),
js AS (
  SELECT *, 1 AS k, pos + a AS s, pos + a + b AS e, a AS la, c AS ra FROM good
  UNION ALL SELECT *, 2, q, q + 3, c, 8 FROM good WHERE form = 1
  UNION ALL SELECT *, 2, q, q + 60, c, 9 FROM good WHERE form = 2),
jf AS (SELECT * FROM js WHERE la >= 6 AND ra >= 6)"""
)
INTERVALS_SQL = """iv AS (SELECT 'c' || l_suppkey AS chrom, l_orderkey * 100 AS s, l_orderkey * 100 + CAST(l_quantity AS BIGINT) * 40 AS e, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand, l_linenumber FROM lineitem)"""
CELLS_SQL = """seen AS (
  SELECT p_brand AS module_id, p_type AS j, l_suppkey % 6 AS sample_idx, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
cells AS (
  SELECT k.module_id, k.j, k.i AS sample_idx, coalesce(n, 0) AS n FROM (SELECT DISTINCT module_id, j, i FROM seen, range(6) t(i)) k LEFT JOIN seen ON seen.module_id = k.module_id AND seen.j = k.j AND seen.sample_idx = k.i)"""


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reads(spark: SparkSession, sf: str) -> DataFrame:
    form = F.col("l_linenumber") % 3
    a, b, c = 4 + F.col("l_linenumber") * 3, 100 + (F.col("l_partkey") % 4) * 50, 5 + F.col("l_linenumber") * 2
    start = F.format_string("%dM%dN%dM", a.cast("int"), b.cast("int"), c.cast("int"))
    cigar = F.when(form == 0, start).when(form == 1, F.concat(start, F.lit("3D8M2I5M"))).otherwise(F.concat(F.lit("5S"), start, F.lit("60N9M")))
    kind = F.col("l_partkey") % 16
    flag = F.when(kind == 0, 4).when(kind == 1, 256).when(kind == 2, 1024).when(kind == 3, 512).when(kind == 4, 2048).otherwise(0) + F.when(F.col("l_linenumber") % 2 == 0, 16).otherwise(0)
    return table(spark, sf, "lineitem").select(
        (F.col("l_suppkey") % 6).cast("int").alias("sample_idx"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("qname"), flag.cast("int").alias("flag"), F.concat(F.lit("chr"), F.col("l_suppkey") % 3 + 1).alias("chrom"), ((F.col("l_orderkey") % 500) * 10).alias("pos"),
        (F.col("l_partkey") % 61).cast("int").alias("mapq"), cigar.alias("cigar"), F.when(F.col("l_partkey") % 5 != 0, 1 + F.col("l_partkey") % 3).cast("int").alias("nh"), F.lit(None).cast("int").alias("as_score"),
    )


#: Reads of 40 genes, each with one donor and three acceptors; in every fourth gene the second group never uses the middle one.
LOCI_SQL = """loci AS (
  SELECT l_partkey % 40 AS locus, l_suppkey % 6 AS sample_idx, (l_partkey % 40) * 5000 + 1030 AS s,
    (l_partkey % 40) * 5000 + 1230 + 100 * CASE WHEN l_partkey % 4 = 0 AND l_suppkey % 6 >= 3 AND l_linenumber % 3 = 1 THEN 0 ELSE l_linenumber % 3 END AS e
  FROM lineitem)"""


def loci(spark: SparkSession, sf: str) -> DataFrame:
    """The reads of LOCI_SQL."""
    locus, sample = F.col("l_partkey") % 40, (F.col("l_suppkey") % 6).cast("int")
    way = F.when((F.col("l_partkey") % 4 == 0) & (sample >= 3) & (F.col("l_linenumber") % 3 == 1), 0).otherwise(F.col("l_linenumber") % 3).cast("int")
    return table(spark, sf, "lineitem").select(
        sample.alias("sample_idx"), F.concat_ws(":", "l_orderkey", "l_linenumber").alias("qname"), (locus % 2 * 16).cast("int").alias("flag"), F.concat(F.lit("chr"), locus % 3 + 1).alias("chrom"), (locus * 5000 + 1000).alias("pos"),
        (20 + F.col("l_partkey") % 40).cast("int").alias("mapq"), F.format_string("30M%dN30M", 200 + 100 * way).alias("cigar"), F.lit(1).alias("nh"), F.lit(None).cast("int").alias("as_score"),
    )


def loci_genes(spark: SparkSession, sf: str) -> DataFrame:
    locus = F.col("locus")
    rows = table(spark, sf, "part").select((F.col("p_partkey") % 40).alias("locus")).distinct()
    name = F.concat(F.lit("g"), locus)
    return rows.select(name.alias("gene_id"), name.alias("gene_name"), F.concat(F.lit("chr"), locus % 3 + 1).alias("chrom"), (locus * 5000).alias("start"), (locus * 5000 + 4000).alias("end"), F.when(locus % 2 == 0, "+").otherwise("-").alias("strand"))


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    start = F.col("l_orderkey") * 100
    return table(spark, sf, "lineitem").select(F.concat(F.lit("c"), "l_suppkey").alias("chrom"), start.alias("start"), (start + F.col("l_quantity").cast("bigint") * 40).alias("end"), F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand"), "l_linenumber")


def cells(spark: SparkSession, sf: str) -> DataFrame:
    """(module_id, j, sample_idx, n): brands as modules, types as junctions, suppliers as samples, zero-filled."""
    joined = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"))
    seen = joined.groupBy(F.col("p_brand").alias("module_id"), F.col("p_type").alias("j"), (F.col("l_suppkey") % 6).cast("int").alias("sample_idx")).agg(F.count("*").alias("n"))
    every = seen.select("module_id", "j").distinct().withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(N_SAMPLES - 1))))
    return every.join(seen, ["module_id", "j", "sample_idx"], "left").fillna(0, ["n"])


def evidence(spark: SparkSession, sf: str) -> DataFrame:
    """The cells as module evidence; junctions are numbered by type."""
    types = table(spark, sf, "part").select(F.col("p_type").alias("j")).distinct()
    numbered = types.select("j", (F.rank().over(_by("j")) - 1).cast("int").alias("j_idx"))
    rows = cells(spark, sf).join(F.broadcast(numbered), "j")
    return rows.select(
        "module_id", "j_idx", "sample_idx", F.lit("chr1").alias("chrom"), (F.col("j_idx").cast("bigint") * 1000).alias("start"), (F.col("j_idx").cast("bigint") * 1000 + 500).alias("end"), F.lit("+").alias("strand"), F.col("n").alias("count"), F.col("n").cast("double").alias("weighted"), (10.0 + F.col("n") % 50).alias("mapq"), F.lit(100.0).alias("eff_len"),
        (F.col("n") / 100.0).alias("norm"), (0.2 + F.col("j_idx") % 4 * 0.25).alias("composite_score"), (F.col("j_idx") % 3 != 0).alias("is_annotated"),
    )


def _by(column: str):
    from pyspark.sql import Window

    return Window.orderBy(column)


EVIDENCE_SQL = (
    CELLS_SQL
    + """,
types AS (SELECT p_type AS j, rank() OVER (ORDER BY p_type) - 1 AS j_idx FROM (SELECT DISTINCT p_type FROM part)),
ev AS (
  SELECT module_id, j_idx, sample_idx, n AS count, n::DOUBLE AS weighted, 10.0::DOUBLE + n % 50 AS mapq, 100.0::DOUBLE AS eff_len, n / 100.0::DOUBLE AS norm, 0.2::DOUBLE + j_idx % 4 * 0.25::DOUBLE AS composite_score, j_idx % 3 <> 0 AS is_annotated,
    CASE WHEN sample_idx < 3 THEN 0 ELSE 1 END AS label
  FROM cells JOIN types USING (j)),
psi AS (SELECT *, CASE WHEN sum(norm) OVER w > 0 THEN norm / sum(norm) OVER w ELSE 0 END AS psi FROM ev WINDOW w AS (PARTITION BY module_id, sample_idx))"""
)
