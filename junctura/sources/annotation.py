"""Gene models from GTF text and genome sequence from FASTA text."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sequence import TILE, genome_tiles
from .fasta import fasta_tiles

ATTRIBUTES = ("gene_id", "gene_name", "transcript_id", "gene_type", "gene_biotype")
_PAIR = re.compile(r"(\S+)(?:\s+([^\n\r]*))?", re.ASCII)


@F.arrow_udf(T.StructType([T.StructField(k, T.StringType()) for k in ATTRIBUTES]))
def _attributes(texts: pa.Array) -> pa.Array:
    """The attributes that are used of `key "value";` texts; as functions.sequence.attributes gives them."""
    columns = {k: [] for k in ATTRIBUTES}
    for text in texts.to_pylist():
        found = {}
        for part in (text or "").split(";"):
            m = _PAIR.match(part.strip(" "))
            if m:
                found[m[1]] = m[2] or ""
        for k, out in columns.items():
            v = found.get(k)
            out.append(v if v is None else v[v.startswith('"') : len(v) - (len(v) > 1 and v.endswith('"')) if v != '"' else 1])
    return pa.StructArray.from_arrays([pa.array(v, pa.string()) for v in columns.values()], names=list(columns))


def gtf_rows(lines: DataFrame) -> DataFrame:
    """Fields of GTF lines, with 0-based half-open bounds and attributes, which are taken once for a batch."""
    f = F.split("value", "\t")
    rows = lines.filter(~F.col("value").startswith("#") & (F.size(f) >= 9)).select(f.alias("f"), _attributes.asNondeterministic()(F.split_part("value", F.lit("\t"), F.lit(9))).alias("a"))
    get, field = lambda k: F.col(f"a.{k}"), lambda k: F.col("f")[k]
    rows = rows.select(field(0).alias("chrom"), field(2).alias("feature"), (field(3).cast("bigint") - 1).alias("start"), field(4).cast("bigint").alias("end"), field(6).alias("strand"), "a")
    kind = F.coalesce(get("gene_type"), get("gene_biotype"))
    return rows.select("chrom", "feature", "start", "end", "strand", get("gene_id").alias("gene_id"), F.coalesce(get("gene_name"), get("gene_id")).alias("gene_name"), get("transcript_id").alias("transcript_id"), kind.alias("gene_type"))


def gene_models(rows: DataFrame, gene_type: str | None = "protein_coding", feature: str = "exon") -> tuple[DataFrame, DataFrame]:
    """(genes, exons) of GTF rows.

    With a gene_type, gene rows must have it, and exon rows must not have another: an exon row
    without type makes a gene.  A gene's bounds are its exons'; without exons, its own row's.
    """
    known = F.coalesce("gene_type", F.lit("")) != ""
    wanted = F.lit(True) if gene_type is None else (F.col("gene_type") == gene_type)
    lax = F.lit(True) if gene_type is None else (~known | (F.col("gene_type") == gene_type))
    named = rows.filter(F.coalesce("gene_id", F.lit("")) != "")
    is_exon = F.coalesce((F.col("feature") == feature) & lax & (F.coalesce("transcript_id", F.lit("")) != ""), F.lit(False))
    is_gene = F.coalesce((F.col("feature") == "gene") & wanted & (known if gene_type is not None else F.lit(True)), F.lit(False))
    exons = named.filter(is_exon).select("gene_id", "gene_name", "transcript_id", "chrom", "strand", "start", "end")
    # rows are read once, and bounds are joined by numbers alone before one row of a gene gives its name and place
    both = named.withColumn("x", F.when(is_exon, 1).when(is_gene, 0)).filter("x is not null")
    bounds = both.groupBy("gene_id", "gene_name", "chrom", "strand", "x").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    inner = lambda f, c: F.coalesce(f(F.when(F.col("x") == 1, F.col(c))), f(c))
    genes = bounds.groupBy("gene_id").agg(F.min_by("gene_name", "x").alias("gene_name"), F.min_by("chrom", "x").alias("chrom"), F.min_by("strand", "x").alias("strand"), inner(F.min, "start").alias("start"), inner(F.max, "end").alias("end"))
    return genes, exons.select("gene_id", "transcript_id", "chrom", "strand", "start", "end")


def read_gtf(spark: SparkSession, path: str, gene_type: str | None = "protein_coding") -> tuple[DataFrame, DataFrame]:
    return gene_models(gtf_rows(spark.read.text(path)), gene_type)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, seq) of FASTA text: a contig is a record of the reader, cut at ">"."""
    records = spark.read.option("lineSep", ">").text(path).filter(F.trim("value") != "")
    name = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*", ""), r"\s", "")
    return records.select(name.alias("chrom"), body.alias("seq"))


def read_genome(spark: SparkSession, path: str, chromosomes: list[str] | None = None, tile: int = TILE) -> DataFrame:
    """Tiles of a FASTA file, read by byte ranges; one whose lines differ in length is read a contig a record."""
    tiles = fasta_tiles(spark, path, tile)
    if tiles is None:
        tiles = genome_tiles(read_fasta(spark, path), tile)
    return tiles if chromosomes is None else tiles.filter(F.col("chrom").isin(chromosomes))


def gene_exons(exons: DataFrame) -> DataFrame:
    """Distinct exons of a gene in order, for drawing."""
    w = Window.partitionBy("gene_id").orderBy("start", "end")
    return exons.select("gene_id", "chrom", "strand", "start", "end").distinct().withColumn("ord", F.row_number().over(w) - 1)


def find_gene(wanted: DataFrame, genes: DataFrame) -> DataFrame:
    """Genes by exact name, else by name without version."""
    exact = genes.select(F.col("gene_id").alias("wanted_id"), F.struct(*genes.columns).alias("exact"))
    bare = lambda c: F.element_at(F.split(c, r"\."), 1)
    loose = genes.groupBy(bare(F.col("gene_id")).alias("bare")).agg(F.min_by(F.struct(*genes.columns), "gene_id").alias("loose"))
    joined = wanted.withColumn("bare", bare(F.col("wanted_id"))).join(exact, "wanted_id", "left").join(loose, "bare", "left")
    return joined.withColumn("gene", F.coalesce("exact", "loose")).drop("exact", "loose", "bare")
