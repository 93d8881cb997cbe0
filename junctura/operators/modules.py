"""Modules: clusters meet genes, merge within a gene, and get evidence per sample."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .intervals import merge_intervals, overlap_join
from .junctions import KEY


def build_modules(clusters: DataFrame, members: DataFrame, genes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(modules, module junctions) of clusters and the genes they overlap on one strand.

    A cluster that overlaps two genes gives two modules; clusters of a gene that overlap merge,
    touching ones stay apart.  Clusters without a gene become intergenic modules only where no
    gene overlaps any cluster of their chromosome and strand; else they drop out.  Modules are
    named by gene, place and strand, and junctions numbered by position.
    """
    columns = [*KEY, "cluster_id"]
    slim = clusters.select(*columns)
    genic = overlap_join(slim, genes.select("gene_id", "gene_name", "chrom", "start", "end", "strand"))
    genic = genic.select(*columns, F.col("r_gene_id").alias("gene_id"), F.col("r_gene_name").alias("gene_name"))
    regions = genic.select("chrom", "strand").distinct()
    lone = slim.join(regions, ["chrom", "strand"], "left_anti").withColumns({"gene_id": F.lit(""), "gene_name": F.lit("")})
    keys = ("gene_id", "gene_name", "chrom", "strand")
    ids = F.collect_list("cluster_id").alias("cluster_ids")
    merged = merge_intervals(genic, keys, touching=False, carry=[ids], bin_width=None).select(*keys, "cluster_ids")
    alone = lone.select(*keys, F.array("cluster_id").alias("cluster_ids"))
    first = merged.unionByName(alone).withColumn("lead", F.array_min("cluster_ids"))
    held = first.withColumn("cluster_id", F.explode(F.array_distinct("cluster_ids"))).drop("cluster_ids")
    junction = members.select("cluster_id", "start", "end").distinct()
    # a junction is in one cluster, so bounds and numbers of modules are those of their clusters, without their junctions
    sizes = junction.groupBy("cluster_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n"))
    w = Window.partitionBy(*keys, "lead")
    name = F.concat_ws(":", F.when(F.col("gene_id") == "", "intergenic").otherwise(F.col("gene_id")), "chrom", "strand", F.format_string("%d-%d", F.min("start").over(w), F.max("end").over(w)))
    named = held.join(sizes, "cluster_id").withColumn("module_id", name)
    modules = named.groupBy("module_id", "gene_id", "gene_name", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("n").alias("n_connections"))
    joined = named.select("module_id", "cluster_id", *keys, "lead").join(junction, "cluster_id")
    junctions = joined.withColumn("j_idx", F.row_number().over(w.orderBy("start", "end")) - 1).select("module_id", "j_idx", *KEY, "gene_id", "gene_name")
    return modules.withColumn("is_binary", F.col("n_connections") == 2), junctions


def effective_length(read_length: int = 101, anchor: int = 1) -> float:
    return max(1.0, read_length - 2 * anchor + 1)


def exon_aware_length(junctions: DataFrame, exons: DataFrame, read_length: int = 101, anchor: int = 1) -> DataFrame:
    """Adds eff_len: shortened where the flanking exons are short; of several exons the last holds.

    `exons` has chrom, start, end and ord, its place in the gene's list.
    """
    room = read_length - anchor
    before = exons.groupBy("chrom", F.col("end").alias("start")).agg(F.max_by(F.col("end") - F.col("start"), "ord").alias("donor_len"))
    after = exons.groupBy("chrom", F.col("start").alias("end")).agg(F.max_by(F.col("end") - F.col("start"), "ord").alias("acceptor_len"))
    both = F.greatest(F.lit(1.0), F.least("donor_len", F.lit(room)) + F.least("acceptor_len", F.lit(room)) - read_length + 1)
    joined = junctions.join(before, ["chrom", "start"], "left").join(after, ["chrom", "end"], "left")
    return joined.withColumn("eff_len", F.when(F.col("donor_len").isNotNull() & F.col("acceptor_len").isNotNull(), both).otherwise(F.lit(effective_length(read_length, anchor)))).drop("donor_len", "acceptor_len")


def skipped_exon_lengths(exon_length: Column, read_length: int, anchor: int = 1) -> tuple[Column, Column]:
    """Inclusion (with the exon's body) and skipping length."""
    span = F.lit(read_length - 2 * anchor + 1)
    return span + F.least(exon_length, span) + F.greatest(F.lit(0), exon_length - read_length + 1), span


def exon_body_length(exon_length: Column, read_length: int) -> Column:
    return F.greatest(F.lit(0), exon_length - read_length + 1)


def normalised(counts: Column, length: Column) -> Column:
    return F.when(length > 0, counts / length).otherwise(0.0)


def evidence(junctions: DataFrame, counts: DataFrame, n_samples: int, confidence: DataFrame | None = None, read_length: int = 101, lengths: DataFrame | None = None) -> DataFrame:
    """Long evidence (module_id, j_idx, sample_idx, count, weighted, mapq, eff_len, norm, composite_score, is_annotated).

    `counts` has per-sample columns of junctions.per_sample; what a sample lacks is zero.
    `confidence` gives composite_score and is_annotated by junction, `lengths` eff_len by
    (module_id, j_idx).
    """
    samples = F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample_idx")
    cells = junctions.select("module_id", "j_idx", *KEY, samples)
    seen = counts.select(*KEY, "sample_idx", "counts", "weighted", "mapq_mean")
    cells = cells.join(seen, [*KEY, "sample_idx"], "left")
    if confidence is None:
        cells = cells.withColumns({"composite_score": F.lit(0.0), "is_annotated": F.lit(False)})
    else:
        cells = cells.join(confidence.select(*KEY, "composite_score", "is_annotated"), KEY, "left")
    if lengths is None:
        cells = cells.withColumn("eff_len", F.lit(effective_length(read_length)))
    else:
        cells = cells.join(lengths.select("module_id", "j_idx", "eff_len"), ["module_id", "j_idx"])
    count = F.coalesce("counts", F.lit(0)).cast("bigint")
    return cells.select(
        "module_id", "j_idx", "sample_idx", *KEY, count.alias("count"), F.coalesce("weighted", F.lit(0.0)).alias("weighted"), F.coalesce("mapq_mean", F.lit(0.0)).alias("mapq"), "eff_len", normalised(count, F.col("eff_len")).alias("norm"), F.coalesce("composite_score", F.lit(0.0)).alias("composite_score"), F.coalesce("is_annotated", F.lit(False)).alias("is_annotated")
    )


def module_totals(cells: DataFrame) -> DataFrame:
    """(module_id, sample_idx, total, total_weighted)."""
    return cells.groupBy("module_id", "sample_idx").agg(F.sum("count").alias("total"), F.sum("weighted").alias("total_weighted"))


def with_depth(cells: DataFrame, min_reads: int = 20, min_samples: int = 3) -> DataFrame:
    """Cells of modules with enough reads in all and enough samples with any."""
    deep = module_totals(cells).groupBy("module_id").agg(F.sum("total").alias("t"), F.count_if(F.col("total") >= 1).alias("s")).filter((F.col("t") >= min_reads) & (F.col("s") >= min_samples))
    return cells.join(deep.select("module_id"), "module_id", "left_semi")


def with_size(modules: DataFrame, least: int = 2) -> DataFrame:
    return modules.filter(F.col("n_connections") >= least)


def of_gene(modules: DataFrame, gene_id: str) -> DataFrame:
    return modules.filter(F.col("gene_id") == gene_id)


def testable(cells: DataFrame, groups: DataFrame, min_reads: int = 10, min_samples: int = 3) -> DataFrame:
    """Modules in which every group has enough reads and samples; `groups` is (sample_idx, label)."""
    totals = module_totals(cells).join(F.broadcast(groups), "sample_idx")
    each = totals.groupBy("module_id", "label").agg(F.sum("total").alias("t"), F.count_if(F.col("total") > 0).alias("s"))
    return each.groupBy("module_id").agg(F.bool_and((F.col("t") >= min_reads) & (F.col("s") >= min_samples)).alias("ok")).filter("ok").select("module_id")


def size_factors(counts: DataFrame) -> DataFrame:
    """(sample_idx, size_factor): totals over their median, with geometric mean 1; all 1 where the median is 0."""
    sums = counts.groupBy("sample_idx").agg(F.sum("count").cast("double").alias("total"))
    middle = sums.agg(F.median("total").alias("mid"))
    raw = sums.crossJoin(F.broadcast(middle)).withColumn("f", F.when((F.col("total") > 0) & (F.col("mid") > 0), F.col("total") / F.col("mid")).otherwise(1.0))
    mean = raw.agg(F.exp(F.avg(F.ln("f"))).alias("g"))
    return raw.crossJoin(F.broadcast(mean)).select("sample_idx", F.when(F.col("mid") == 0, 1.0).otherwise(F.col("f") / F.col("g")).alias("size_factor"))
