"""Aligned reads: blocks, junctions, anchors, filters and the fused junction counts.

A reads table has one row a record: sample_idx, flag, chrom, pos (0-based), mapq, cigar, nh and
as_score.  CIGARs are parsed a batch at a time on Arrow data (functions.cigar); filters before
and counts after that are built-in expressions, with one partial and final aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import cigar as C

#: SAM flag bits: unmapped, secondary, failed quality control, duplicate.
EXCLUDED_FLAGS = 0x4 | 0x100 | 0x200 | 0x400
UNMAPPED, REVERSE, PROPER_PAIR = 0x4, 0x10, 0x2
READS = "sample_idx int, qname string, flag int, chrom string, pos bigint, mapq int, cigar string, nh int, as_score int"
JUNCTION = ["chrom", "start", "end", "strand"]


def passes_filters(flag: str = "flag") -> Column:
    """Neither unmapped nor secondary, duplicate or failed; supplementary records pass."""
    return F.col(flag).bitwiseAND(F.lit(EXCLUDED_FLAGS)) == 0


def nh(column: str = "nh") -> Column:
    return F.coalesce(F.col(column), F.lit(1))


def strand(flag: str = "flag") -> Column:
    return F.when(F.col(flag).bitwiseAND(F.lit(REVERSE)) != 0, "-").otherwise("+")


def aligned_blocks(cigar: str = "cigar", pos: str = "pos") -> Column:
    """array<struct<start,end>>: M, = and X make blocks, D and N move on, the rest is ignored."""
    return F.expr(f"""
        aggregate(
          regexp_extract_all({cigar}, '([0-9]+)([MIDNSHP=X])', 0),
          named_struct('p', cast({pos} as bigint), 'b', cast(array() as array<struct<start:bigint,end:bigint>>)),
          (acc, op) -> named_struct(
            'p', acc.p + if(right(op, 1) in ('M', '=', 'X', 'D', 'N'), cast(left(op, length(op) - 1) as bigint), 0L),
            'b', if(right(op, 1) in ('M', '=', 'X'),
                    concat(acc.b, array(named_struct('start', acc.p, 'end', acc.p + cast(left(op, length(op) - 1) as bigint)))), acc.b)),
          acc -> acc.b)""")


def block_junctions(blocks: str = "blocks", min_anchor: int = 6) -> Column:
    """array<struct<start,end,left_anchor,right_anchor>>: gaps between blocks with both anchors long enough."""
    return F.expr(f"""
        filter(
          transform(if(size({blocks}) > 1, sequence(1, size({blocks}) - 1), cast(array() as array<int>)),
            i -> named_struct('start', {blocks}[i - 1].end, 'end', {blocks}[i].start,
                              'left_anchor', {blocks}[i - 1].end - {blocks}[i - 1].start,
                              'right_anchor', {blocks}[i].end - {blocks}[i].start)),
          j -> j.end > j.start and j.left_anchor >= {int(min_anchor)} and j.right_anchor >= {int(min_anchor)})""")


def only_skips(cigar: str = "cigar") -> Column:
    """Deletions turned to matches, so that only N parts blocks."""
    return F.regexp_replace(F.col(cigar), r"([0-9]+)D", "$1M")


def with_evidence(reads: DataFrame, min_anchor: int = 6, n_only: bool = False) -> DataFrame:
    """Reads that pass the flag filter, with blocks, junctions, all pairs of junctions and strand."""
    cigar = only_skips() if n_only else F.col("cigar")
    found = reads.filter(passes_filters()).withColumn("__cigar", cigar)
    found = found.withColumn("blocks", aligned_blocks("__cigar")).withColumn("junctions", block_junctions("blocks", min_anchor)).withColumn("strand", strand())
    pairs = F.expr("""
        flatten(transform(junctions, (a, i) -> transform(slice(junctions, i + 2, size(junctions)),
          b -> named_struct('start1', least(struct(a.start, a.end), struct(b.start, b.end)).start, 'end1', least(struct(a.start, a.end), struct(b.start, b.end)).end,
                            'start2', greatest(struct(a.start, a.end), struct(b.start, b.end)).start, 'end2', greatest(struct(a.start, a.end), struct(b.start, b.end)).end))))""")
    return found.withColumns({"pairs": pairs, "nh": nh(), "is_proper_pair": F.col("flag").bitwiseAND(F.lit(PROPER_PAIR)) != 0}).drop("__cigar")


def read_junctions(reads: DataFrame, min_anchor: int = 6, min_mapq: int = 0, n_only: bool = False) -> DataFrame:
    """A row for each junction of each read that passes: place, strand, sample, mapq, NH and the longer anchor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, anchor = C.junctions(*C.blocks(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), n_only), min_anchor)
            kept = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(end), pa.array(anchor), *(batch.column(i).take(kept) for i in range(2, 7))], names=["start", "end", "anchor", "chrom", "strand", "sample_idx", "mapq", "nh"])

    rows = reads.filter(passes_filters() & (F.col("mapq") >= min_mapq)).select("cigar", "pos", "chrom", strand().alias("strand"), "sample_idx", "mapq", nh().alias("nh"))
    return rows.mapInArrow(run, "start bigint, end bigint, anchor bigint, chrom string, strand string, sample_idx int, mapq int, nh int")


def junction_counts(reads: DataFrame, min_anchor: int = 6, min_mapq: int = 0, n_only: bool = False) -> DataFrame:
    """A row for each junction and sample: counts, sums of mapq, its square and NH, and the longest anchor."""
    return read_junctions(reads, min_anchor, min_mapq, n_only).groupBy(*JUNCTION, "sample_idx").agg(
        F.count("*").alias("counts"),
        F.sum(F.col("mapq").cast("double")).alias("mapq_sum"),
        F.sum((F.col("mapq") * F.col("mapq")).cast("double")).alias("mapq_sq_sum"),
        F.sum(F.col("nh").cast("double")).alias("nh_sum"),
        F.count("*").alias("n"),
        F.max("anchor").alias("max_anchor"),
    )


def _junction_number(min_anchor: int):
    @F.arrow_udf("int")
    def number(cigars: pa.Array) -> pa.Array:
        row = C.junctions(*C.blocks(cigars, np.zeros(len(cigars), np.int64)), min_anchor)[0]
        return pa.array(np.bincount(row, minlength=len(cigars)).astype(np.int32))

    return number


def read_stats(reads: DataFrame, min_anchor: int = 6, min_mapq: int = 0) -> DataFrame:
    """A row for each sample: total, mapped, junction and multi-mapped reads, mean and median mapq of mapped ones."""
    mapped = F.col("flag").bitwiseAND(F.lit(UNMAPPED)) == 0
    junctioned = F.coalesce(passes_filters() & (F.col("mapq") >= min_mapq) & (F.col("__k") > 0), F.lit(False))
    return (
        reads.select("sample_idx", "flag", "mapq", "nh", _junction_number(min_anchor)("cigar").alias("__k"))
        .groupBy("sample_idx")
        .agg(
            F.count("*").alias("total_reads"),
            F.count_if(mapped).alias("mapped_reads"),
            F.count_if(junctioned).alias("junction_reads"),
            F.count_if(junctioned & (nh() > 1)).alias("multi_mapped_reads"),
            F.coalesce(F.avg(F.when(mapped, F.col("mapq"))), F.lit(0.0)).alias("mean_mapq"),
            F.coalesce(F.median(F.when(mapped, F.col("mapq"))), F.lit(0.0)).alias("median_mapq"),
        )
    )


def pair_counts(reads: DataFrame, min_anchor: int = 6, min_mapq: int = 0) -> DataFrame:
    """How many reads of a sample hold two junctions; of a pair the smaller junction is first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, start, end, _ = C.junctions(*C.blocks(batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)), min_anchor)
            i, j = C.pairs(row)
            kept = pa.array(row[i])
            yield pa.RecordBatch.from_arrays([*(pa.array(x) for x in (start[i], end[i], start[j], end[j])), *(batch.column(c).take(kept) for c in range(2, 5))], names=["start1", "end1", "start2", "end2", "chrom", "strand", "sample_idx"])

    rows = reads.filter(passes_filters() & (F.col("mapq") >= min_mapq)).select("cigar", "pos", "chrom", strand().alias("strand"), "sample_idx")
    found = rows.mapInArrow(run, "start1 bigint, end1 bigint, start2 bigint, end2 bigint, chrom string, strand string, sample_idx int")
    return found.groupBy("chrom", "strand", "start1", "end1", "start2", "end2", "sample_idx").agg(F.count("*").alias("n"))


@F.arrow_udf(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
def aligned_span(cigars: pa.Array, pos: pa.Array) -> pa.Array:
    """First and last aligned base (half-open) of each read; null without blocks."""
    row, start, end = C.blocks(cigars, pos.to_numpy(zero_copy_only=False))
    first, last = np.full(len(cigars), -1, np.int64), np.full(len(cigars), -1, np.int64)
    first[row[::-1]], last[row] = start[::-1], end
    none = last < 0
    return pa.StructArray.from_arrays([pa.array(first, mask=none), pa.array(last, mask=none)], names=["first", "last"])


def coverage(reads: DataFrame, chrom: str, start: int, end: int) -> DataFrame:
    """(sample_idx, pos, depth) for each covered position of a region, over whole read spans.

    Depth is a running sum of +1 at starts and -1 at ends; positions follow by filling between.
    """
    from pyspark.sql import Window

    spans = reads.filter((F.col("chrom") == chrom) & passes_filters() & (F.col("pos") < end)).select("sample_idx", "pos", aligned_span("cigar", "pos")["last"].alias("last")).filter("last is not null")
    spans = spans.select("sample_idx", F.greatest(F.col("pos"), F.lit(start)).alias("s"), F.least("last", F.lit(end)).alias("e")).filter("s < e")
    steps = spans.select("sample_idx", F.explode(F.array(F.struct(F.col("s").alias("pos"), F.lit(1).alias("d")), F.struct(F.col("e").alias("pos"), F.lit(-1).alias("d")))).alias("x"))
    steps = steps.groupBy("sample_idx", F.col("x.pos").alias("pos")).agg(F.sum("x.d").alias("d"))
    w = Window.partitionBy("sample_idx").orderBy("pos")
    runs = steps.select("sample_idx", "pos", F.sum("d").over(w).alias("depth"), F.lead("pos").over(w).alias("until")).filter("depth > 0")
    return runs.select("sample_idx", F.explode(F.expr("sequence(pos, until - 1)")).alias("pos"), "depth")


def region_junctions(reads: DataFrame, chrom: str, start: int, end: int, min_anchor: int = 6) -> DataFrame:
    """(sample_idx, start, end, n) of junctions that touch a region, bounds included."""
    found = read_junctions(reads.filter(F.col("chrom") == chrom), min_anchor)
    return found.filter((F.col("end") >= start) & (F.col("start") <= end)).groupBy("sample_idx", "start", "end").agg(F.count("*").alias("n"))


def exon_body_reads(reads: DataFrame, exons: DataFrame, min_mapq: int = 0) -> DataFrame:
    """Reads all of whose blocks lie within an exon: raw count and sum of 1/NH for (exon_id, sample_idx).

    Reads of one place and CIGAR are counted first, and exons of (exon_id, chrom, start, end) meet
    them once for each distinct place, in bins whose width is the power of two that holds the exon.
    A read is in one bin of each width that there is and that is no shorter than itself.
    """
    passed = reads.filter(passes_filters() & (F.col("mapq") >= min_mapq)).groupBy("sample_idx", "chrom", "pos", "cigar").agg(F.count("*").alias("n"), F.sum(1 / nh()).alias("weighted"))
    found = passed.select("sample_idx", "chrom", aligned_span("cigar", "pos").alias("a"), "n", "weighted").filter("a.last is not null")
    places = exons.select("chrom", F.col("start").alias("x_start"), F.col("end").alias("x_end")).filter("x_start < x_end").distinct()
    places = places.withColumn("width", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("x_end") - F.col("x_start")))).cast("bigint"))
    widths = places.agg(F.collect_set("width").alias("widths"))  # one row of at most 63 numbers
    bins = places.select("*", F.explode(F.sequence(F.floor(F.col("x_start") / F.col("width")), F.floor((F.col("x_end") - 1) / F.col("width")))).alias("bin"))
    spread = found.crossJoin(F.broadcast(widths)).select("sample_idx", "chrom", "a", "n", "weighted", F.explode("widths").alias("width")).filter("a.last - a.first <= width").withColumn("bin", F.floor(F.col("a.first") / F.col("width")))
    inside = spread.join(bins, ["chrom", "width", "bin"]).filter("a.first >= x_start and a.last <= x_end")
    totals = inside.groupBy("chrom", "x_start", "x_end", "sample_idx").agg(F.sum("n").alias("n"), F.sum("weighted").alias("weighted"))
    named = exons.select("exon_id", "chrom", F.col("start").alias("x_start"), F.col("end").alias("x_end"))
    return totals.join(named, ["chrom", "x_start", "x_end"]).groupBy("exon_id", "sample_idx").agg(F.sum("n").alias("n"), F.sum("weighted").alias("weighted"))
