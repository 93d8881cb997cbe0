"""Coding consequence of a junction: does its transcript stop too early?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequence import TILE, genome_slices, reverse_complement, stop_codon
from ..stages import written

NMD_DISTANCE = 55

#: Transcripts and junctions of a gene meet by OWN; a junction is named by KEYS.
OWN = ["gene_id", "chrom", "strand"]
KEYS = ["chrom", "start", "end", "strand", "gene_id"]


def transcripts(exons: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, chrom, strand, exons): exons as a sorted array."""
    return exons.groupBy("gene_id", "transcript_id", "chrom", "strand").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("exons"))


def ejc_positions(exons: DataFrame) -> DataFrame:
    """Places of exon junctions in the spliced sequence: running exon lengths, the last left out."""
    w, size = Window.partitionBy("gene_id", "transcript_id"), F.col("end") - F.col("start")
    running = F.sum(size).over(w.orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0))
    return exons.select("gene_id", "transcript_id", running.alias("ejc"), F.sum(size).over(w).alias("whole")).filter("ejc < whole").drop("whole")


def site_matches(junctions: DataFrame, sites: DataFrame) -> DataFrame:
    """The first intron of each transcript that shares donor or acceptor: two equi joins, no OR."""
    slim = sites.select("gene_id", "transcript_id", "i", "donor", "acceptor")
    by_donor = junctions.join(slim.withColumnRenamed("donor", "start"), ["gene_id", "start"]).select("gene_id", "start", "end", "transcript_id", "i")
    by_acceptor = junctions.join(slim.withColumnRenamed("acceptor", "end"), ["gene_id", "end"]).select("gene_id", "start", "end", "transcript_id", "i")
    return by_donor.unionByName(by_acceptor).groupBy("gene_id", "start", "end", "transcript_id").agg(F.min("i").alias("first_match"))


def introns(models: DataFrame) -> DataFrame:
    """(gene_id, transcript_id, chrom, strand, start, end): the gaps between a transcript's exons."""
    gaps = F.expr("transform(slice(exons, 2, size(exons)), (x, i) -> struct(exons[i].end as start, x.start as end))")
    return models.select("gene_id", "transcript_id", "chrom", "strand", F.explode(gaps).alias("x")).select("gene_id", "transcript_id", "chrom", "strand", "x.*").filter("start < end")


def substituted(junctions: DataFrame, models: DataFrame) -> DataFrame:
    """Each junction in each transcript of its gene, chromosome and strand with which it shares a site, and what it changes there.

    Junctions meet a gene's transcripts, not their introns one by one; the first intron that shares
    donor or acceptor is changed: at most one exon, `k`, which becomes [new_start, new_end).  k is
    null where nothing changes; what would turn an exon inside out drops out.  Further columns of
    `models` stay.
    """
    rest = [c for c in models.columns if c not in OWN]
    sites = models.withColumns({"__donors": F.expr("slice(exons.end, 1, greatest(size(exons) - 1, 0))"), "__acceptors": F.expr("slice(exons.start, 2, size(exons))")})
    met = junctions.select(*KEYS).join(sites, OWN)
    # numbers of the first introns, from 1, that have the donor and the acceptor; 0 where none has
    at = {"__d": F.coalesce(F.array_position("__donors", F.col("start")), F.lit(0)).cast("int"), "__a": F.coalesce(F.array_position("__acceptors", F.col("end")), F.lit(0)).cast("int")}
    met = met.withColumns(at).filter("__d > 0 or __a > 0")
    by_donor = F.expr("__d > 0 and (__a = 0 or __d <= __a)")
    changed = met.select(
        *KEYS, *rest,
        F.expr("case when __d = __a then null when __d > 0 and (__a = 0 or __d < __a) then __d else __a - 1 end").alias("k"),
        F.when(by_donor, F.col("end")).otherwise(F.expr("get(exons, __a - 1).start")).alias("new_start"),
        F.when(by_donor, F.expr("get(exons, __d).end")).otherwise(F.col("start")).alias("new_end"),
    )
    return changed.filter("k is null or new_start < new_end")


def exon_bases(models: DataFrame, tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """`models` with `pieces`, the starts, bases and sizes of their exons in order, bases null where the genome has none; a distinct exon is cut once.

    Cut exons are written, so that few of them are broadcast and a gene's transcripts stay where they are dealt.
    """
    of = [*OWN, "transcript_id"]
    place = F.posexplode("exons").alias("n", "x")
    distinct = models.select("chrom", F.explode("exons").alias("x")).select("chrom", F.col("x.start").alias("bases_start"), F.col("x.end").alias("bases_end")).distinct()
    cut = written(genome_slices(distinct, tiles, "bases", tile), "exon-bases")
    each = models.repartition(*OWN).select(*of, place).select(*of, "n", F.col("x.start").alias("bases_start"), F.col("x.end").alias("bases_end"))
    found = each.join(cut, ["chrom", "bases_start", "bases_end"], "left")
    rows = found.groupBy(*of).agg(F.sort_array(F.collect_list(F.struct("n", F.col("bases_start").alias("start"), F.col("bases_end").alias("end"), "bases"))).alias("x"))
    exons = F.transform("x", lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end")))
    return rows.select(*of, exons.alias("exons"), F.transform("x", lambda e: F.struct(e["start"].alias("start"), e["bases"].alias("bases"), (e["end"] - e["start"]).alias("size"))).alias("pieces"))


def classify_nmd(junctions: DataFrame, models: DataFrame, tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """A row for each junction of (chrom, start, end, strand, gene_id): PR, UP or NE with paths and places.

    The reading frame is the first ATG of the spliced sequence; a stop more than NMD_DISTANCE
    bases before the last exon junction is premature.  Without stop or exon junction a path is
    productive; transcripts without sequence or ATG do not count.  A transcript's bases are put
    together once; a junction in it changes one exon at most, whose bases alone are cut anew.
    Junctions and transcripts are dealt by gene, first without bases to tell the exons to cut,
    which are written, then with bases; so what is dealt grows with them and not with their pairs.
    """
    keys = KEYS
    named = junctions.select(*keys).repartition(*OWN).distinct()
    known = models.filter("forall(exons, x -> x.start < x.end)")
    places = substituted(named, known).filter("k is not null").select("chrom", "new_start", "new_end").distinct()
    cut = written(genome_slices(places, tiles, "new", tile), "changed-exons")
    both = substituted(named, exon_bases(known, tiles, tile)).drop("exons").join(cut, ["chrom", "new_start", "new_end"], "left")
    own = F.expr("if(k is null, pieces, transform(pieces, (x, n) -> if(n = k, named_struct('start', new_start, 'bases', new, 'size', new_end - new_start), x)))")
    spliced = both.select(*keys, "transcript_id", F.sort_array(own).alias("ps")).filter("forall(ps, p -> coalesce(p.bases, '') <> '')")
    mrna = F.array_join(F.transform("ps", lambda p: p["bases"]), "")
    length = F.aggregate("ps", F.lit(0).cast("bigint"), lambda total, p: total + p["size"])
    spliced = spliced.select(*keys, "transcript_id", F.when(F.col("strand") == "-", reverse_complement(mrna)).otherwise(mrna).alias("mrna"), F.when(F.size("ps") > 1, length - F.element_at("ps", -1)["size"]).alias("last_ejc")).filter(F.length("mrna") >= 3)
    spliced = spliced.withColumn("atg", F.instr("mrna", "ATG") - 1).filter("atg >= 0")
    spliced = spliced.withColumn("stop", stop_codon(F.col("mrna"), F.col("atg")))
    early = F.coalesce(F.col("last_ejc") - F.col("stop") > NMD_DISTANCE, F.lit(False))
    counted = spliced.groupBy(*keys).agg(
        F.count_if(~early).alias("n_productive_paths"),
        F.count_if(early).alias("n_unproductive_paths"),
        F.min(F.when(early, F.col("stop"))).alias("ptc_position"),
        F.max_by("last_ejc", F.when(F.col("stop").isNotNull() & F.col("last_ejc").isNotNull(), F.col("transcript_id"))).alias("last_ejc_position"),
    )
    out = named.join(counted, keys, "left").fillna(0, ["n_productive_paths", "n_unproductive_paths"])
    total = F.col("n_productive_paths") + F.col("n_unproductive_paths")
    label = F.when(total == 0, "NE").when(F.col("n_productive_paths") > 0, "PR").otherwise("UP")
    return out.withColumns({"classification": label, "confidence": F.when(total == 0, F.lit(float("nan"))).otherwise(F.col("n_productive_paths") / total)})


def frame_graph(exons: DataFrame, junctions: DataFrame) -> DataFrame:
    """Edges (exon, frame) -> (exon, frame) over observed junctions; the frame moves by the intron's length modulo 3.

    A graph a gene: `exons` has gene_id, chrom, strand, start and end, `junctions` chrom, strand,
    start and end.  An exon ends where an intron begins on the same chromosome and strand, and
    both exons are of one gene.  A gene's exons meet first, as an intron's ends may be those of
    exons of any number of genes; introns are written, so that few of them are broadcast.
    """
    own = ["gene_id", "chrom", "strand"]
    up = exons.select(*own, F.col("start").alias("up_start"), F.col("end").alias("up_end")).distinct()
    down = exons.select(*own, F.col("start").alias("down_start"), F.col("end").alias("down_end")).distinct()
    introns = written(junctions.select("chrom", "strand", F.col("start").alias("up_end"), F.col("end").alias("down_start")).distinct(), "introns")
    met = up.join(down, own).join(introns, ["chrom", "strand", "up_end", "down_start"], "left_semi")
    frame = F.explode(F.array(*map(F.lit, range(3)))).alias("frame")
    edges = met.select(*own, "up_start", "up_end", frame, "down_start", "down_end")
    return edges.withColumn("next_frame", ((F.col("frame") + F.col("down_start") - F.col("up_end")) % 3).cast("int"))
