"""Sequence and text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scores of the motifs at intron ends, best first.
MOTIF_SCORES = {"GT/AG": 1.0, "GC/AG": 0.8, "AT/AC": 0.6, "non-canonical": 0.2}
STOP_CODONS = ("TAA", "TAG", "TGA")
TILE = 1 << 16


def reverse_complement(seq: Column) -> Column:
    """Upper-cased, with N for anything but A, C, G and T."""
    return F.translate(F.reverse(F.regexp_replace(F.upper(seq), "[^ACGT]", "N")), "ACGT", "TGCA")


def motif_class(donor: Column, acceptor: Column) -> Column:
    """Class of two dinucleotides, read as they are or each reverse-complemented."""
    out = F
    pairs = [m for m in MOTIF_SCORES if "/" in m]
    for d, a in ((F.upper(donor), F.upper(acceptor)), (reverse_complement(donor), reverse_complement(acceptor))):
        for m in pairs:
            out = out.when(F.concat(d, F.lit("/"), a) == m, m)
    return out.otherwise("non-canonical")


def motif_score(motif: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in MOTIF_SCORES.items() for x in kv))
    return F.coalesce(F.element_at(table, motif), F.lit(0.2))


def gene_key(gene: Column) -> Column:
    """Without quotes, and without the version if it is an ENSG name."""
    bare = F.regexp_replace(gene, '^"+|"+$', "")
    return F.when(bare.startswith("ENSG"), F.element_at(F.split(bare, r"\."), 1)).otherwise(bare)


def attributes(column: Column) -> Column:
    """map<string,string> of `key "value";` text; of repeated keys the last holds."""
    pairs = F.transform(F.filter(F.split(column, ";"), lambda x: F.trim(x) != ""), lambda x: F.struct(F.regexp_extract(F.trim(x), r"^(\S+)", 1).alias("k"), F.regexp_replace(F.regexp_extract(F.trim(x), r"^\S+\s+(.*)$", 1), '^"|"$', "").alias("v")))
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def attribute(column: Column, key: str) -> Column:
    """One attribute, null if absent."""
    return F.try_element_at(attributes(column), F.lit(key))


def safe_name(column: Column) -> Column:
    return F.regexp_replace(column, "[^A-Za-z0-9]", "_")


def sample_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"\.bam$", "")


def stop_codon(seq: Column, frame: Column) -> Column:
    """0-based place of the first stop codon in a frame, or null."""
    places = F.when(F.length(seq) - frame >= 3, F.sequence(frame, F.length(seq) - 3, F.lit(3))).otherwise(F.array().cast("array<int>"))
    return F.try_element_at(F.filter(places, lambda i: F.upper(F.substring(seq, i + 1, 3)).isin(*STOP_CODONS)), F.lit(1))


def genome_tiles(genome: DataFrame, tile: int = TILE, overhang: int = 1) -> DataFrame:
    """(chrom, tile, seq) of (chrom, seq); a tile also holds the first `overhang` bases of the next, one for dinucleotides across the border."""
    cuts = F.posexplode(F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.length("seq"), F.lit(1)) - 1) / tile).cast("int")), lambda k: F.substring("seq", k * tile + 1, F.lit(tile + overhang)))).alias("tile", "seq")
    return genome.select("chrom", cuts)


def genome_slices(places: DataFrame, tiles: DataFrame, name: str, tile: int = TILE) -> DataFrame:
    """Adds the bases of [start, end) of rows (chrom, <name>_start, <name>_end), upper-cased; rows over no tile drop out.

    Each distinct place is cut once, from the tiles it covers, and rows find their place's bases,
    so rows that repeat a place, or are equal, keep their number.
    """
    key = ["chrom", f"{name}_start", f"{name}_end"]
    lo, hi = F.floor(F.col(f"{name}_start") / tile), F.floor((F.col(f"{name}_end") - 1) / tile)
    spread = places.select(*key).distinct().withColumn("tile", F.explode(F.sequence(lo.cast("int"), hi.cast("int"))))
    part = F.struct("tile", F.expr(f"substring(substring(seq, 1, {tile}), cast(greatest({name}_start - tile * {tile}, 0) as int) + 1, cast(least({name}_end - tile * {tile}, {tile}) - greatest({name}_start - tile * {tile}, 0) as int))").alias("s"))
    got = spread.join(tiles, ["chrom", "tile"]).groupBy(*key).agg(F.upper(F.array_join(F.transform(F.sort_array(F.collect_list(part)), lambda p: p["s"]), "")).alias(name))
    return places.join(got, key).select(*places.columns, name)


def with_motif(junctions: DataFrame, tiles: DataFrame, tile: int = TILE) -> DataFrame:
    """Adds donor and acceptor dinucleotides, motif and motif_score; strands but + take donor and acceptor the other way round."""
    plus = F.col("strand") == "+"
    at_start = tiles.select("chrom", F.col("tile").alias("t1"), F.col("seq").alias("s1"))
    at_end = tiles.select("chrom", F.col("tile").alias("t2"), F.col("seq").alias("s2"))
    keyed = junctions.withColumns({"t1": F.floor(F.col("start") / tile).cast("int"), "t2": F.floor((F.col("end") - 2) / tile).cast("int")})
    joined = keyed.join(at_start, ["chrom", "t1"], "left").join(at_end, ["chrom", "t2"], "left")
    first = F.upper(F.expr(f"substring(s1, cast(start - t1 * {tile} as int) + 1, 2)"))
    last = F.upper(F.expr(f"substring(s2, cast(`end` - 2 - t2 * {tile} as int) + 1, 2)"))
    joined = joined.withColumns({"donor_bases": F.when(plus, first).otherwise(last), "acceptor_bases": F.when(plus, last).otherwise(first)})
    joined = joined.withColumn("motif", motif_class(F.coalesce("donor_bases", F.lit("")), F.coalesce("acceptor_bases", F.lit(""))))
    return joined.withColumn("motif_score", motif_score(F.col("motif"))).drop("t1", "t2", "s1", "s2")
