"""An index of sequence texts: tiles of bases with their splice sites and stop codons.

    spark-submit jobs/contig_index.py --texts s3a://lab/contigs --out s3a://lab/contig-index [--assembly hg38 --assembly t2t]

A row of the input is one sequence, the body of a FASTA record of any length.  White space is
taken out, bases are upper-cased and anything but A, C, G and T is N.  The output has a row a tile,

    assembly=A/   contig, tile, start, end, bases, acgt, gc, donors, acceptors, stops

sorted by contig and tile within its files, so that a slice of a contig reads the row groups of
its tiles only; `bases` also holds the first base of the next tile, as functions.sequence wants it.
Sites and codons count in the tile of their first base.  Nothing is shuffled: a task reads texts
and writes their tiles, so neither an assembly nor an organism with most of the rows is one task.

A run overwrites the assemblies it reads and no others, so it can be started again, or for
some assemblies only.  Rows without a text have no tiles; no assembly and "" are one.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from jobs.common import config, log, main_logging, observed
from junctura.functions.sequence import MOTIF_SCORES, STOP_CODONS, genome_tiles
from junctura.session import session

#: `contig`, `assembly` and `bases` are SQL over the columns of the input.
DEFAULTS = {"contig": "contig", "assembly": "assembly", "bases": "bases", "tile": 1 << 16}
TILES = "contig string, tile int, start bigint, end bigint, bases string, acgt bigint, gc bigint, donors bigint, acceptors bigint, stops bigint, assembly string"


WHITE = "\x20\x09\x0a\x0b\x0c\x0d"
#: ASCII but NUL, bases and white space.
OTHER = "".join(c for c in map(chr, range(1, 128)) if c not in "ACGTacgt" + WHITE)


def clean(text):
    """Bases of a FASTA body: no white space, upper-cased, N for anything but A, C, G and T.

    One pass translates ASCII, so the pattern, which is slow where it matches, meets other characters only.
    """
    ascii = F.translate(text, "acgt" + OTHER + WHITE, "ACGT" + "N" * len(OTHER))
    return F.regexp_replace(ascii, "[^ACGTN]", "N")


def tiles(texts: DataFrame, conf: dict) -> DataFrame:
    """A row for each tile of each text; see TILES."""
    size = int(conf["tile"])
    named = F.struct(F.expr(conf["contig"]).cast("string").alias("contig"), F.nullif(F.expr(conf["assembly"]).cast("string"), F.lit("")).alias("assembly"))
    whole = texts.select(named.alias("chrom"), clean(F.expr(conf["bases"])).alias("seq")).filter("seq <> ''")
    # a codon that begins in a tile goes up to two bases over its end, a dinucleotide one
    cut = genome_tiles(whole, size, overhang=2)
    own, pairs = F.substring("seq", 1, size), F.substring("seq", 1, size + 1)
    known = F.replace(own, F.lit("N"), F.lit(""))
    others = F.replace(F.replace(known, F.lit("G"), F.lit("")), F.lit("C"), F.lit(""))
    count = lambda text, words: F.regexp_count(text, F.lit("|".join(words))).cast("bigint")
    donors, acceptors = (sorted({m.split("/")[k] for m in MOTIF_SCORES if "/" in m}) for k in (0, 1))
    start = F.col("tile").cast("bigint") * size
    return cut.select(
        "chrom.contig", "tile", start.alias("start"), (start + F.length(own)).alias("end"), pairs.alias("bases"),
        F.length(known).cast("bigint").alias("acgt"), (F.length(known) - F.length(others)).cast("bigint").alias("gc"), count(pairs, donors).alias("donors"), count(pairs, acceptors).alias("acceptors"), count(F.col("seq"), STOP_CODONS).alias("stops"), "chrom.assembly",
    )


def read_index(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(TILES).parquet(out)


def run(spark: SparkSession, texts: str, out: str, conf: dict | None = None, assemblies: list[str] | None = None) -> dict:
    """Index the texts, or those of some assemblies; what was read and written, by assembly."""
    conf = DEFAULTS | (conf or {})
    source = spark.read.parquet(texts)
    if assemblies:
        source = source.filter(F.expr(conf["assembly"]).isin(*assemblies))
    read, made, number, bases = Observation("texts"), Observation("tiles"), F.count("*").alias("rows"), F.coalesce(F.sum("acgt"), F.lit(0)).alias("bases")
    rows = tiles(source.observe(read, number), conf)
    rows.observe(made, number, bases).sortWithinPartitions("assembly", "contig", "tile").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("assembly").parquet(out)
    wrote = observed(made, rows, number, bases)
    told = {"texts": observed(read, source, number)["rows"], "tiles": wrote["rows"], "bases": wrote["bases"]}
    log.info("%s: read %d texts of %s, wrote %d tiles of %d bases", out, told["texts"], texts, told["tiles"], told["bases"])
    return told


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description=__doc__.splitlines()[0])
    parser.add_argument("--texts", required=True, help="Parquet table of sequences")
    parser.add_argument("--out", required=True)
    parser.add_argument("--assembly", action="append", help="only this one; may be repeated")
    parser.add_argument("--config", default="contig_index.json", help="a name in jobs/conf, or a path")
    told = parser.parse_args(args)
    main_logging()
    spark = session("contig-index")
    try:
        run(spark, told.texts, told.out, config(told.config, DEFAULTS, spark), told.assembly)
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
