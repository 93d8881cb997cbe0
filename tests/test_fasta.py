"""FASTA files by byte ranges: with an index, with a derived one, and where there can be none."""

import random

import pytest

from junctura.functions.sequence import genome_slices, genome_tiles
from junctura.sources import fasta as A
from junctura.sources.annotation import read_fasta, read_genome


def made(seed, width, end=b"\n", n=7):
    """Contigs of any length, some of whole lines, with a blank line at the end; their text, and an index by hand."""
    rng = random.Random(seed)
    text, index, contigs = b"", "", []
    for k in range(n):
        size = rng.choice([0, 1, width - 1, width, width + 1, 5 * width, 997])
        seq = "".join(rng.choice("ACGTacgtN") for _ in range(size))
        text += f">c{k} some words >here".encode() + end
        if size:
            index += f"c{k}\t{size}\t{len(text)}\t{min(width, size)}\t{min(width, size) + len(end)}\n"
        text += b"".join(seq[i : i + width].encode() + end for i in range(0, size, width))
        contigs.append((f"c{k}", seq))
    return text, index, contigs


def tiles_of(contigs, tile):
    return sorted((c, k // tile, s[k : k + tile + 1]) for c, s in contigs for k in range(0, len(s), tile))


@pytest.mark.parametrize(("end", "scan"), [(b"\n", 1 << 20), (b"\n", 37), (b"\n", 10), (b"\r\n", 23)])
def test_derived_index(spark, tmp_path, end, scan):
    for seed in range(2):
        text, index, contigs = made(seed, 12, end)
        path = tmp_path / f"{seed}-{scan}.fa"
        path.write_bytes(text)
        reader = A._ScanReader(str(path), scan)
        rows = [r for p in reader.partitions() for r in reader.read(p)]
        assert sum(r[4] for r in rows) == sum(len(s) for _, s in contigs)
        got = A.derived_index(spark, str(path), scan)
        assert [(c.name, c.length) for c in got] == [(c, len(s)) for c, s in contigs]
        assert [c for c in got if c.length] == A.parse_index(index)
        tiles = A.fasta_tiles(spark, str(path), 5, 20, scan)
        assert sorted(tuple(r) for r in tiles.collect()) == tiles_of(contigs, 5)


def test_index_beside_the_file_is_taken(spark, tmp_path):
    text, index, contigs = made(9, 60, n=20)
    path = tmp_path / "g.fa"
    path.write_bytes(text)
    (tmp_path / "g.fa.fai").write_text(index)
    tiles = A.fasta_tiles(spark, str(path), 16, 64)
    assert sorted(tuple(r) for r in tiles.collect()) == tiles_of(contigs, 16)
    assert tiles.rdd.getNumPartitions() > 20
    longest = max(contigs, key=lambda c: len(c[1]))
    one = tiles.filter(f"chrom = '{longest[0]}'")
    assert sorted(tuple(r) for r in one.collect()) == tiles_of([longest], 16)
    assert one.rdd.getNumPartitions() < tiles.rdd.getNumPartitions()
    (tmp_path / "g.fa.fai").write_text(index.replace("\t60\t61", "\t59\t61"))
    with pytest.raises(Exception, match="does not fit"):
        A.fasta_tiles(spark, str(path), 16, 64).collect()


@pytest.mark.parametrize("text", [">a\nACGT\nAC\nACGT\n", ">a\nACGT\n\nACGT\n", "ACGT\n", ">a\nAC\nACGT\n", ">a\nACGT\nACGT\r\nAC\n"])
def test_lines_that_differ_have_no_index(spark, tmp_path, text):
    path = tmp_path / "g.fa"
    path.write_bytes(text.encode())
    for scan in (4, 100):
        assert A.derived_index(spark, str(path), scan) is None
    if text.startswith(">"):
        want = genome_tiles(read_fasta(spark, str(path)), 3)
        assert sorted(map(tuple, read_genome(spark, str(path), tile=3).collect())) == sorted(map(tuple, want.select("chrom", "tile", "seq").collect()))


def test_empty_file_and_no_end_of_line(spark, tmp_path):
    (tmp_path / "e.fa").write_text("")
    assert A.fasta_tiles(spark, str(tmp_path / "e.fa")).count() == 0
    (tmp_path / "n.fa").write_text(">a\nACGTA\nCG")
    assert [tuple(r) for r in A.fasta_tiles(spark, str(tmp_path / "n.fa"), 4).orderBy("tile").collect()] == [("a", 0, "ACGTA"), ("a", 1, "ACG")]


def test_repeated_places_keep_their_rows(spark):
    tiles = genome_tiles(spark.createDataFrame([("c", "ACGTACGTAC"), ("d", "TTTT")], "chrom string, seq string"), 4)
    places = spark.createDataFrame([("c", 1, 5, 1), ("c", 1, 5, 1), ("c", 1, 5, 2), ("d", 0, 2, 1), ("x", 0, 2, 1)], "chrom string, x_start bigint, x_end bigint, n int")
    got = sorted((r.chrom, r.n, r.x) for r in genome_slices(places, tiles, "x", 4).collect())
    assert got == [("c", 1, "CGTA"), ("c", 1, "CGTA"), ("c", 2, "CGTA"), ("d", 1, "TT")]
