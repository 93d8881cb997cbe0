"""The whole analysis on a set with known outcome, and its sources and sinks."""

import json
import os

import pytest
from fixture_set import LABELS, bam, genome, gtf, reads, sam

from junctura.operators.reads import READS


@pytest.fixture(scope="session")
def inputs(spark, tmp_path_factory):
    from junctura.functions.sequence import genome_tiles
    from junctura.sources.annotation import gene_models, gtf_rows

    lines = spark.createDataFrame([(x,) for x in gtf().splitlines()], "value string")
    genes, exons = gene_models(gtf_rows(lines))
    tiles = genome_tiles(spark.createDataFrame([("chr1", genome())], "chrom string, seq string"), 1024)
    return spark.createDataFrame(reads(), READS), genes, exons, tiles


@pytest.fixture(scope="session")
def results(spark, inputs):
    from junctura.functions import sequence
    from junctura.pipeline import Settings, analyse

    table, genes, exons, _ = inputs
    tiles = sequence.genome_tiles(spark.createDataFrame([("chr1", genome())], "chrom string, seq string"))
    return analyse(table, genes, exons, LABELS, tiles, settings=Settings(read_length=50, min_cluster_reads=10, seed=42))


def test_gene_models(inputs):
    _, genes, exons, _ = inputs
    assert {(g.gene_id, g.start, g.end, g.gene_name) for g in genes.collect()} == {("GENE_A", 1000, 3100, "N GENE_A"), ("GENE_B", 5000, 6100, "N GENE_B"), ("GENE_C", 8000, 10100, "N GENE_C")}
    assert exons.count() == 14


def test_junctions_and_confidence(results):
    rows = {(r.start, r.end): r for r in results.evidence.collect()}
    assert len(rows) == 10
    assert sum(r.is_annotated for r in rows.values()) == 9
    assert all(r.motif == "GT/AG" and r.motif_score == 1.0 for r in rows.values())
    assert rows[1100, 2000].sample_counts == [20, 20, 20, 7, 7, 7]
    assert rows[1100, 2000].composite_score == pytest.approx(1.0)
    assert rows[8100, 9000].composite_score == pytest.approx(0.75)


def test_modules_and_events(results):
    got = {r.module_id.split(":")[0]: r for r in results.modules.collect()}
    assert {k: r.n_connections for k, r in got.items()} == {"GENE_A": 3, "GENE_B": 2, "GENE_C": 3}
    assert {r.module_id.split(":")[0]: r.event_type for r in results.events.collect()} == {"GENE_A": "SE", "GENE_B": "A3SS", "GENE_C": "SE"}


def test_usage_and_tests(results):
    d = {r.module_id.split(":")[0]: r for r in results.diff.collect()}
    a = d["GENE_A"]
    assert a.psi_group1 == pytest.approx([0.4, 0.2, 0.4]) and a.psi_group2 == pytest.approx([0.14, 0.72, 0.14])
    assert a.p_value < 0.05 and a.max_abs_delta_psi == pytest.approx(0.52)
    assert d["GENE_B"].p_value > 0.05 and d["GENE_B"].max_abs_delta_psi == 0
    assert sorted(abs(x) for x in d["GENE_C"].delta_psi) == pytest.approx([0.0667, 0.0667, 0.1333], abs=1e-4)
    assert all(r.degrees_of_freedom == 1 and r.null_converged and r.full_converged for r in d.values())


def test_diagnostics(results):
    d = {r.module_id.split(":")[0]: r for r in results.diagnostics.collect()}
    assert d["GENE_A"].confidence_tier in ("HIGH", "MEDIUM")
    assert d["GENE_C"].has_novel_junctions and not d["GENE_A"].has_novel_junctions
    assert d["GENE_A"].mean_mapq == 60 and d["GENE_A"].frac_multi_mapped == 0


def test_heterogeneity(results):
    h = {r.module_id.split(":")[0]: r for r in results.het.collect()}
    assert set(h) == {"GENE_A", "GENE_B", "GENE_C"}
    assert h["GENE_A"].ttest_pvalue < 1e-9  # constant within groups, different between
    assert h["GENE_B"].ttest_pvalue != h["GENE_B"].ttest_pvalue


def test_nmd_against_plain_python(spark, results):
    from junctura.functions.sequence import STOP_CODONS
    from fixture_set import TRANSCRIPTS

    seq = genome()

    def one(gene, start, end):
        good = bad = 0
        for (g, _), exons in TRANSCRIPTS.items():
            if g != gene:
                continue
            ex = None
            for i in range(len(exons) - 1):
                d, a = exons[i][1], exons[i + 1][0]
                if d == start or a == end:
                    ex = list(exons)
                    if d == start and a != end:
                        ex[i + 1] = (end, exons[i + 1][1])
                    elif a == end and d != start:
                        ex[i] = (exons[i][0], start)
                    break
            if ex is None or any(s >= e for s, e in ex):
                continue
            mrna = "".join(seq[s:e] for s, e in sorted(ex))
            atg = mrna.find("ATG")
            if atg < 0:
                continue
            stop = next((i for i in range(atg, len(mrna) - 2, 3) if mrna[i : i + 3] in STOP_CODONS), None)
            last = sum(e - s for s, e in ex[:-1]) if len(ex) > 1 else None
            if stop is not None and last is not None and last - stop > 55:
                bad += 1
            else:
                good += 1
        return good, bad

    rows = results.nmd.collect()
    assert len(rows) == 8
    for r in rows:
        good, bad = one(r.gene_id, r.start, r.end)
        assert (r.n_productive_paths, r.n_unproductive_paths) == (good, bad)
        assert r.classification == ("NE" if good + bad == 0 else "PR" if good else "UP")


def test_exclusive_types(spark, inputs):
    from junctura.pipeline import Settings, analyse

    table, genes, exons, _ = inputs
    res = analyse(table, genes, exons, LABELS, settings=Settings(read_length=50, min_cluster_reads=10, exclusive_types=True, het=False, replicates=5))
    assert {r.event_type for r in res.events.collect()} == {"SE", "A3SS"}  # four junctions would be needed


def test_sources_agree(spark, tmp_path):
    from junctura.operators.reads import junction_counts
    from junctura.sources.alignments import bam_chromosomes, default_chromosomes, read_bam, read_sam

    rows = reads()
    extra = [(0, "u", 4, None, -1, 0, "*", None, None), (0, "s", 16, "chr2", 500, 30, "5S20M100N30M3D10M", 3, -7)]
    for s in (0, 3):
        (tmp_path / f"{s}.sam").write_text(sam(s))
        (tmp_path / f"{s}.bam").write_bytes(bam([r for r in rows if r[0] == s] + (extra if s == 0 else [])))
    from_sam = read_sam(spark, [str(tmp_path / f"{s}.sam") for s in (0, 3)])
    from_bam = read_bam(spark, [str(tmp_path / f"{s}.bam") for s in (0, 3)])
    key = lambda df: sorted(map(tuple, junction_counts(df.filter("chrom = 'chr1'")).collect()))
    assert key(from_sam) == key(from_bam) and len(key(from_sam)) == 20
    odd = {r.qname: r for r in from_bam.filter("qname in ('u', 's')").collect()}
    assert odd["u"].chrom is None and odd["u"].cigar == "*" and odd["u"].nh is None
    assert tuple(odd["s"]) == (0, "s", 16, "chr2", 500, 30, "5S20M100N30M3D10M", 3, -7)
    names = bam_chromosomes(str(tmp_path / "0.bam"))
    assert names == ["chr1", "chr2"] and default_chromosomes([*names, "chrUn_1"], {"chr1"}) == ["chr1"]


def test_fasta(spark, tmp_path):
    from junctura.functions.sequence import genome_slices
    from junctura.sources.annotation import read_fasta, read_genome

    path = tmp_path / "g.fa"
    path.write_text(">chr1 first\nACGT\nacgt\n>chr2\nGG\n")
    assert {(r.chrom, r.seq) for r in read_fasta(spark, str(path)).collect()} == {("chr1", "ACGTacgt"), ("chr2", "GG")}
    places = spark.createDataFrame([("chr1", 2, 6)], "chrom string, x_start bigint, x_end bigint")
    assert genome_slices(places, read_genome(spark, str(path), ["chr1"]), "x").first().x == "GTAC"


def test_command_line(spark, tmp_path, results):
    from junctura.cli import main

    for s in LABELS:
        (tmp_path / f"{s}.sam").write_text(sam(s))
    (tmp_path / "g.gtf").write_text(gtf())
    (tmp_path / "g.fa").write_text(">chr1\n" + genome() + "\n")
    bams = [x for s in LABELS for x in ("--bam", str(tmp_path / f"{s}.sam"))]
    out = tmp_path / "out"
    wanted = ["run", *bams, "--gtf", str(tmp_path / "g.gtf"), "--genome", str(tmp_path / "g.fa"), "--group1", "0,1,2", "--group2", "3,4,5", "--read-length", "50", "--min-cluster-reads", "10", "--checkpoint-dir", str(tmp_path / "cp")]
    main([*wanted, "-o", str(out), "--export", "bed", "--export", "majiq", "--export", "xlsx", "--export", "pdf"])
    assert (out / "report.pdf").read_bytes().startswith(b"%PDF") and len(os.listdir(out / "figures")) == 4
    marks = {p: p.stat().st_mtime_ns for p in (tmp_path / "cp").rglob("_SUCCESS")}
    assert {p.parent.name.split("-")[0] for p in marks} == {"reads", "counts", "evidence", "members", "modules", "module", "cells", "bootstrap", "events", "diff", "diagnostics"}
    broken = next(p for p in marks if p.parent.name == "diagnostics")
    broken.unlink()
    main([*wanted, "-o", str(tmp_path / "again")])
    assert {p for p in marks if p.stat().st_mtime_ns != marks[p]} == {broken}
    lines = lambda folder: sorted(x for p in (folder / "results.tsv").glob("part-*") for x in p.read_text().splitlines())
    assert lines(out) == lines(tmp_path / "again")
    table = spark.read.option("sep", "\t").option("header", True).csv(str(out / "results.tsv"))
    assert len(table.columns) == 27 and table.count() == 3
    assert "Junction usage report" in (out / "report.html").read_text()
    details = spark.read.option("sep", "\t").option("header", True).csv(str(out / "junctions.tsv"))
    assert len(details.columns) == 19 and details.count() == 10
    assert all("lsv_id" in json.loads(r.value) for r in spark.read.text(str(out / "lsv")).collect())
    main(["export", "--results", str(out), "--format", "rmats", "--format", "gtf", "-o", str(tmp_path / "x")])
    main(["qc", "--results", str(out), "-o", str(tmp_path / "qc.html")])
    main(["annotate", "--evidence", str(out / "evidence.parquet"), "--gtf", str(tmp_path / "g.gtf"), "-o", str(tmp_path / "annotated")])
    main(["quantify", *bams, "--gtf", str(tmp_path / "g.gtf"), "-o", str(tmp_path / "q")])
    main(["sashimi", "--results", str(out / "results.tsv"), *bams, "--gtf", str(tmp_path / "g.gtf"), "--group1", "0,1,2", "--group2", "3,4,5", "--n-top", "1", "-o", str(tmp_path / "s")])
    assert spark.read.parquet(str(tmp_path / "annotated")).filter("is_annotated").count() == 9
    assert any(os.listdir(tmp_path / "s"))


def test_stream_equals_batch(spark, tmp_path):
    from junctura.operators.reads import junction_counts
    from junctura.streaming.counts import stream_counts, stream_reads

    table = spark.createDataFrame(reads(), READS)
    table.repartition(3).write.parquet(str(tmp_path / "in"))
    run = stream_counts(stream_reads(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("counts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, junction_counts(table).collect()))
