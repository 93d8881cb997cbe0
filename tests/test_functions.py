"""Unit vectors of functions and operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from junctura.functions import cigar, dirichlet, hypothesis, sequence, special
from junctura.operators import compare, differential, events, graph, intervals, psi
from junctura.sources import tool_tables


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_special_functions():
    x = np.array([0.1, 0.5, 1, 2.5, 10, 123.4])
    assert special.gammaln(x) == pytest.approx([math.lgamma(v) for v in x])
    h = 1e-5
    assert special.digamma(x) == pytest.approx([(math.lgamma(v + h) - math.lgamma(v - h)) / (2 * h) for v in x], rel=1e-5)
    assert special.chi2_sf(1.0, 1) == pytest.approx(0.3173105) and special.chi2_sf(3.841459, 1) == pytest.approx(0.05, rel=1e-5) and special.chi2_sf(10, 1) == pytest.approx(0.0015654, rel=1e-4)
    assert special.chi2_sf(5.991465, 2) == pytest.approx(0.05, rel=1e-5) and special.chi2_sf(-3, 1) == 1.0
    assert special.beta_inc(2, 3, 0.4) == pytest.approx(0.5248)


def test_dirichlet_multinomial():
    assert dirichlet.log_likelihood(np.array([10, 20, 30]), np.ones(3)) == pytest.approx(-64.0747691)
    assert dirichlet.log_likelihood(np.array([0, 10, 20]), np.full(3, 0.5)) == pytest.approx(-22.8645838)
    assert dirichlet.log_likelihood(np.array([[10, 20, 30], [15, 25, 35], [20, 30, 40]]), np.ones(3)) == pytest.approx(-245.0851587)


def test_fits_are_maxima():
    rng = np.random.RandomState(0)
    y = np.array([0, 0, 0, 0, 1, 1, 1, 1])
    counts = np.array([rng.multinomial(80, rng.dirichlet(np.array([4, 3, 2]) * (5 if g else 3))) for g in y])
    full, null, df = dirichlet.design_matrices(y)
    assert full.shape == (8, 2) and null.shape == (8, 1) and df == 1
    a, b = dirichlet.fit_glm(counts, full), dirichlet.fit_glm(counts, null)
    assert a.converged and b.converged and a.log_likelihood >= b.log_likelihood - 1e-6
    for _ in range(30):  # no neighbour is better
        p = b.alpha[0] * np.exp(rng.normal(0, 0.05, 3))
        assert dirichlet.log_likelihood(counts, p) <= b.log_likelihood + 1e-6
    free = dirichlet.fit_free(counts)
    assert free.log_likelihood == pytest.approx(b.log_likelihood, abs=1e-3)  # the same model in other parameters
    assert dirichlet.fit_free_groups(counts, y)[2] >= free.log_likelihood - 1e-6


def test_two_sample_tests():
    a, b = np.array([1.0, 2.0, 3.0, 4.0]), np.array([2.5, 3.5, 4.5, 6.0])
    va, vb = a.var(ddof=1) / 4, b.var(ddof=1) / 4
    t, df = abs(a.mean() - b.mean()) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / 3 + vb**2 / 3)
    x = np.linspace(-t, t, 200_001)
    density = math.exp(math.lgamma((df + 1) / 2) - math.lgamma(df / 2)) / math.sqrt(df * math.pi) * (1 + x * x / df) ** (-(df + 1) / 2)
    assert hypothesis.welch(a, b) == pytest.approx(1 - np.trapezoid(density, x), abs=1e-6)
    assert hypothesis.mann_whitney(np.array([1.0, 2, 3]), np.array([4.0, 5, 6])) == pytest.approx(0.1)
    assert hypothesis.mann_whitney(a, b) == pytest.approx(hypothesis.mann_whitney(b, a))
    assert math.isnan(hypothesis.welch(np.ones(3), np.ones(3)))
    assert hypothesis.bimodality(np.ones(3)) == 1.0


def test_bootstrap_stream():
    got = psi.multinomial_replicates(np.array([[20], [20], [10]]), 3, 42)[:, :, 0]
    assert got.tolist() == [[19, 16, 15], [22, 18, 10], [16, 25, 9]]
    shares = psi.replicate_psi(got[:, :, None], np.array([100.0, 100.0, 0.0]))
    assert shares.sum(1) == pytest.approx(1) and (shares[:, 2] == 0).all()


def test_cigar_two_ways(spark):
    import pyarrow as pa

    from junctura.operators.reads import aligned_blocks

    texts = ["25M400N2M3D10M1I5M", "5S10M2H", None, "*", "10=5X3N1M", "3D5M"]
    row, start, end = cigar.blocks(pa.array(texts), np.array([100] * 6))
    got = [[(s, e) for r, s, e in zip(row.tolist(), start.tolist(), end.tolist()) if r == k] for k in range(6)]
    assert got[0] == [(100, 125), (525, 527), (530, 540), (540, 545)]
    rows = spark.createDataFrame([(i, t, 100) for i, t in enumerate(texts)], "i int, cigar string, pos bigint").select("i", aligned_blocks().alias("b")).collect()
    assert [[tuple(x) for x in (r.b or [])] for r in sorted(rows)] == got
    assert cigar.pairs(np.array([0, 0, 0, 1, 2, 2]))[0].tolist() == [0, 1, 4, 0]


def test_intervals(spark):
    frame = lambda rows: spark.createDataFrame(rows, "chrom string, start bigint, end bigint, strand string")
    merged = lambda rows: sorted((r.chrom, r.start, r.end, r.strand) for r in intervals.merge_intervals(frame(rows)).collect())
    assert merged([("a", 100, 200, "+"), ("a", 200, 300, "+")]) == [("a", 100, 300, "+")]
    assert merged([("a", 300, 400, "+"), ("a", 100, 200, "+"), ("a", 150, 350, "+")]) == [("a", 100, 400, "+")]
    assert len(merged([("a", 1, 9, "+"), ("a", 1, 9, "-"), ("a", 1, 9, "."), ("b", 1, 9, "+")])) == 4
    cut = lambda a, b: sorted((r.start, r.end) for r in intervals.subtract(spark.createDataFrame([("c", *a, "+", "c", *b)], "chrom string, start bigint, end bigint, strand string, b_chrom string, b_start bigint, b_end bigint")).collect())
    assert cut((100, 400), (200, 300)) == [(100, 200), (300, 400)] and cut((100, 300), (50, 200)) == [(200, 300)] and cut((100, 200), (50, 300)) == [] and cut((1, 5), (5, 9)) == [(1, 5)]
    wide = intervals.overlap_join(frame([("a", 0, 100_000, "+")]), frame([("a", 5, 6, "+"), ("a", 99_999, 100_005, "+"), ("a", 100_000, 100_001, "+"), ("a", 5, 6, "-")]), 1000)
    assert sorted((r.r_start, r.r_end) for r in wide.collect()) == [(5, 6), (99_999, 100_005)]


def test_sequences(spark):
    s = F.lit
    assert one(spark, sequence.reverse_complement(s("AcgTxN"))).c0 == "NNACGT"
    assert one(spark, sequence.motif_class(s("AC"), s("CT")), sequence.motif_class(s("gt"), s("ag")), sequence.motif_class(s("GC"), s("AG")), sequence.motif_class(s("AA"), s("AG"))) == ("GT/AG", "GT/AG", "GC/AG", "non-canonical")
    assert one(spark, sequence.motif_score(s("AT/AC")), sequence.motif_score(s("?"))) == (0.6, 0.2)
    assert one(spark, sequence.gene_key(s('"ENSG01.3"')), sequence.gene_key(s("abc.3"))) == ("ENSG01", "abc.3")
    assert one(spark, sequence.attribute(s('gene_id "a b"; x "1"; x "2";'), "x"), sequence.attribute(s('gene_id "a b";'), "gene_id"), sequence.attribute(s('gene_id "g";'), "none")) == ("2", "a b", None)
    assert one(spark, sequence.stop_codon(s("ATGAAATAGTAA"), s(0)), sequence.stop_codon(s("AT"), s(0))) == (6, None)


def test_event_types(spark):
    def kind(*js):
        rows = [("m", a, b, "+") for a, b in js]
        return events.classify(spark.createDataFrame(rows, "module_id string, start bigint, end bigint, strand string")).first().event_type

    assert kind((1000, 2000), (1000, 2500)) == "A3SS" and kind((1000, 2500), (1500, 2500)) == "A5SS" and kind((1500, 2500), (1000, 3000)) == "RI"
    assert kind((1000, 2000), (1000, 3000), (2100, 3000)) == "SE" and kind((1, 9), (20, 30)) == "Complex" and kind((1, 2), (1, 3), (1, 4), (1, 5), (1, 6)) == "Complex"


def test_clusters(spark):
    rows = [("chr1", 1000, 1100 + k, "+") for k in range(100)] + [("chr1", 1199, 5000, "+"), ("chr1", 1, 300_000, "+"), ("chr1", 1000, 1050, "-")]
    got = graph.clusters(graph.cluster_junctions(spark.createDataFrame(rows, "chrom string, start bigint, end bigint, strand string"))).collect()
    assert [(r.start, r.end, r.size) for r in got] == [(1000, 5000, 101)]  # one ends where another starts


def test_tool_tables(spark, tmp_path):
    (tmp_path / "SE.MATS.JC.txt").write_text('ID\tGeneID\tgeneSymbol\tchr\tstrand\tPValue\tFDR\tIncLevelDifference\n1\t"ENSG00000001.2"\t"N1"\tchr1\t+\t0.005\t0.02\t0.25\n2\t"ENSG00000005.1"\t"N5"\tchr1\t-\t0.01\tNA\tNA\n')
    (tmp_path / "A3SS.MATS.JC.txt").write_text('ID\tGeneID\tgeneSymbol\tchr\tstrand\tPValue\tFDR\tIncLevelDifference\n1\t"ENSG00000002.2"\t"N2"\tchr1\t+\t0.03\t0.04\t0.22\n')
    (tmp_path / "m.tsv").write_text("# made by hand\nGene Name\tGene ID\tLSV ID\tmean_dpsi_per_lsv_junction\tP(|dPSI|>=0.20) per LSV junction\tchr\tstrand\nN1\tENSG00000001.1\tx\t.25;-.30\t.98;.1\tchr1\t+\nN6\tENSG00000006.1\tx\t.05\t.20\tchr1\t+\n")
    (tmp_path / "s.dpsi").write_text("c1\tc2\nENSG00000001.1;SE:chr1:1-2:3-4:+\t0.3\t0.001\nENSG00000007.1;RI:chr2:1-2:-\tnan\tnan\n")
    (tmp_path / "own.tsv").write_text("module_id\tgene_id\tgene_name\tchrom\tstrand\tevent_type\tmax_abs_delta_psi\tp_value\tfdr\nm\tENSG00000001.1\tN1\tchr1\t+\tSE\t.3\t.001\t.01\nn\tENSG00000004.1\tN4\tchr1\t+\tComplex\t.1\t.5\t.6\n")
    rmats = {(r.gene_id, r.event_type): r for r in tool_tables.rmats_results(spark, str(tmp_path)).collect()}
    assert rmats["ENSG00000001.2", "SE"].significant and rmats["ENSG00000005.1", "SE"].fdr == 1.0 and rmats["ENSG00000002.2", "A3SS"].delta_psi == 0.22
    majiq = tool_tables.majiq_results(spark, str(tmp_path / "m.tsv")).orderBy("gene_id").collect()
    assert majiq[0].delta_psi == -0.30 and majiq[0].significant and majiq[0].fdr == pytest.approx(0.02) and not majiq[1].significant
    suppa = tool_tables.suppa2_results(spark, str(tmp_path / "s.dpsi")).orderBy("gene_id").collect()
    assert [(r.event_type, r.chrom, r.strand, r.delta_psi, r.p_value) for r in suppa] == [("SE", "chr1", "+", 0.3, 0.001), ("RI", "chr2", "-", 0.0, 1.0)]
    own = tool_tables.own_results(spark, str(tmp_path / "own.tsv"))
    assert sorted((r.gene_id, r.significant) for r in own.collect()) == [("ENSG00000001.1", True), ("ENSG00000004.1", False)]
    every = own.unionByName(tool_tables.rmats_results(spark, str(tmp_path)))
    assert {r.tool: (r.shared, r.own_only, r.tool_only, r.jaccard) for r in compare.concordance(every).collect()} == {"rMATS": (1, 0, 1, 0.5)}


def test_truth_evaluation(spark):
    truth = spark.createDataFrame([(1, "SE", True), (2, "A3SS", True), (3, "A5SS", True), (4, "MXE", True), (5, "RI", False), (6, "SE", False)], "gene int, type string, ds_status boolean").selectExpr("concat('G', gene) GeneID", "type", "ds_status")
    results = spark.createDataFrame([("G1", "SE", 0.005), ("G2", "A3SS", 0.01), ("G3", "A5SS", 0.02), ("G7", "SE", 0.04), ("G5", "RI", 0.6), ("G8", "Complex", 0.8)], "gene_id string, event_type string, fdr double")
    got = {r.level: r for r in compare.evaluate(results, tool_tables.truth_table(truth)).collect()}
    assert [(got[k].tp, got[k].fp, got[k].fn) for k in ("gene", "event", "SE", "A3SS", "A5SS", "MXE", "RI")] == [(3, 1, 1), (3, 1, 1), (1, 1, 0), (1, 0, 0), (1, 0, 0), (0, 0, 1), (0, 0, 0)]
    assert (got["gene"].tpr, got["gene"].fdr, got["gene"].f_score) == (0.75, 0.25, 0.75)


def test_fdr(spark):
    from junctura.operators.fdr import benjamini_hochberg

    rows = [("a", 0.01), ("b", 0.05), ("c", 0.03), ("d", 0.10)]
    got = {r.module_id: r.fdr for r in benjamini_hochberg(spark.createDataFrame(rows, "module_id string, p_value double")).collect()}
    assert got == pytest.approx({"a": 0.04, "b": 0.2 / 3, "c": 0.06, "d": 0.1})


def test_beta_posterior(spark):
    values = [one(spark, *psi.beta_posterior(F.lit(c), F.lit(60))) for c in (10, 20, 30)]
    assert [v.c0 for v in values] == pytest.approx([0.1721311, 0.3360656, 0.5]) and [v.c1 for v in values] == pytest.approx([0.1917674, 0.2399599, 0.2540003])


def test_too_few_samples(spark):
    shares = spark.createDataFrame([("m", 0, 0, 0.5)], "module_id string, j_idx int, sample_idx int, psi double")
    assert differential.heterogeneous(shares, {0: 0, 1: 0, 2: 1}).count() == 0


def test_by_chromosome_and_discovery(spark, tmp_path):
    from junctura.operators.by_chromosome import by_chromosome
    from junctura.sources.alignments import discover, standard_chromosomes

    rows = spark.createDataFrame([("chr1", 1), ("chr1", 5), ("chr2", 7)], "chrom string, x int")
    got = by_chromosome(rows, lambda g: g.groupby("chrom", as_index=False).x.sum(), "chrom string, x bigint")
    assert sorted(map(tuple, got.collect())) == [("chr1", 6), ("chr2", 7)]
    for k in range(8):
        (tmp_path / f"s{k}.bam").write_bytes(b"")
    (tmp_path / "annotation.gtf").write_text("")
    found = discover(str(tmp_path))
    assert [p[-6:] for p in found["group2"]] == ["s4.bam", "s5.bam", "s6.bam", "s7.bam"] and found["gtf"].endswith("annotation.gtf") and found["genome"] == ""
    assert len(standard_chromosomes()) == 24 and len(standard_chromosomes(False)) == 22


def test_report_title(spark):
    from junctura.sinks.report import title_rows

    assert title_rows(spark, {"a": 1}, {"b": 2}).count() == 2 and title_rows(spark).count() == 0


def test_rates_against_the_definition(spark):
    """Benjamini-Hochberg over tiny, tied, large and missing p-values."""
    import math
    import random

    from junctura.operators.fdr import benjamini_hochberg

    rng = random.Random(1)
    ps = [rng.choice([rng.random(), rng.random() * 1e-3, 10.0 ** -rng.randrange(320), 0.25, 1.0, 0.0, float("nan")]) for _ in range(500)]
    rows = [(f"m{k}", p) for k, p in enumerate(ps)] + [("none", None)]
    got = {r.module_id: r.fdr for r in benjamini_hochberg(spark.createDataFrame(rows, "module_id string, p_value double")).collect()}
    order = sorted(range(500), key=lambda k: (math.isnan(ps[k]), ps[k]))
    best, want = 1.0, {}
    for rank in range(500, 0, -1):
        k = order[rank - 1]
        if not math.isnan(ps[k]):
            best = min(best, ps[k] * 500 / rank)
        want[f"m{k}"] = float("nan") if math.isnan(ps[k]) else best
    assert got.pop("none") is None
    assert all((math.isnan(got[m]) and math.isnan(q)) or math.isclose(got[m], q, rel_tol=1e-12) for m, q in want.items())


def test_islands_over_bins(spark):
    """Intervals that span many bins, nested and touching ones, and keys that are null."""
    import random

    from junctura.operators.intervals import merge_intervals

    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), s, s + rng.choice([1, 5, 40, 700])) for s in (rng.randrange(20_000) for _ in range(150))]
    table = spark.createDataFrame(rows, "chrom string, start bigint, end bigint")
    for touching in (True, False):
        want = []
        for c in ("a", "b", None):
            reach = None
            for _, s, e in sorted(r for r in rows if r[0] == c) if c else sorted((r for r in rows if r[0] is None), key=lambda r: r[1:]):
                if reach is None or (s > reach if touching else s >= reach):
                    want.append([c, s, e, 0])
                reach = max(e, reach or e)
                want[-1][2:] = reach, want[-1][3] + 1
        for width in (None, 16, 1000):
            got = merge_intervals(table, ("chrom",), touching, bin_width=width).select("chrom", "start", "end", "n", "island").collect()
            assert sorted(map(str, ([*r][:4] for r in got))) == sorted(map(str, want))
            assert len({(r.chrom, r.island) for r in got}) == len(got)
