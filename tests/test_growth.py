"""Steps whose work must not grow with the square of a group, nor their shuffles with their results."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from junctura.functions import sequence as Q
from junctura.operators import graph as G
from junctura.operators import modules as M
from junctura.operators import nmd as N
from junctura.operators import reads as R
from junctura.sources.annotation import gene_models, gtf_rows
from junctura.stages import written as kept


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_exclusive_pairs_are_made_last(spark):
    rng = random.Random(5)
    own = {"a": rng.sample(range(90), 40), "b": rng.sample(range(90), 23), "c": [4]}
    members = spark.createDataFrame([(m, k) for m, ks in own.items() for k in ks], "module_id string, j_idx bigint")
    edges = sorted({(m, *sorted(rng.sample(ks, 2)), rng.randrange(2)) for m, ks in own.items() for _ in range(60) if len(ks) > 1})
    linked = {e[:3] for e in edges if e[3]}
    want = sorted((m, i, j) for m, ks in own.items() for i, j in combinations(sorted(ks), 2) if (m, i, j) not in linked)
    edges = spark.createDataFrame(edges, "module_id string, i bigint, j bigint, n bigint")
    for block in (1, 4, 1000):
        assert sorted(tuple(r) for r in G.exclusive_pairs(members, edges, block).collect()) == want
    # above the row that makes pairs there is no join, so none are dealt
    above = _plan(G.exclusive_pairs(members, edges)).split("Generate explode")[0]
    assert "Join" not in above and "Aggregate" not in above


def test_exclusive_pairs_come_of_one_junction_at_a_time(spark):
    own = {"a": range(60), "b": range(7)}
    members = spark.createDataFrame([(m, k) for m, ks in own.items() for k in ks], "module_id string, j_idx bigint")
    # junction 0 has more neighbours in a block than are looked through, the others few or none
    linked = {("a", 0, k) for k in range(1, 55)} | {("a", k, k + 1) for k in range(1, 59, 3)} | {("b", 2, 5)}
    edges = spark.createDataFrame([(*e, 1) for e in linked], "module_id string, i bigint, j bigint, n bigint")
    want = sorted((m, i, j) for m, ks in own.items() for i, j in combinations(ks, 2) if (m, i, j) not in linked)
    for block in (5, 1000):
        assert sorted(tuple(r) for r in G.exclusive_pairs(members, edges, block).collect()) == want
    # a stage puts out all pairs of its input row at once: rows are made of blocks before the exchange, not beside the pairs
    stage = G.exclusive_pairs(members, edges)._jdf.queryExecution().executedPlan().toString().split("Exchange")[0]
    assert stage.count("Generate explode") == 1


def test_reads_of_one_place_meet_exons_of_one_place_once(spark):
    rows = [(k % 2, f"q{k}", 0, "chr1", 100 + k % 3, 30, "40M50N10M", 1 + k % 2, None) for k in range(600)]
    reads = spark.createDataFrame([*rows, (0, "long", 0, "chr1", 100, 30, "3000M", None, None)], R.READS)
    exons = spark.createDataFrame([(k, "chr1", 90 + k % 4 * 5, 205 - k % 4) for k in range(40)] + [(99, "chr1", 0, 5000), (98, "chr1", 7, 7)], "exon_id bigint, chrom string, start bigint, end bigint")
    spans = [(r[0], r[4], r[4] + 100, 1 / r[7]) for r in rows] + [(0, 100, 3100, 1.0)]
    want = {}
    for x in exons.collect():
        for sample, first, last, w in spans:
            if first >= x.start and last <= x.end:
                n, total = want.get((x.exon_id, sample), (0, 0.0))
                want[x.exon_id, sample] = n + 1, total + w
    made = R.exon_body_reads(reads, exons)
    got = {(r.exon_id, r.sample_idx): (r.n, round(r.weighted, 6)) for r in made.collect()}
    assert got == {k: (n, round(w, 6)) for k, (n, w) in want.items()} and len(got) > 20
    joined = max(int(m) for m in _rows_of_joins(made))
    assert joined <= 100, joined


def _rows_of_joins(df):
    """Rows that the joins of a run query put out."""
    plan = df._jdf.queryExecution().executedPlan()
    out = []

    def walk(p):
        name = p.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(p.executedPlan())
        if name.startswith(("ShuffleQueryStage", "BroadcastQueryStage", "ResultQueryStage")):
            return walk(p.plan())
        if "Join" in name and p.metrics().contains("numOutputRows"):
            out.append(p.metrics().apply("numOutputRows").value())
        for k in range(p.children().size()):
            walk(p.children().apply(k))

    walk(plan)
    return out


def test_modules_do_not_expand_their_junctions(spark):
    members = spark.createDataFrame([(f"cluster:{c}", "chr1", 100 * c + k, 100 * c + k + 40, "+") for c in range(3) for k in range(20)], "cluster_id string, chrom string, start bigint, end bigint, strand string")
    genes = spark.createDataFrame([(f"g{k}", None if k % 2 else "n", "chr1", 10 * k, 10 * k + 150, "+") for k in range(12)], "gene_id string, gene_name string, chrom string, start bigint, end bigint, strand string")
    modules, junctions = M.build_modules(G.clusters(members), members, genes)
    assert _sorted(modules.select("module_id", "gene_id", "gene_name", "chrom", "strand", "start", "end", "n_connections")) == _sorted(junctions.groupBy("module_id", "gene_id", "gene_name", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_connections")))
    assert junctions.count() == modules.agg(F.sum("n_connections")).first()[0] > 400
    modules.collect()
    assert max(_rows_of_joins(modules)) <= 150


def _sorted(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_attributes_of_gtf_lines_are_taken_once(spark):
    texts = ['gene_id "a"; transcript_id "b"; gene_name "n n";', 'gene_id "a";gene_id "b"', '  gene_id   "x" ; y', "gene_id", "gene_id ;gene_type", 'gene_idx "q"; ref_gene_id "z"', 'gene_id "t"; a', 'x gene_id "q"', 'gene_id ""; z', "", '; ;gene_id "k" ;;', 'gene_id "1"; gene_id', 'gene_id "v"w"', 'gene_id "; gene_type "']
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    lines = rows.select("v", F.concat_ws("\t", F.lit("chr1"), F.lit("s"), F.lit("exon"), F.lit("1"), F.lit("9"), F.lit("."), F.lit("+"), F.lit("."), "v").alias("value"))
    for key in ("gene_id", "gene_type"):
        want = [r.want for r in rows.select(F.try_element_at(Q.attributes(F.col("v")), F.lit(key)).alias("want")).collect()]
        assert [r[key] for r in gtf_rows(lines).collect()] == want
    plan = _plan(gene_models(gtf_rows(lines))[0])
    assert "lambda" not in plan and plan.count("LogicalRDD") == 1


def test_exons_of_a_gene_meet_before_introns_of_all(spark):
    exons = spark.createDataFrame([(f"g{g}", "chr1", "+", 100 * k, 100 * k + 50) for g in range(30) for k in range(4)], "gene_id string, chrom string, strand string, start bigint, end bigint")
    introns = spark.createDataFrame([("chr1", "+", 100 * k + 50, 500 + m) for k in range(4) for m in range(200)] + [("chr1", "+", 50, 100), ("chr1", "+", 50, 300)], "chrom string, strand string, start bigint, end bigint")
    edges = N.frame_graph(exons, introns)
    got = {(r.gene_id, r.up_start, r.frame, r.down_start, r.next_frame) for r in edges.collect()}
    assert got == {(f"g{g}", 0, f, d, (f + d - 50) % 3) for g in range(30) for f in range(3) for d in (100, 300)}
    assert max(_rows_of_joins(edges)) <= 30 * 16


def test_only_changed_labels_spread_again(spark, monkeypatch):
    made = []
    monkeypatch.setattr(G, "written", lambda df, *name: made.append(kept(df, *name)) or made[-1])
    path = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(k + 1, k) for k in range(30)] + [(50, None), (7, 7)], "a bigint, b bigint")
    assert {r.v: r.root for r in G.components(path).collect()} == {k: 0 for k in range(31)}
    changed = [t.filter("old <> root").count() for t in made[1:]]
    assert changed[0] > 0 and changed[-1] == 0


def test_junctions_meet_the_transcripts_of_their_gene(spark):
    rng = random.Random(3)
    models = {(f"g{t % 7}", f"t{t}"): sorted((s, s + rng.choice([4, 7, 7, 10])) for s in rng.choices(range(0, 120, 6), k=rng.randrange(1, 6))) for t in range(60)}
    junctions = sorted({(f"g{rng.randrange(8)}", a, b) for a in range(120) for b in range(a + 1, 130) if rng.random() < 0.2})
    want = []
    for gene, start, end in junctions:
        for (own, tx), x in models.items():
            i = next((i for i in range(len(x) - 1) if x[i][1] == start or x[i + 1][0] == end), None)
            if own != gene or i is None:
                continue
            donor, acceptor = x[i][1] == start, x[i + 1][0] == end
            k, new = (i + 1, (end, x[i + 1][1])) if donor else (i, (x[i][0], start))
            if donor and acceptor or new[0] < new[1]:
                want.append((start, end, gene, tx, None if donor and acceptor else k, *new))
    models = spark.createDataFrame([(g, t, "chr1", "+", x) for (g, t), x in models.items()], "gene_id string, transcript_id string, chrom string, strand string, exons array<struct<start:bigint,end:bigint>>")
    junctions = spark.createDataFrame([("chr1", s, e, "+", g) for g, s, e in junctions], "chrom string, start bigint, end bigint, strand string, gene_id string")
    made = N.substituted(junctions, models).select("start", "end", "gene_id", "transcript_id", "k", "new_start", "new_end")
    assert _sorted(made) == sorted(want, key=str) and len(want) > 100
    # both sides are dealt once, by gene; the slices of few exons are broadcast
    bases = "".join(rng.choices("ACGT", k=200))
    tiles = Q.genome_tiles(spark.createDataFrame([("chr1", bases)], "chrom string, seq string"))
    plan = N.classify_nmd(junctions, models, tiles)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(") <= 6, plan.count("Exchange hashpartitioning(")
