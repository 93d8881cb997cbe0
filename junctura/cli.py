"""Command line: run, quantify, annotate, export, qc, compare, sashimi, evaluate."""

from __future__ import annotations

import argparse
import hashlib
import os
import re
import sys
from collections import defaultdict
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import __version__
from .operators import compare as C
from .operators import junctions as J
from .operators import reads as R
from .pipeline import Results, Settings, analyse
from .session import session
from .sinks import drawings as D
from .sinks import exports as X
from .sinks import report as H
from .sinks import tables as S
from .sinks.pdf import pdf_report
from .sinks.workbook import results_workbook
from .sources import alignments as A
from .sources import annotation as G
from .sources import tool_tables as T
from .stages import resumed, written


def sample_name(path: str) -> str:
    return re.sub(r"\.(bam|sam)$", "", os.path.basename(path))


def parse_labels(n: int, group1: str, group2: str) -> dict[int, int]:
    """Samples in group2 are 1, all others 0, also those in neither list."""
    ones = {int(x) for x in group2.split(",") if x.strip()}
    listed = ones | {int(x) for x in group1.split(",") if x.strip()}
    if rest := sorted(set(range(n)) - listed):
        print(f"samples {rest} are in neither group and count as group 1", file=sys.stderr)
    if max(listed, default=0) >= n:
        raise SystemExit(f"there are {n} samples; indices begin at 0")
    return {i: int(i in ones) for i in range(n)}


def read_covariates(path: str, names: list[str]) -> dict[int, list[float]]:
    """Numeric columns of a table with a `sample` column; texts become one column a category but the last."""
    with open(path) as f:
        head, *rows = [line.rstrip("\n").split("\t") for line in f if line.strip()]
    at = head.index("sample")
    by_name = {r[at]: r for r in rows}
    if missing := [n for n in names if n not in by_name]:
        raise SystemExit(f"no covariates for {missing}")
    out: dict[int, list[float]] = {i: [] for i in range(len(names))}
    for k in range(len(head)):
        if k == at:
            continue
        values = [by_name[n][k] for n in names]
        try:
            columns = [[float(v) for v in values]]
        except ValueError:
            columns = [[float(v == c) for v in values] for c in sorted(set(values))[:-1]]
        for column in columns:
            for i, v in enumerate(column):
                out[i].append(v)
    return out


def _form(paths: list[str]) -> str:
    return "parquet" if all(p.endswith(".parquet") for p in paths) else "sam" if paths[0].endswith(".sam") else "bam"


def load_reads(spark, paths: list[str], regions: list[tuple[str, int, int]] | None = None) -> DataFrame:
    """Reads of the files; with regions at least those that overlap one, and of an indexed BAM file no others are read."""
    if _form(paths) == "bam":
        return A.read_bam(spark, paths, regions=regions)
    rows = spark.read.schema(R.READS).parquet(*paths) if _form(paths) == "parquet" else A.read_sam(spark, paths)
    if regions is None:
        return rows
    before = [(F.col("chrom") == c) & (F.col("pos") < hi) for c, _, hi in regions]
    return rows.filter(reduce(lambda a, b: a | b, before, F.lit(False)))


def write_results(res: Results, out: str, formats: set[str], samples: dict | None = None, parameters: dict | None = None) -> None:
    diff, diag = res.diff, res.diagnostics
    S.write_tsv(S.results_table(diff, diag), f"{out}/results.tsv", order=["module_id"])
    genes = res.module_junctions.select(*J.KEY, "gene_id", "gene_name").dropDuplicates(J.KEY)
    S.write_tsv(S.junction_details(res.evidence.join(genes, J.KEY, "left"), res.nmd), f"{out}/junctions.tsv", order=["junction_id"])
    S.write_tsv(S.summary_table(diff, diag).drop("ord"), f"{out}/summary.tsv")
    export(diff, res, out, formats)
    if "xlsx" in formats:
        results_workbook(f"{out}/results.xlsx", diff, diag, res.evidence)
    if "pdf" in formats:
        pdf_report(f"{out}/report.pdf", f"{out}/figures", diff, diag, samples, parameters)
    with open(f"{out}/report.html", "w") as f:
        f.write(H.html_report(diff, diag, res.evidence, res.het, res.nmd))


def export(diff: DataFrame, res: Results | None, out: str, formats: set[str]) -> None:
    tables = {"rmats": X.rmats_format, "leafcutter": X.leafcutter_format}
    for name in formats & set(tables):
        S.write_tsv(tables[name](diff), f"{out}/{name}.tsv", order=[{"rmats": "ID", "leafcutter": "cluster"}[name]])
    if "bed" in formats:
        S.write_tsv(X.bed_format(diff), f"{out}/junctions.bed", header=False, order=["chrom", "start", "end", "name"])
    if "gtf" in formats:
        S.write_tsv(X.gtf_format(diff), f"{out}/events.gtf", header=False, order=["chrom", "start", "end", "attributes"])
    if "majiq" in formats:
        X.majiq_format(diff).select("json").write.mode("overwrite").text(f"{out}/lsv")
        if res is not None:
            X.psi_documents(res.psi, res.bootstrap).select("json").write.mode("overwrite").text(f"{out}/psi")


def cmd_run(a, spark) -> None:
    names = a.sample_names or [sample_name(p) for p in a.bam]
    labels = parse_labels(len(a.bam), a.group1, a.group2)
    genes, exons = G.read_gtf(spark, a.gtf, a.gene_type)
    tiles = G.read_genome(spark, a.genome) if a.genome else None
    covariates = read_covariates(a.covariates, names) if a.covariates else None
    settings = Settings(a.min_anchor, a.min_mapq, a.min_cluster_reads, a.max_intron_length, a.read_length, a.n_bootstraps, a.seed, a.df_mode, not a.no_novel, not a.no_het, not a.no_nmd)
    os.makedirs(a.output_dir, exist_ok=True)
    reads, stages = load_reads(spark, a.bam), None
    if a.checkpoint_dir:
        own = lambda *of: hashlib.sha256(repr(of).encode()).hexdigest()[:16]
        if _form(a.bam) == "sam":  # text is parsed once
            source = reads
            reads = resumed(spark, f"{a.checkpoint_dir}/reads-{own(a.bam)}", lambda: source)
        stages = f"{a.checkpoint_dir}/analysis-{own(a.bam, a.gtf, a.genome, a.gene_type, labels, covariates, settings)}"
    counts = A.bam_junction_counts(spark, a.bam, settings.min_anchor, settings.min_mapq) if _form(a.bam) == "bam" else None
    res = analyse(reads, genes, exons, labels, tiles, covariates, settings, stages, counts)
    write_results(res, a.output_dir, set(a.export or []), {n: f"group {labels[k] + 1}" for k, n in enumerate(names)}, vars(settings))
    S.save_stage(res.diff, f"{a.output_dir}/diff.parquet")
    S.save_stage(res.diagnostics, f"{a.output_dir}/diagnostics.parquet")
    S.save_evidence(res.evidence, f"{a.output_dir}/evidence.parquet")
    if res.het is not None:
        S.save_stage(res.het, f"{a.output_dir}/het.parquet")


def cmd_quantify(a, spark) -> None:
    """Usage of each junction in each sample, with intervals and no test."""
    genes, exons = G.read_gtf(spark, a.gtf, a.gene_type)
    labels = {i: 0 for i in range(len(a.bam))}
    res = analyse(load_reads(spark, a.bam), genes, exons, labels, settings=Settings(het=False, nmd=False))
    S.save_stage(res.psi.join(res.bootstrap.drop("replicates"), ["module_id", "j_idx", "sample_idx"]), f"{a.output_dir}/psi.parquet")


def cmd_annotate(a, spark) -> None:
    """Junction evidence with known introns and, with a genome, motifs."""
    _, exons = G.read_gtf(spark, a.gtf, a.gene_type)
    rows = J.annotate(spark.read.parquet(a.evidence).drop("is_annotated"), J.known_junctions(exons))
    if a.genome:
        from .functions.sequence import with_motif

        rows = with_motif(rows.drop("motif", "motif_score", "donor_bases", "acceptor_bases"), G.read_genome(spark, a.genome))
    S.save_stage(rows, a.output)


def cmd_export(a, spark) -> None:
    export(spark.read.parquet(f"{a.results}/diff.parquet"), None, a.output_dir, set(a.format))


def cmd_qc(a, spark) -> None:
    read = lambda n: spark.read.parquet(f"{a.results}/{n}.parquet")
    with open(a.output, "w") as f:
        f.write(H.html_report(read("diff"), read("diagnostics"), read("evidence"), read("het") if T.exists(spark, f"{a.results}/het.parquet") else None))


def cmd_compare(a, spark) -> None:
    tables = [T.own_results(spark, a.results)]
    tables += [T.rmats_results(spark, a.rmats)] if a.rmats else []
    tables += [T.majiq_results(spark, a.majiq)] if a.majiq else []
    tables += [T.suppa2_results(spark, a.suppa2)] if a.suppa2 else []
    everything = tables[0]
    for t in tables[1:]:
        everything = everything.unionByName(t)
    everything = written(everything, "tools")
    S.write_tsv(C.concordance(everything), f"{a.output_dir}/concordance.tsv")
    S.write_tsv(C.exclusive_intersections(everything, 15), f"{a.output_dir}/intersections.tsv")
    S.write_tsv(C.jaccard_matrix(everything), f"{a.output_dir}/jaccard.tsv")
    names = sorted(r.tool for r in everything.select("tool").distinct().collect())
    likeness = {(r.tool_a, r.tool_b): r.jaccard for r in C.jaccard_matrix(everything).collect()}
    shared = [(r.tools.split("&"), r.n) for r in C.exclusive_intersections(everything, 15).collect()]
    drawings = {"jaccard": D.heat_map(names, likeness), "intersections": D.intersections(names, shared)}
    if len(names) <= 4:
        drawings["venn"] = D.venn(names, shared)  # of four tools there are fifteen intersections at most
    for t in tables[1:]:
        tool = t.first()
        if tool is not None:
            matched = written(C.match_by_gene(tables[0], t, tool.tool), "matched")
            S.write_tsv(matched, f"{a.output_dir}/matched-{tool.tool}.tsv", order=["gene_id"])
            both = [(r.x, r.y) for r in matched.filter("concordant").selectExpr("own_delta_psi x", f"{tool.tool}_delta_psi y").filter("x is not null and y is not null").collect()]  # a row a gene
            r = C.delta_correlation(matched, tool.tool).first()
            drawings[f"delta-{tool.tool}"] = D.plane(both, "own difference", f"{tool.tool} difference", f"r = {r.r or 0.0:.3f}, n = {r.n}")
    _draw(a.output_dir, drawings)


def _draw(folder: str, drawings: dict[str, str]) -> None:
    for name, drawing in drawings.items():
        with open(f"{folder}/{name}.svg", "w") as f:
            f.write(drawing)


def cmd_sashimi(a, spark) -> None:
    """Depth and arcs of the top events' genes, by group: tables and a drawing."""
    labels = parse_labels(len(a.bam), a.group1, a.group2)
    groups = spark.createDataFrame(sorted(labels.items()), "sample_idx int, label int")
    genes, exons = G.read_gtf(spark, a.gtf, None)
    top = T.read_tsv(spark, a.results).withColumn("fdr", F.col("fdr").cast("double")).orderBy("fdr", "module_id").limit(a.n_top).select("module_id", F.col("gene_id").alias("wanted_id"))
    found = [r for r in G.find_gene(top, genes).collect() if r.gene is not None]  # at most n_top
    around = {r.module_id: (r.gene.chrom, max(0, r.gene.start - 200), r.gene.end + 200) for r in found}
    reads = written(load_reads(spark, a.bam, sorted(set(around.values()))), "reads")
    for row in found:
        name, (chrom, lo, hi) = re.sub(r"[^A-Za-z0-9]", "_", row.module_id), around[row.module_id]
        S.save_stage(H.group_coverage(R.coverage(reads, chrom, lo, hi), groups), f"{a.output_dir}/{name}/coverage")
        S.save_stage(H.arc_heights(H.group_junctions(R.region_junctions(reads, chrom, lo, hi), groups)), f"{a.output_dir}/{name}/arcs")
        depth, arcs = defaultdict(dict), defaultdict(list)
        for r in S.load_stage(spark, f"{a.output_dir}/{name}/coverage").collect():  # a row a base of one gene
            depth[r.label][r.pos] = r.depth
        for r in S.load_stage(spark, f"{a.output_dir}/{name}/arcs").orderBy("start", "end").collect():
            arcs[r.label].append((r.start, r.end, r.n, r.height))
        models = sorted({(r.start, r.end) for r in exons.filter(F.col("gene_id") == row.gene.gene_id).select("start", "end").collect()})
        with open(f"{a.output_dir}/{name}/sashimi.svg", "w") as f:
            f.write(D.sashimi(row.module_id, lo, hi, models, depth, arcs))


def cmd_evaluate(a, spark) -> None:
    metrics = written(C.evaluate(T.own_results(spark, a.results), T.truth_table(T.read_tsv(spark, a.truth)), a.fdr), "metrics")
    S.write_tsv(metrics, f"{a.output_dir}/metrics.tsv")
    published = T.read_tsv(spark, a.published) if a.published else None
    ranking = written(C.rank_tools(metrics, published), "ranking")
    S.write_tsv(ranking, f"{a.output_dir}/ranking.tsv", order=["rank"])
    tools = ranking.orderBy("rank").collect()  # a row a tool
    kinds = [r for r in metrics.collect() if r.level not in ("gene", "event")]
    _draw(a.output_dir, {
        "tools": D.accuracy_plane([(r.tool, r.fdr, r.tpr) for r in tools], "own"),
        "f-scores": D.bars([r.tool for r in tools], {"F-score": [r.f_score for r in tools]}, "own"),
        "types": D.bars([r.level for r in kinds], {"TPR": [r.tpr for r in kinds], "FDR": [r.fdr for r in kinds], "F-score": [r.f_score for r in kinds]}),
    })


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="junctura", description="Junction usage analysis on Spark")
    p.add_argument("--version", action="version", version=__version__)
    p.add_argument("--master", default=None)
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *options: tuple) -> None:
        q = sub.add_parser(name)
        for names, kw in options:
            q.add_argument(*names.split(), **kw)

    need, some = {"required": True}, {"default": None}
    bam = ("--bam -b", {"action": "append", "required": True})
    gtf, kind = ("--gtf -g", need), ("--gene-type", {"default": "protein_coding"})
    groups = [("--group1", need), ("--group2", need)]
    out = ("--output-dir -o", need)
    count = lambda n, d: (n, {"type": int, "default": d})
    flag = lambda n: (n, {"action": "store_true"})
    command(
        "run", bam, ("--sample-names -n", {"action": "append"}), gtf, ("--genome -f", some), *groups, ("--covariates", some), out, count("--read-length -l", 101), count("--min-anchor", 6), count("--min-mapq", 0), count("--min-cluster-reads", 30), count("--max-intron-length", 100_000), count("--n-bootstraps", 30),
        flag("--no-novel"), flag("--no-exon-body"), flag("--no-nmd"), flag("--no-het"), ("--export", {"action": "append", "choices": ["rmats", "leafcutter", "bed", "gtf", "majiq", "xlsx", "pdf"]}), ("--checkpoint-dir", some), ("--seed", {"type": int, "default": None}), ("--df-mode", {"choices": ["groups", "k_minus_1"], "default": "groups"}), kind,
    )
    command("quantify", bam, gtf, kind, out)
    command("annotate", ("--evidence", need), gtf, kind, ("--genome -f", some), ("--output -o", need))
    command("export", ("--results", need), ("--format", {"action": "append", "required": True}), out)
    command("qc", ("--results", need), ("--output -o", need))
    command("compare", ("--results", need), ("--rmats", some), ("--majiq", some), ("--suppa2", some), out)
    command("sashimi", ("--results", need), bam, gtf, *groups, count("--n-top", 20), out)
    command("evaluate", ("--results", need), ("--truth", need), ("--published", some), ("--fdr", {"type": float, "default": 0.05}), out)
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    globals()[f"cmd_{a.command}"](a, session(master=a.master))
    return 0


if __name__ == "__main__":
    sys.exit(main())
