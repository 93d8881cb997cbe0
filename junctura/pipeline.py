"""The whole analysis: reads and gene models in, tables of tested modules out.

Plans are keyed by place; the barriers are the rounds of connected components and the
false-discovery rate.  What several results use is written to the shared folder between stages,
so plans stay short and a lost executor costs part of a stage.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.sequence import with_motif
from .operators import diagnostics as D
from .operators import differential as T
from .operators import events as E
from .operators import graph as G
from .operators import junctions as J
from .operators import modules as M
from .operators import nmd as N
from .operators import psi as P
from .operators import reads as R
from .stages import resumed, written


@dataclass
class Settings:
    min_anchor: int = 6
    min_mapq: int = 0
    min_cluster_reads: int = 30
    max_intron: int = 100_000
    read_length: int = 101
    replicates: int = P.REPLICATES
    seed: int | None = None
    df_mode: str = "groups"
    novel: bool = True
    exclusive_types: bool = False
    het: bool = True
    nmd: bool = True


@dataclass
class Results:
    evidence: DataFrame  # a row a junction
    modules: DataFrame
    module_junctions: DataFrame
    cells: DataFrame
    psi: DataFrame
    bootstrap: DataFrame
    events: DataFrame
    diff: DataFrame
    diagnostics: DataFrame
    het: DataFrame | None
    nmd: DataFrame | None


def score(counts: DataFrame, known: DataFrame, n_samples: int, tiles: DataFrame | None) -> DataFrame:
    """Junctions with vectors, annotation, motif and confidence; without a genome motifs score 0."""
    rows = J.annotate(J.vectors(counts, n_samples), known)
    if tiles is None:
        rows = rows.withColumns({"motif": F.lit("NA"), "motif_score": F.lit(0.0)})
    else:
        rows = with_motif(rows, tiles)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    rows = rows.withColumns({"mapq_total": total("sample_mapq"), "total_reads": total("sample_counts")})
    return J.confidence(rows, n_samples).withColumn("mean_mapq", F.col("mapq_total") / n_samples)


def _paths(reads: DataFrame, junctions: DataFrame, s: Settings) -> tuple[DataFrame | None, DataFrame | None]:
    """Exclusive pairs and coordinated groups, if types are to depend on them."""
    if not s.exclusive_types:
        return None, None
    edges = written(G.cooccurrence(R.pair_counts(reads, s.min_anchor, s.min_mapq), junctions), "edges")
    return G.exclusive_pairs(junctions, edges), G.coordinated_groups(junctions, edges)


def analyse(reads: DataFrame, genes: DataFrame, exons: DataFrame, labels: Mapping[int, int], tiles: DataFrame | None = None, covariates: Mapping[int, Sequence[float]] | None = None, settings: Settings | None = None, checkpoint: str | None = None, counts: DataFrame | None = None) -> Results:
    """`labels` gives each sample's group, 0 or 1; samples are numbered from 0.

    `counts` are the reads' junction counts where a source has made them (sources.alignments.bam_junction_counts);
    the reads are then read for exclusive types only.  With `checkpoint`, a folder that belongs to these inputs and settings alone, stages that an
    earlier run finished there are read and not made again.
    """
    s = settings or Settings()
    n = max(labels) + 1

    def stage(name: str, make: Callable[[], DataFrame]) -> DataFrame:
        return resumed(reads.sparkSession, f"{checkpoint}/{name}", make) if checkpoint else written(make(), name)

    known = J.known_junctions(exons)
    made = counts
    counts = stage("counts", lambda: R.junction_counts(reads, s.min_anchor, s.min_mapq) if made is None else made)
    evidence = stage("evidence", lambda: score(counts, known, n, tiles))
    if not s.novel:
        evidence = evidence.filter("is_annotated")

    def clustered() -> DataFrame:
        strong = J.with_enough_reads(counts, s.min_cluster_reads).join(evidence.select(*J.KEY), J.KEY, "left_semi")
        return G.cluster_junctions(strong, s.max_intron)

    members = stage("members", clustered) if checkpoint else clustered()
    built = M.build_modules(G.clusters(members), members, genes)
    modules, junctions = stage("modules", lambda: built[0]), stage("module-junctions", lambda: built[1])
    cells = stage("cells", lambda: M.evidence(junctions, J.per_sample(counts), n, evidence.select(*J.KEY, "composite_score", "is_annotated"), s.read_length))
    boot = stage("bootstrap", lambda: P.bootstrap(cells, s.replicates, s.seed))
    shares = P.with_psi(cells)
    kinds = stage("events", lambda: E.classify(junctions, *_paths(reads, junctions, s)))
    names = modules.select("module_id", "gene_id", "gene_name", "chrom", "strand", "start", "end")

    def tested() -> DataFrame:
        rows = T.differential(cells, labels, boot, covariates, df_mode=s.df_mode)
        return rows.join(kinds.select("module_id", "event_type"), "module_id").join(names, "module_id")

    diff = stage("diff", tested)

    def figures() -> DataFrame:
        fits = diff.select("module_id", "null_converged", "full_converged", "null_refit_used")
        return D.diagnose(D.quality(cells).join(D.bootstrap_cv(boot), "module_id").join(fits, "module_id"))

    het = None
    if s.het:
        het = T.heterogeneous(shares, labels).join(kinds.select("module_id", "event_type"), "module_id").join(names.select("module_id", "gene_id", "gene_name"), "module_id")
    nmd = None
    if s.nmd and tiles is not None:
        nmd = N.classify_nmd(junctions.filter("gene_id <> ''"), N.transcripts(exons), tiles)
    return Results(evidence, modules, junctions, cells, shares, boot, kinds, diff, stage("diagnostics", figures), het, nmd)
