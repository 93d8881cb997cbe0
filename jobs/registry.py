"""The jobs as queries: each runs twice into a new folder and returns its whole output."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from jobs import contig_index, junction_ledger
from jobs.common import config
from junctura.plans.base import JUNCTIONS_SQL
from junctura.stages import shared_folder


def job1_junction_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as reads; the second run finds nothing new.  A pattern, as a file stream takes folders and patterns but no path of one file."""
    folder = f"{shared_folder(spark)}/job1-{uuid.uuid4().hex}"
    conf = config("lineitem_reads.json", junction_ledger.DEFAULTS)
    for _ in range(2):
        junction_ledger.run(spark, f"{sf_dir}/lineitem.parque[t]", f"{folder}/junctions", f"{folder}/mark", conf)
    return junction_ledger.read_counts(spark, f"{folder}/junctions")


def job2_contig_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sequence texts, languages as assemblies; the second run overwrites what the first wrote."""
    folder = f"{shared_folder(spark)}/job2-{uuid.uuid4().hex}"
    conf = config("documents_contigs.json", contig_index.DEFAULTS)
    for _ in range(2):
        contig_index.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/index", conf)
    return contig_index.read_index(spark, f"{folder}/index")


QUERIES = {"job1_junction_ledger": job1_junction_ledger, "job2_contig_index": job2_contig_index}
SQL = {
    "job1_junction_ledger": f"""WITH {JUNCTIONS_SQL}
SELECT chrom, s AS start, e AS "end", strand, sample_idx::INTEGER AS sample_idx, count(*) AS counts, sum(mapq)::DOUBLE AS mapq_sum, sum(mapq * mapq)::DOUBLE AS mapq_sq_sum, sum(coalesce(nh, 1))::DOUBLE AS nh_sum, count(*) AS n, max(greatest(la, ra)) AS max_anchor
FROM jf GROUP BY chrom, s, e, strand, sample_idx""",
    "job2_contig_index": r"""WITH d AS (
  SELECT doc_id::VARCHAR AS contig, nullif(lang, '') AS assembly, regexp_replace(translate(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'), 'acgt', 'ACGT'), '[^ACGT]', 'N', 'g') AS seq FROM documents),
t AS (SELECT *, unnest(range((length(seq) - 1) // 1024 + 1)) AS tile FROM d WHERE seq <> ''),
s AS (SELECT *, tile * 1024 AS start, substr(seq, tile * 1024 + 1, 1024) AS own, substr(seq, tile * 1024 + 1, 1025) AS bases, substr(seq, tile * 1024 + 1, 1026) AS codons FROM t)
SELECT contig, tile::INTEGER AS tile, start, start + length(own) AS "end", bases, length(regexp_replace(own, 'N', '', 'g')) AS acgt, length(regexp_replace(own, '[NAT]', '', 'g')) AS gc,
  len(regexp_extract_all(bases, 'GT|GC|AT')) AS donors, len(regexp_extract_all(bases, 'AC|AG')) AS acceptors, len(regexp_extract_all(codons, 'TAA|TAG|TGA')) AS stops, assembly FROM s""",
}
