"""Queries on sequences, names and attributes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as Q
from ..operators import nmd as N
from ..sources.annotation import gene_models, gtf_rows
from ..stages import written
from . import base as B
from .relational import _TX, exons

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_HEX, _BASES = "0123456789abcdef", "ACGTACGTACGTACGT"
_SEQ_SQL = f"sq AS (SELECT p_partkey AS id, translate(md5(p_partkey::VARCHAR || 'a') || md5(p_partkey::VARCHAR || 'b'), '{_HEX}', '{_BASES}') AS seq FROM part)"
_GENOME_SQL = f"gn AS (SELECT 'chr' || (n_nationkey % 3 + 1) AS chrom, string_agg(translate(md5('g' || n_nationkey), '{_HEX}', '{_BASES}'), '' ORDER BY n_nationkey) AS seq FROM nation GROUP BY 1)"


def sequences(spark, sf):
    md5 = lambda salt: F.md5(F.concat(F.col("p_partkey").cast("string"), F.lit(salt)))
    return B.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.translate(F.concat(md5("a"), md5("b")), _HEX, _BASES).alias("seq"))


def genome(spark, sf):
    piece = F.struct("n_nationkey", F.translate(F.md5(F.concat(F.lit("g"), F.col("n_nationkey").cast("string"))), _HEX, _BASES).alias("s"))
    rows = B.table(spark, sf, "nation").groupBy(F.concat(F.lit("chr"), F.col("n_nationkey") % 3 + 1).alias("chrom")).agg(F.sort_array(F.collect_list(piece)).alias("p"))
    return rows.select("chrom", F.array_join(F.transform("p", lambda x: x["s"]), "").alias("seq"))


@query("sequence_reverse_complement", f"WITH {_SEQ_SQL} SELECT id, translate(reverse(regexp_replace(upper(substr(seq, 1, 40) || 'xn'), '[^ACGT]', 'N', 'g')), 'ACGT', 'TGCA') AS rc FROM sq")
def reverse_complement(spark, sf):
    return sequences(spark, sf).select("id", Q.reverse_complement(F.concat(F.substring("seq", 1, 40), F.lit("xn"))).alias("rc"))


_CLASS = "CASE WHEN m IN ('GT/AG', 'GC/AG', 'AT/AC') THEN m WHEN r IN ('GT/AG', 'GC/AG', 'AT/AC') THEN r ELSE 'non-canonical' END"


@query(
    "motif_class_score",
    f"""WITH {_SEQ_SQL}, m AS (SELECT id, substr(seq, 1, 2) || '/' || substr(seq, 3, 2) AS m, translate(reverse(substr(seq, 1, 2)), 'ACGT', 'TGCA') || '/' || translate(reverse(substr(seq, 3, 2)), 'ACGT', 'TGCA') AS r FROM sq), c AS (SELECT id, {_CLASS} AS motif FROM m)
SELECT id, motif, CASE motif WHEN 'GT/AG' THEN 1.0::DOUBLE WHEN 'GC/AG' THEN 0.8::DOUBLE WHEN 'AT/AC' THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS score FROM c""",
)
def motif_class(spark, sf):
    rows = sequences(spark, sf).select("id", Q.motif_class(F.substring("seq", 1, 2), F.substring("seq", 3, 2)).alias("motif"))
    return rows.withColumn("score", Q.motif_score(F.col("motif")))


@query(
    "motif_from_genome",
    f"""WITH {_GENOME_SQL}, j AS (SELECT DISTINCT 'chr' || (l_suppkey % 3 + 1) AS chrom, l_partkey % 200 AS s, l_partkey % 200 + 4 + l_linenumber AS e, CASE WHEN l_linestatus = 'F' THEN '+' ELSE '-' END AS strand FROM lineitem),
x AS (SELECT j.*, substr(seq, s + 1, 2) AS f, substr(seq, e - 1, 2) AS l FROM j JOIN gn USING (chrom)), y AS (SELECT *, CASE strand WHEN '+' THEN f ELSE l END AS d, CASE strand WHEN '+' THEN l ELSE f END AS a FROM x),
z AS (SELECT *, d || '/' || a AS m, translate(reverse(d), 'ACGT', 'TGCA') || '/' || translate(reverse(a), 'ACGT', 'TGCA') AS r FROM y)
SELECT chrom, s AS start, e AS "end", strand, d AS donor_bases, a AS acceptor_bases, {_CLASS} AS motif FROM z""",
)
def motif_from_genome(spark, sf):
    s = F.col("l_partkey") % 200
    js = B.table(spark, sf, "lineitem").select(F.concat(F.lit("chr"), F.col("l_suppkey") % 3 + 1).alias("chrom"), s.alias("start"), (s + 4 + F.col("l_linenumber")).alias("end"), F.when(F.col("l_linestatus") == "F", "+").otherwise("-").alias("strand")).distinct()
    return Q.with_motif(js, Q.genome_tiles(genome(spark, sf), 64), 64).drop("motif_score")


@query(
    "genome_slices",
    f"""WITH {_GENOME_SQL}, j AS (SELECT 'chr' || (l_suppkey % 3 + 1) AS chrom, l_partkey % 150 AS s, l_partkey % 150 + l_linenumber * 15 AS e FROM lineitem)
SELECT chrom, s AS x_start, e AS x_end, substr(seq, s + 1, e - s) AS x FROM j JOIN gn USING (chrom)""",
)
def slices(spark, sf):
    """A slice for each line item, repeated places and all."""
    s = F.col("l_partkey") % 150
    places = B.table(spark, sf, "lineitem").select(F.concat(F.lit("chr"), F.col("l_suppkey") % 3 + 1).alias("chrom"), s.alias("x_start"), (s + F.col("l_linenumber") * 15).alias("x_end"))
    return Q.genome_slices(places, Q.genome_tiles(genome(spark, sf), 64), "x", 64)


@query(
    "sequence_stop_codon",
    f"""WITH {_SEQ_SQL}, f AS (SELECT id, seq, instr(seq, 'ATG') - 1 AS atg FROM sq WHERE instr(seq, 'ATG') > 0)
SELECT id, atg, (SELECT min(i) FROM range(atg, length(seq) - 2, 3) t(i) WHERE substr(seq, i + 1, 3) IN ('TAA', 'TAG', 'TGA')) AS stop FROM f""",
)
def stop_codon(spark, sf):
    rows = sequences(spark, sf).withColumn("atg", F.instr("seq", "ATG") - 1).filter("atg >= 0")
    return rows.select("id", "atg", Q.stop_codon(F.col("seq"), F.col("atg")).alias("stop"))


@query("ejc_positions", f"WITH {_TX}, w AS (SELECT g, tx, sum(e - s) OVER (PARTITION BY g, tx ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS ejc, sum(e - s) OVER (PARTITION BY g, tx) AS whole FROM t) SELECT g::VARCHAR AS gene_id, tx::VARCHAR AS transcript_id, ejc FROM w WHERE ejc < whole")
def ejc(spark, sf):
    return N.ejc_positions(exons(spark, sf))


@query(
    "nmd_classes",
    f"""WITH {_GENOME_SQL}, {_TX},
ex AS (SELECT *, row_number() OVER (PARTITION BY g, tx, chrom ORDER BY s, e) - 1 AS k FROM (SELECT g, tx, chrom, s // 8 AS s, e // 8 AS e FROM t)),
intr AS (SELECT u.g, u.tx, u.chrom, u.k, u.e AS d, v.s AS a FROM ex u JOIN ex v ON v.g = u.g AND v.tx = u.tx AND v.chrom = u.chrom AND v.k = u.k + 1),
js AS (SELECT DISTINCT chrom, d AS s, a AS e, g FROM intr WHERE a > d),
hit AS (SELECT js.*, tx, k FROM js JOIN intr ON intr.g = js.g AND intr.chrom = js.chrom AND d = js.s UNION SELECT js.*, tx, k FROM js JOIN intr ON intr.g = js.g AND intr.chrom = js.chrom AND a = js.e),
mk AS (SELECT chrom, s, e, g, tx, min(k) AS i FROM hit GROUP BY ALL),
pl AS (SELECT mk.*, d, a FROM mk JOIN intr ON intr.g = mk.g AND intr.tx = mk.tx AND intr.chrom = mk.chrom AND intr.k = mk.i),
ch AS (
  SELECT pl.chrom, pl.s AS js, pl.e AS je, pl.g, pl.tx, CASE WHEN pl.s = d AND pl.e <> a AND ex.k = i + 1 THEN pl.e ELSE ex.s END AS s, CASE WHEN pl.s <> d AND ex.k = i THEN pl.s ELSE ex.e END AS e
  FROM pl JOIN ex ON ex.g = pl.g AND ex.tx = pl.tx AND ex.chrom = pl.chrom),
cut AS (SELECT ch.*, coalesce(substr(seq, s + 1, e - s), '') AS b FROM ch LEFT JOIN gn USING (chrom)),
sp AS (SELECT chrom, js, je, g, tx, string_agg(b, '' ORDER BY s, b) AS mrna, CASE WHEN count(*) > 1 THEN sum(e - s) - last(e - s ORDER BY s, b) END AS last_ejc FROM cut GROUP BY ALL HAVING bool_and(s < e AND b <> '')),
fr AS (SELECT *, instr(mrna, 'ATG') - 1 AS atg FROM sp WHERE instr(mrna, 'ATG') > 0),
st AS (SELECT *, (SELECT min(i) FROM range(atg, length(mrna) - 2, 3) r(i) WHERE substr(mrna, i + 1, 3) IN ('TAA', 'TAG', 'TGA')) AS stop FROM fr),
rd AS (SELECT *, coalesce(last_ejc - stop > 55, false) AS early FROM st),
n AS (SELECT chrom, js, je, g, count_if(NOT early) AS good, count_if(early) AS bad, min(stop) FILTER (early) AS ptc, arg_max(last_ejc, tx::VARCHAR) FILTER (stop IS NOT NULL AND last_ejc IS NOT NULL) AS last FROM rd GROUP BY ALL)
SELECT js.chrom, js.s AS start, js.e AS "end", '+' AS strand, js.g::VARCHAR AS gene_id, coalesce(good, 0) AS n_productive_paths, coalesce(bad, 0) AS n_unproductive_paths, ptc AS ptc_position, last::BIGINT AS last_ejc_position,
  CASE WHEN coalesce(good + bad, 0) = 0 THEN 'NE' WHEN good > 0 THEN 'PR' ELSE 'UP' END AS classification, CASE WHEN coalesce(good + bad, 0) = 0 THEN 'nan'::DOUBLE ELSE good / (good + bad)::DOUBLE END AS confidence
FROM js LEFT JOIN n ON n.chrom = js.chrom AND n.js = js.s AND n.je = js.e AND n.g = js.g""",
)
def nmd_classes(spark, sf):
    """Junctions in synthetic transcripts over the genome."""
    some = exons(spark, sf)
    scaled = some.withColumns({"start": (F.col("start") / 8).cast("bigint"), "end": (F.col("end") / 8).cast("bigint")})
    models = written(N.transcripts(scaled), "models")
    return N.classify_nmd(N.introns(models), models, Q.genome_tiles(genome(spark, sf), 64), 64)


@query("gene_id_normalise", """WITH g AS (SELECT CASE WHEN p_partkey % 3 = 0 THEN '"ENSG' || p_partkey || '.' || p_size || '"' WHEN p_partkey % 3 = 1 THEN 'ENSG' || p_partkey ELSE p_brand || '.' || p_size END AS id FROM part) SELECT id, CASE WHEN starts_with(trim(id, '"'), 'ENSG') THEN split_part(trim(id, '"'), '.', 1) ELSE trim(id, '"') END AS gene FROM g""")
def gene_ids(spark, sf):
    k = F.col("p_partkey")
    raw = F.when(k % 3 == 0, F.concat(F.lit('"ENSG'), k, F.lit("."), F.col("p_size"), F.lit('"'))).when(k % 3 == 1, F.concat(F.lit("ENSG"), k)).otherwise(F.concat("p_brand", F.lit("."), F.col("p_size")))
    return B.table(spark, sf, "part").select(raw.alias("id")).select("id", Q.gene_key(F.col("id")).alias("gene"))


@query("text_names", "SELECT p_partkey, regexp_replace(p_name || '/' || p_brand, '[^A-Za-z0-9]', '_', 'g') AS safe, p_name AS sample, printf('%06d', p_partkey) AS padded, printf('%.4f', p_retailprice) AS price FROM part")
def text_names(spark, sf):
    path = F.concat(F.lit("/data/"), "p_brand", F.lit("/"), "p_name", F.lit(".bam"))
    return B.table(spark, sf, "part").select("p_partkey", Q.safe_name(F.concat("p_name", F.lit("/"), "p_brand")).alias("safe"), Q.sample_name(path).alias("sample"), F.format_string("%06d", "p_partkey").alias("padded"), F.format_string("%.4f", "p_retailprice").alias("price"))


@query("json_fields", "SELECT event_id, (props->>'$.k')::BIGINT AS k, to_json({'id': event_id, 'type': event_type}) AS doc FROM events")
def json_fields(spark, sf):
    return B.table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("doc"))


@query(
    "gtf_gene_models",
    """WITH r AS (SELECT o_custkey AS g, o_orderkey AS tx, 'chr' || (o_custkey % 3 + 1) AS chrom, l_linenumber * 500 + l_partkey % 50 AS s, CASE o_custkey % 4 WHEN 0 THEN 'lncRNA' WHEN 1 THEN '' ELSE 'protein_coding' END AS kind FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT g::VARCHAR AS gene_id, 'N' || g AS gene_name, chrom, '+' AS strand, min(s) AS start, max(s) + 80 AS "end" FROM r WHERE kind <> 'lncRNA' GROUP BY g, chrom""",
)
def gtf_models(spark, sf):
    joined = B.table(spark, sf, "orders").join(B.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = F.col("l_linenumber") * 500 + F.col("l_partkey") % 50
    kind = F.when(F.col("o_custkey") % 4 == 0, 'gene_type "lncRNA";').when(F.col("o_custkey") % 4 == 1, "").otherwise('gene_type "protein_coding";')
    attributes = F.concat(F.lit('gene_id "'), F.col("o_custkey"), F.lit('"; transcript_id "'), F.col("o_orderkey"), F.lit('"; gene_name "N'), F.col("o_custkey"), F.lit('"; '), kind)
    lines = joined.select(F.concat_ws("\t", F.concat(F.lit("chr"), F.col("o_custkey") % 3 + 1), F.lit("src"), F.lit("exon"), s + 1, s + 80, F.lit("."), F.lit("+"), F.lit("."), attributes).alias("value"))
    return gene_models(gtf_rows(lines))[0]
