"""Queries on reads, intervals, junctions and graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..operators import intervals as I
from ..operators import junctions as J
from ..operators import modules as M
from ..operators import nmd as N
from ..operators import reads as R
from . import base as B

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query(
    "reads_junction_counts",
    f"""WITH {B.JUNCTIONS_SQL}
SELECT chrom, s AS start, e AS "end", strand, sample_idx, count(*) AS counts, sum(mapq)::DOUBLE AS mapq_sum, sum(mapq * mapq)::DOUBLE AS mapq_sq_sum, sum(coalesce(nh, 1))::DOUBLE AS nh_sum, count(*) AS n, max(greatest(la, ra)) AS max_anchor
FROM jf GROUP BY chrom, s, e, strand, sample_idx""",
)
def junction_counts(spark, sf):
    return R.junction_counts(B.reads(spark, sf))


@query(
    "reads_min_mapq_n_only",
    f"""WITH {B.JUNCTIONS_SQL}
SELECT sample_idx, count(*) AS n, sum(e - s)::BIGINT AS intron_bases FROM (
  SELECT sample_idx, pos + a AS s, pos + a + b AS e FROM good WHERE mapq >= 20 AND a >= 6 AND (CASE WHEN form = 1 THEN c + 16 ELSE c END) >= 6
  UNION ALL SELECT sample_idx, q, q + 60 FROM good WHERE mapq >= 20 AND form = 2 AND c >= 6) GROUP BY sample_idx""",
)
def min_mapq(spark, sf):
    rows = R.read_junctions(B.reads(spark, sf), 6, min_mapq=20, n_only=True)
    return rows.groupBy("sample_idx").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("intron_bases"))


@query(
    "reads_evidence_expressions",
    f"""WITH {B.JUNCTIONS_SQL}
SELECT form, count(*) AS reads, sum(CASE form WHEN 0 THEN 2 WHEN 1 THEN 4 ELSE 3 END)::BIGINT AS blocks, sum((a >= 6 AND c >= 6)::INT + (form > 0 AND c >= 6)::INT)::BIGINT AS junctions, sum((form > 0 AND a >= 6 AND c >= 6)::INT)::BIGINT AS pairs, sum(coalesce(nh, 1))::BIGINT AS nh FROM good GROUP BY form""",
)
def evidence_expressions(spark, sf):
    """The same parsing as columns, with arrays of blocks, junctions and pairs."""
    rows = R.with_evidence(B.reads(spark, sf).repartition("qname"))
    form = F.when(F.col("cigar").startswith("5S"), 2).when(F.col("cigar").contains("D"), 1).otherwise(0)
    return rows.groupBy(form.alias("form")).agg(F.count("*").alias("reads"), F.sum(F.size("blocks")).alias("blocks"), F.sum(F.size("junctions")).alias("junctions"), F.sum(F.size("pairs")).alias("pairs"), F.sum("nh").alias("nh"))


@query(
    "reads_sample_stats",
    f"""WITH {B.JUNCTIONS_SQL},
hit AS (SELECT sample_idx, pos, a, b, c, form, mapq, nh, count(*) AS k FROM jf GROUP BY ALL)
SELECT sample_idx, count(*) AS total_reads, count_if(flag % 8 < 4) AS mapped_reads,
  count_if(ok AND ((a >= 6 AND c >= 6) OR (form > 0 AND c >= 6))) AS junction_reads, count_if(ok AND ((a >= 6 AND c >= 6) OR (form > 0 AND c >= 6)) AND coalesce(nh, 1) > 1) AS multi_mapped_reads,
  avg(mapq) FILTER (flag % 8 < 4) AS mean_mapq, quantile_cont(mapq, 0.5) FILTER (flag % 8 < 4) AS median_mapq
FROM (SELECT *, flag % 8 < 4 AND flag % 512 < 256 AND flag % 1024 < 512 AND flag % 2048 < 1024 AS ok FROM reads) GROUP BY sample_idx""",
)
def sample_stats(spark, sf):
    return R.read_stats(B.reads(spark, sf))


@query(
    "reads_pair_counts",
    f"""WITH {B.JUNCTIONS_SQL}
SELECT chrom, strand, pos + a AS start1, pos + a + b AS end1, q AS start2, CASE form WHEN 1 THEN q + 3 ELSE q + 60 END AS end2, sample_idx, count(*) AS n FROM good WHERE form > 0 AND a >= 6 AND c >= 6 GROUP BY ALL""",
)
def pair_counts(spark, sf):
    return R.pair_counts(B.reads(spark, sf))


@query(
    "reads_coverage",
    f"""WITH {B.JUNCTIONS_SQL}, spans AS (SELECT sample_idx, pos AS s, CASE form WHEN 0 THEN q WHEN 1 THEN q + 16 ELSE q + 69 END AS e FROM good WHERE chrom = 'chr1'),
p AS (SELECT unnest(range(1000, 1600)) AS pos)
SELECT sample_idx, p.pos, count(*) AS depth FROM spans JOIN p ON p.pos >= s AND p.pos < e GROUP BY ALL""",
)
def coverage(spark, sf):
    return R.coverage(B.reads(spark, sf), "chr1", 1000, 1600)


@query(
    "reads_region_junctions",
    f"""WITH {B.JUNCTIONS_SQL} SELECT sample_idx, s AS start, e AS "end", count(*) AS n FROM jf WHERE chrom = 'chr2' AND e >= 900 AND s <= 1500 GROUP BY ALL""",
)
def region_junctions(spark, sf):
    return R.region_junctions(B.reads(spark, sf), "chr2", 900, 1500)


@query(
    "reads_exon_body",
    f"""WITH {B.JUNCTIONS_SQL}, x AS (SELECT s_suppkey AS exon_id, 'chr' || (s_suppkey % 3 + 1) AS chrom, (s_suppkey * 37 % 4000) AS s, (s_suppkey * 37 % 4000) + 350 AS e FROM supplier)
SELECT exon_id, sample_idx, count(*) AS n, round(sum(1.0::DOUBLE / coalesce(nh, 1)), 6) AS weighted
FROM good JOIN x ON good.chrom = x.chrom AND pos >= x.s AND CASE form WHEN 0 THEN q WHEN 1 THEN q + 16 ELSE q + 69 END <= x.e GROUP BY ALL""",
)
def exon_body(spark, sf):
    s = (F.col("s_suppkey") * 37) % 4000
    exons = B.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("exon_id"), F.concat(F.lit("chr"), F.col("s_suppkey") % 3 + 1).alias("chrom"), s.alias("start"), (s + 350).alias("end"))
    return R.exon_body_reads(B.reads(spark, sf), exons).withColumn("weighted", F.round("weighted", 6))


@query(
    "interval_merge_touching",
    f"""WITH {B.INTERVALS_SQL},
m AS (SELECT *, max(e) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM iv),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach THEN 1 ELSE 0 END) OVER (PARTITION BY chrom, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m)
SELECT chrom, strand, min(s) AS start, max(e) AS "end", count(*) AS n FROM g GROUP BY chrom, strand, island""",
)
def merge_touching(spark, sf):
    return I.merge_intervals(B.intervals(spark, sf)).drop("island")


@query("interval_merge_strict", SQL["interval_merge_touching"].replace("s > reach", "s >= reach"))
def merge_strict(spark, sf):
    return I.merge_intervals(B.intervals(spark, sf), touching=False).drop("island")


@query(
    "interval_overlap_join",
    f"""WITH {B.INTERVALS_SQL} SELECT a.chrom, a.strand, a.s AS start, a.e AS "end", b.s AS r_start, b.e AS r_end FROM iv a JOIN iv b ON a.chrom = b.chrom AND a.strand = b.strand AND a.s < b.e AND a.e > b.s AND a.s < b.s""",
)
def overlap_join(spark, sf):
    iv = B.intervals(spark, sf).drop("l_linenumber")
    return I.overlap_join(iv, iv).filter("start < r_start").select("chrom", "strand", "start", "end", "r_start", "r_end")


_ANY_SQL = f"""{B.INTERVALS_SQL}, av AS (SELECT chrom, s, CASE WHEN s % 9700 = 0 THEN s + 3000000 + l_linenumber ELSE e END AS e, CASE WHEN l_linenumber IN (3, 5) THEN '.' ELSE strand END AS strand FROM iv)"""


@query(
    "interval_overlap_any_strand",
    f"""WITH {_ANY_SQL} SELECT a.chrom, a.strand, a.s AS start, a.e AS "end", b.strand AS r_strand, b.s AS r_start, b.e AS r_end FROM av a JOIN av b ON a.chrom = b.chrom AND a.s < b.e AND a.e > b.s AND a.s < b.s WHERE a.strand = b.strand OR a.strand = '.' OR b.strand = '.'""",
)
def overlap_any_strand(spark, sf):
    """A strand of "." matches any; some intervals are a thousand times as long as the others."""
    iv = B.intervals(spark, sf)
    end = F.when(F.col("start") % 9700 == 0, F.col("start") + 3_000_000 + F.col("l_linenumber")).otherwise(F.col("end"))
    iv = iv.withColumns({"end": end, "strand": F.when(F.col("l_linenumber").isin(3, 5), ".").otherwise(F.col("strand"))}).drop("l_linenumber")
    return I.overlap_join(iv, iv, any_strand=True).filter("start < r_start").select("chrom", "strand", "start", "end", "r_strand", "r_start", "r_end")


@query(
    "interval_subtract",
    f"""WITH {B.INTERVALS_SQL}, p AS (SELECT *, s + 300 AS bs, s + 300 + l_linenumber * 150 AS be FROM iv),
x AS (SELECT chrom, strand, s AS start, least(e, bs) AS "end" FROM p WHERE s < bs UNION ALL SELECT chrom, strand, be, e FROM p WHERE e > be)
SELECT * FROM x""",
)
def subtract(spark, sf):
    iv = B.intervals(spark, sf)
    pairs = iv.withColumns({"b_chrom": F.col("chrom"), "b_start": F.col("start") + 300, "b_end": F.col("start") + 300 + F.col("l_linenumber") * 150})
    return I.subtract(pairs).select("chrom", "strand", "start", "end")


@query("interval_in_region", f"""WITH {B.INTERVALS_SQL} SELECT chrom, s AS start, e AS "end", strand FROM iv WHERE chrom = 'c3' AND s < 900000 AND e > 200000 AND strand = '+'""")
def in_region(spark, sf):
    return I.in_region(B.intervals(spark, sf), "c3", 200_000, 900_000, "+").drop("l_linenumber")


@query(
    "junction_keys",
    f"""WITH {B.JUNCTIONS_SQL} SELECT DISTINCT chrom || ':' || s || '-' || e || ':' || strand AS key, CASE strand WHEN '-' THEN e - 1 ELSE s END AS donor, CASE strand WHEN '-' THEN s ELSE e - 1 END AS acceptor, e - s AS length FROM jf""",
)
def junction_keys(spark, sf):
    rows = R.junction_counts(B.reads(spark, sf)).select(*J.KEY).distinct().select(J.key_string().alias("key"), "strand")
    parsed = rows.withColumn("p", J.parse_key("key")).select("key", "p.*")
    return parsed.select("key", J.donor().alias("donor"), J.acceptor().alias("acceptor"), (F.col("end") - F.col("start")).alias("length"))


@query(
    "junction_vectors",
    f"""WITH {B.JUNCTIONS_SQL},
c AS (SELECT chrom, s, e, strand, sample_idx, count(*) AS n, sum(mapq) / count(*)::DOUBLE AS mq, sum(coalesce(nh, 1)) / count(*)::DOUBLE AS nh, max(greatest(la, ra)) AS anchor FROM jf GROUP BY ALL)
SELECT chrom, s AS start, e AS "end", strand, string_agg(n::VARCHAR, ',' ORDER BY i) AS counts, round(sum(w), 6) AS weighted, round(sum(mq), 6) AS mapq_total, max(anchor) AS max_anchor, count_if(n > 0) AS n_samples_detected, count_if(n > 0) / 6.0::DOUBLE AS recurrence
FROM (SELECT k.chrom, k.s, k.e, k.strand, k.i, coalesce(c.n, 0) AS n, coalesce(c.n / c.nh, 0) AS w, coalesce(mq, 0) AS mq, anchor
      FROM (SELECT DISTINCT chrom, s, e, strand, i FROM c, range(6) t(i)) k LEFT JOIN c ON k.chrom = c.chrom AND k.s = c.s AND k.e = c.e AND k.strand = c.strand AND k.i = c.sample_idx)
GROUP BY chrom, s, e, strand""",
)
def junction_vectors(spark, sf):
    v = J.vectors(R.junction_counts(B.reads(spark, sf)), B.N_SAMPLES)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    return v.select(*J.KEY, F.array_join(F.col("sample_counts").cast("array<string>"), ",").alias("counts"), total("sample_weighted").alias("weighted"), total("sample_mapq").alias("mapq_total"), "max_anchor", "n_samples_detected", "recurrence")


_TX = "t AS (SELECT o_custkey AS g, o_orderkey AS tx, 'chr' || (o_orderkey % 3 + 1) AS chrom, l_linenumber * 200 + (l_partkey % 7) * 10 AS s, l_linenumber * 200 + (l_partkey % 7) * 10 + 60 + l_suppkey % 5 * 10 AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


def exons(spark, sf):
    joined = B.table(spark, sf, "orders").join(B.table(spark, sf, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"))
    s = F.col("l_linenumber") * 200 + (F.col("l_partkey") % 7) * 10
    return joined.select(F.col("o_custkey").cast("string").alias("gene_id"), F.col("o_orderkey").cast("string").alias("transcript_id"), F.concat(F.lit("chr"), F.col("o_orderkey") % 3 + 1).alias("chrom"), F.lit("+").alias("strand"), s.alias("start"), (s + 60 + F.col("l_suppkey") % 5 * 10).alias("end"))


@query("known_junctions", f"""WITH {_TX}, w AS (SELECT chrom, e AS s, lead(s) OVER (PARTITION BY g, tx ORDER BY s, e) AS e2 FROM t) SELECT DISTINCT chrom, s AS start, e2 AS "end", '+' AS strand FROM w WHERE e2 > s""")
def known(spark, sf):
    return J.known_junctions(exons(spark, sf))


@query(
    "junction_annotate",
    f"""WITH {B.JUNCTIONS_SQL}, k AS (SELECT chrom, s, e, strand FROM jf GROUP BY ALL HAVING count(DISTINCT sample_idx) >= 3) SELECT j.chrom, j.s AS start, j.e AS "end", j.strand, k.s IS NOT NULL AS is_annotated FROM (SELECT DISTINCT chrom, s, e, strand FROM jf) j LEFT JOIN k USING (chrom, s, e, strand)""",
)
def annotate(spark, sf):
    """Known are the junctions that three samples or more have."""
    found = R.junction_counts(B.reads(spark, sf)).groupBy(*J.KEY).agg(F.count("*").alias("samples"))
    return J.annotate(found.select(*J.KEY), found.filter("samples >= 3").select(*J.KEY))


@query(
    "junction_min_reads",
    f"""WITH {B.JUNCTIONS_SQL}, t AS (SELECT chrom, s, e, strand, count(*) AS total FROM jf GROUP BY ALL HAVING count(*) >= 5), k AS (SELECT chrom FROM t GROUP BY chrom HAVING count(*) >= 2) SELECT chrom, s AS start, e AS "end", strand, total FROM t JOIN k USING (chrom)""",
)
def min_reads(spark, sf):
    return J.with_enough_reads(R.junction_counts(B.reads(spark, sf)), 5).groupBy(*J.KEY).agg(F.sum("counts").alias("total"))


@query(
    "junction_confidence",
    f"""WITH {B.JUNCTIONS_SQL},
c AS (SELECT chrom, s, e, strand, sample_idx, avg(mapq) AS mq, max(greatest(la, ra)) AS anchor FROM jf GROUP BY ALL),
v AS (SELECT chrom, s, e, strand, count(*) / 6.0::DOUBLE AS rec, max(anchor) AS anchor, sum(mq) / 6 AS mq, s % 20 = 0 AS known, CASE e % 4 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.8::DOUBLE WHEN 2 THEN 0.6::DOUBLE ELSE 0.2::DOUBLE END AS motif FROM c GROUP BY chrom, s, e, strand),
r AS (SELECT *, round(0.25::DOUBLE * known::INT + 0.25::DOUBLE * greatest(0, least(1, (motif - 0.2::DOUBLE) / 0.8::DOUBLE)) + 0.2::DOUBLE * rec + 0.15::DOUBLE * least(1, anchor / 20.0::DOUBLE) + 0.15::DOUBLE * least(1, mq / 60), 6) AS composite_score FROM v)
SELECT chrom, s AS start, e AS "end", strand, composite_score FROM r WHERE composite_score >= 0.5""",
)
def confidence(spark, sf):
    v = J.vectors(R.junction_counts(B.reads(spark, sf)), B.N_SAMPLES)
    motif = F.when(F.col("end") % 4 == 0, 1.0).when(F.col("end") % 4 == 1, 0.8).when(F.col("end") % 4 == 2, 0.6).otherwise(0.2)
    v = v.withColumns({"is_annotated": F.col("start") % 20 == 0, "motif_score": motif, "mapq_total": F.aggregate("sample_mapq", F.lit(0.0), lambda a, x: a + x)})
    scored = J.confidence(v, B.N_SAMPLES).withColumn("composite_score", F.round("composite_score", 6))
    return J.confident(scored).select(*J.KEY, "composite_score")


def spread_sql(edges: str) -> str:
    """l (v, root): the smallest vertex each vertex of the symmetric `edges` (a, b) is connected to."""
    return f"""l(v, root) USING KEY (v) AS (
  SELECT DISTINCT a, a FROM {edges} UNION (SELECT {edges}.b, min(l.root) FROM l JOIN {edges} ON l.v = {edges}.a JOIN recurring.l AS o ON o.v = {edges}.b WHERE l.root < o.root GROUP BY {edges}.b))"""


_EDGES = """e0 AS (SELECT DISTINCT l_suppkey AS a, 100000 + l_partkey AS b FROM lineitem UNION SELECT 10000000 + o_custkey, 100000000 + o_orderkey FROM orders),
e2 AS (SELECT a, b FROM e0 UNION SELECT b, a FROM e0)"""


@query("graph_components", f"WITH RECURSIVE {_EDGES}, {spread_sql('e2')} SELECT v, root FROM l")
def components(spark, sf):
    """Suppliers hang together by their parts, which is one large component; each customer with their orders is a small one."""
    large = B.table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("a"), (F.col("l_partkey") + 100_000).alias("b"))
    small = B.table(spark, sf, "orders").select((F.col("o_custkey") + 10_000_000).alias("a"), (F.col("o_orderkey") + 100_000_000).alias("b"))
    return G.components(large.unionByName(small))


_SITES = """jx AS (SELECT DISTINCT chrom, s, e, strand FROM jf WHERE e - s <= 160),
sx AS (SELECT DISTINCT 'S:' || chrom || ':' || strand || ':' || s AS a, 'S:' || chrom || ':' || strand || ':' || e AS b FROM jx), e2 AS (SELECT a, b FROM sx UNION SELECT b, a FROM sx)"""


def _all_junctions(spark, sf):
    return R.junction_counts(B.reads(spark, sf)).select(*J.KEY).distinct()


@query(
    "junction_clusters",
    f"""WITH RECURSIVE {B.JUNCTIONS_SQL}, {_SITES}, {spread_sql('e2')}
SELECT 'cluster:' || root AS cluster_id, jx.chrom, jx.strand, min(jx.s) AS start, max(jx.e) AS "end", count(*) AS size FROM jx JOIN l ON l.v = 'S:' || chrom || ':' || strand || ':' || s GROUP BY root, jx.chrom, jx.strand HAVING count(*) >= 2""",
)
def clusters(spark, sf):
    return G.clusters(G.cluster_junctions(_all_junctions(spark, sf), max_intron=160))


_GENES = "genes AS (SELECT s_suppkey::VARCHAR AS gene_id, 'chr' || (s_suppkey // 2 % 2 + 1) AS chrom, CASE WHEN s_suppkey % 2 = 0 THEN '+' ELSE '-' END AS strand, s_suppkey * 173 % 5000 AS s, s_suppkey * 173 % 5000 + 700 AS e FROM supplier)"


@query(
    "module_builder",
    f"""WITH RECURSIVE {B.JUNCTIONS_SQL}, {_SITES}, {_GENES}, {spread_sql('e2')},
mem AS (SELECT root, jx.* FROM jx JOIN l ON l.v = 'S:' || chrom || ':' || strand || ':' || s),
cl AS (SELECT root, chrom, strand, min(s) AS s, max(e) AS e FROM mem GROUP BY root, chrom, strand HAVING count(*) >= 2),
gc AS (SELECT gene_id, cl.* FROM cl JOIN genes g ON g.chrom = cl.chrom AND g.strand = cl.strand AND cl.s < g.e AND cl.e > g.s),
m AS (SELECT *, max(e) OVER (PARTITION BY gene_id, chrom, strand ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM gc),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR s >= reach THEN 1 ELSE 0 END) OVER (PARTITION BY gene_id, chrom, strand ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS island FROM m),
alone AS (SELECT '' AS gene_id, cl.root, cl.chrom, cl.strand, row_number() OVER () + 1000000 AS island FROM cl WHERE NOT EXISTS (SELECT 1 FROM gc WHERE gc.chrom = cl.chrom AND gc.strand = cl.strand)),
u AS (SELECT gene_id, root, chrom, strand, island FROM i UNION ALL SELECT * FROM alone),
j AS (SELECT DISTINCT u.gene_id, u.chrom, u.strand, u.island, mem.s, mem.e FROM u JOIN mem ON mem.root = u.root)
SELECT (CASE WHEN gene_id = '' THEN 'intergenic' ELSE gene_id END) || ':' || chrom || ':' || strand || ':' || min(s) || '-' || max(e) AS module_id, gene_id, chrom, strand, min(s) AS start, max(e) AS "end", count(*) AS n_connections, count(*) = 2 AS is_binary FROM j GROUP BY gene_id, chrom, strand, island""",
)
def modules(spark, sf):
    members = G.cluster_junctions(_all_junctions(spark, sf), max_intron=160)
    k = F.col("s_suppkey")
    genes = B.table(spark, sf, "supplier").select(k.cast("string").alias("gene_id"), k.cast("string").alias("gene_name"), F.concat(F.lit("chr"), F.expr("s_suppkey div 2 % 2 + 1")).alias("chrom"), (k * 173 % 5000).alias("start"), (k * 173 % 5000 + 700).alias("end"), F.when(k % 2 == 0, "+").otherwise("-").alias("strand"))
    return M.build_modules(G.clusters(members), members, genes)[0].drop("gene_name")


_CO = "mem AS (SELECT DISTINCT p_brand AS module_id, l_suppkey AS j FROM lineitem JOIN part ON l_partkey = p_partkey), ed AS (SELECT x.module_id, x.l_suppkey AS i, y.l_suppkey AS j, count(*) AS n FROM (SELECT p_brand AS module_id, * FROM lineitem JOIN part ON l_partkey = p_partkey) x JOIN (SELECT p_brand AS module_id, * FROM lineitem JOIN part ON l_partkey = p_partkey) y ON x.module_id = y.module_id AND x.l_orderkey = y.l_orderkey AND x.l_suppkey < y.l_suppkey GROUP BY ALL)"


def _network(spark, sf):
    """Suppliers as a brand's junctions; those that share an order with the brand occur together."""
    rows = B.table(spark, sf, "lineitem").join(B.table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_brand").alias("module_id"), "l_orderkey", F.col("l_suppkey").alias("k"))
    edges = rows.withColumnRenamed("k", "i").join(rows.withColumnRenamed("k", "j"), ["module_id", "l_orderkey"]).filter("i < j").groupBy("module_id", "i", "j").agg(F.count("*").alias("n"))
    return rows.select("module_id", F.col("k").alias("j_idx")).distinct(), edges


@query("graph_symmetric", f"WITH {_CO} SELECT module_id, i, j, n FROM ed UNION ALL SELECT module_id, j, i, n FROM ed")
def symmetric(spark, sf):
    return G.symmetric(_network(spark, sf)[1])


@query("graph_exclusive_pairs", f"WITH {_CO} SELECT a.module_id, a.j AS i, b.j AS j FROM mem a JOIN mem b ON a.module_id = b.module_id AND a.j < b.j WHERE NOT EXISTS (SELECT 1 FROM ed WHERE ed.module_id = a.module_id AND ed.i = a.j AND ed.j = b.j)")
def exclusive(spark, sf):
    return G.exclusive_pairs(*_network(spark, sf))


@query(
    "graph_coordinated_groups",
    f"""WITH RECURSIVE {_CO}, st AS (SELECT module_id, i, j FROM ed WHERE n >= 2), e2 AS (SELECT (module_id, i) AS a, (module_id, j) AS b FROM st UNION SELECT (module_id, j), (module_id, i) FROM st), {spread_sql('e2')}
SELECT mem.module_id, mem.j AS j_idx, coalesce(root[2], mem.j) AS "group" FROM mem LEFT JOIN l ON l.v = (mem.module_id, mem.j)""",
)
def coordinated(spark, sf):
    return G.coordinated_groups(*_network(spark, sf), least=2)


@query(
    "graph_similar_junctions",
    f"""WITH {_CO}, s AS (SELECT module_id, i, j FROM ed UNION ALL SELECT module_id, j, i FROM ed), n AS (SELECT module_id, i, list(DISTINCT j) AS near FROM s GROUP BY ALL),
p AS (SELECT a.module_id, a.i, b.i AS j, len(list_intersect(a.near, b.near)) AS x, len(a.near) + len(b.near) AS y FROM n a JOIN n b ON a.module_id = b.module_id AND a.i < b.i)
SELECT module_id, i, j, round(x / (y - x)::DOUBLE, 6) AS similarity FROM p WHERE x / (y - x)::DOUBLE >= 0.3""",
)
def similar(spark, sf):
    return G.similar_junctions(_network(spark, sf)[1], 0.3).withColumn("similarity", F.round("similarity", 6))


@query(
    "graph_cooccurrence",
    f"""WITH {B.JUNCTIONS_SQL},
pc AS (SELECT chrom, strand, pos + a AS s1, pos + a + b AS e1, q AS s2, CASE form WHEN 1 THEN q + 3 ELSE q + 60 END AS e2, count(*) AS n FROM good WHERE form > 0 AND a >= 6 AND c >= 6 GROUP BY ALL),
d AS (SELECT DISTINCT chrom, s, e, strand FROM jf), mm AS (SELECT chrom || strand || (s // 500) AS module_id, chrom, s, e, strand, row_number() OVER (PARTITION BY chrom, strand, s // 500 ORDER BY s, e) - 1 AS k FROM d)
SELECT x.module_id, least(x.k, y.k) AS i, greatest(x.k, y.k) AS j, n FROM pc JOIN mm x ON x.chrom = pc.chrom AND x.strand = pc.strand AND x.s = s1 AND x.e = e1 JOIN mm y ON y.module_id = x.module_id AND y.chrom = pc.chrom AND y.strand = pc.strand AND y.s = s2 AND y.e = e2""",
)
def cooccurrence(spark, sf):
    from pyspark.sql import Window

    reads = B.reads(spark, sf)
    found = R.junction_counts(reads).select(*J.KEY).distinct().withColumn("module_id", F.concat("chrom", "strand", F.expr("start div 500")))
    members = found.withColumn("j_idx", F.row_number().over(Window.partitionBy("module_id").orderBy("start", "end")) - 1)
    return G.cooccurrence(R.pair_counts(reads), members)


@query(
    "frame_graph",
    f"""WITH {_TX}, x AS (SELECT DISTINCT g, chrom, s, e FROM t), w AS (SELECT DISTINCT chrom, e AS s, lead(s) OVER (PARTITION BY g, tx ORDER BY s, e) AS e FROM t)
SELECT u.g::VARCHAR AS gene_id, u.chrom, '+' AS strand, u.s AS up_start, u.e AS up_end, f AS frame, d.s AS down_start, d.e AS down_end, (f + w.e - w.s) % 3 AS next_frame
FROM w JOIN x u ON u.chrom = w.chrom AND u.e = w.s JOIN x d ON d.g = u.g AND d.chrom = w.chrom AND d.s = w.e, range(3) t(f) WHERE w.e > w.s""",
)
def frame_graph(spark, sf):
    """A gene's transcripts lie on three chromosomes, and its exons meet introns of other genes."""
    some = exons(spark, sf)
    return N.frame_graph(some, J.known_junctions(some))


@query(
    "junction_site_match",
    f"""WITH {_TX}, k AS (SELECT g, tx, s, e, row_number() OVER (PARTITION BY g, tx ORDER BY s, e) AS i, e AS donor, lead(s) OVER (PARTITION BY g, tx ORDER BY s, e) AS acc FROM t),
jn AS (SELECT DISTINCT g, donor AS s, acc + 10 AS e FROM k WHERE acc IS NOT NULL)
SELECT jn.g::VARCHAR AS gene_id, jn.s AS start, jn.e AS "end", tx::VARCHAR AS transcript_id, min(i) - 1 AS first_match FROM jn JOIN k ON k.g = jn.g AND acc IS NOT NULL AND (donor = jn.s OR acc = jn.e) GROUP BY ALL""",
)
def site_match(spark, sf):
    from pyspark.sql import Window

    some = exons(spark, sf)
    w = Window.partitionBy("gene_id", "transcript_id").orderBy("start", "end")
    sites = some.select("gene_id", "transcript_id", (F.row_number().over(w) - 1).alias("i"), F.col("end").alias("donor"), F.lead("start").over(w).alias("acceptor")).filter("acceptor is not null")
    js = sites.select("gene_id", F.col("donor").alias("start"), (F.col("acceptor") + 10).alias("end")).distinct()
    return N.site_matches(js, sites)
