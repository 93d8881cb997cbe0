"""Graphs of junctions: components, clusters, co-occurrence."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..stages import written
from .junctions import KEY

ROWS_A_FILE = 1_000_000
HUB = 1_000_000
BLOCK = 2048
FEW = 16


def components(edges: DataFrame, a: str = "a", b: str = "b", hub: int = HUB) -> DataFrame:
    """(v, root): each vertex with the smallest it is connected to, of any type that has an order.

    Labels spread over edges and jump to their labels' labels; each round is written to the
    shared checkpoint folder, so the plan stays short and lost executors cost one round, and only
    labels that the round before changed spread again.  Edges
    are dealt by both ends, minima are combined before they are shuffled, and the edges to a
    vertex of more than `hub` edges meet its label in a broadcast join, of which there are at
    most edges / hub, so no vertex is a hot key.
    """
    both = edges.select(F.col(a).alias("x"), F.col(b).alias("y"))
    both = both.filter("x is not null and y is not null").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    both = both.select(F.explode(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))).alias("e")).select("e.x", "e.y").persist()
    n = both.count()
    files = n // ROWS_A_FILE + 1
    hubs = written(both.groupBy(F.col("y").alias("h")).agg(F.count("*").alias("n")).filter(F.col("n") > hub).select("h").coalesce(1), "hubs") if n > hub else None
    if hubs is not None and hubs.isEmpty():
        hubs = None
    labels = written(both.groupBy(F.col("x").alias("v")).agg(F.min("y").alias("m")).select("v", F.least("v", "m").alias("root")).coalesce(files))
    fresh = labels
    for turn in count():
        if hubs is None:
            reached = both.join(fresh, both["y"] == fresh["v"]).select("x", "root")
        else:
            known = fresh.join(F.broadcast(hubs), fresh["v"] == hubs["h"]).select("v", "root")
            few = both.join(F.broadcast(hubs), both["y"] == hubs["h"], "left_anti")
            reached = few.join(fresh, few["y"] == fresh["v"]).select("x", "root").unionByName(both.join(F.broadcast(known), both["y"] == known["v"]).select("x", "root"))
        near = reached.groupBy("x").agg(F.min("root").alias("m"))
        spread = labels.join(near, labels["v"] == near["x"], "left").select("v", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        jump = labels.select(F.col("v").alias("p"), F.col("root").alias("up"))
        seen = Observation(f"components {turn}")
        after = spread.join(jump, spread["root"] == jump["p"]).select("v", "old", F.least("root", "up").alias("root"))
        after = after.observe(seen, F.count_if(F.col("old") != F.col("root")).alias("changed"))
        labels = written(after.coalesce(files))
        fresh, labels = labels.filter("old <> root").select("v", "root"), labels.select("v", "root")
        if not seen.get["changed"]:
            both.unpersist()
            return labels


def _site(position: Column) -> Column:
    return F.format_string("S:%s:%s:%d", F.col("chrom"), F.col("strand"), position.cast("bigint"))


def cluster_junctions(junctions: DataFrame, max_intron: int = 100_000, min_size: int = 2) -> DataFrame:
    """Junctions of (chrom, start, end, strand) with their cluster: those joined by a shared site.

    Starts and ends share one name space, so a junction that ends where another starts joins it.
    Longer introns and smaller clusters are left out.  cluster_id names the smallest site.
    """
    short = junctions.filter(F.col("end") - F.col("start") <= max_intron).select(*KEY).distinct()
    edges = short.select(_site(F.col("start")).alias("a"), _site(F.col("end")).alias("b"))
    roots = components(edges)
    member = short.withColumn("__site", _site(F.col("start"))).join(roots, F.col("__site") == roots["v"])
    sizes = member.groupBy("root").agg(F.count("*").alias("size"), F.min("start").alias("c_start"), F.max("end").alias("c_end")).filter(F.col("size") >= min_size)
    return member.join(sizes, "root").select(*KEY, F.concat(F.lit("cluster:"), "root").alias("cluster_id"), "size", "c_start", "c_end")


def clusters(members: DataFrame) -> DataFrame:
    """A row a cluster: bounds and size."""
    return members.groupBy("cluster_id", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("size"))


def cooccurrence(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (module_id, i, j, n), i < j, of junction pairs seen in one read, both in the module.

    `pairs` is (chrom, strand, start1, end1, start2, end2, sample_idx, n), `members` has
    module_id, j_idx and the junction.
    """
    total = pairs.groupBy("chrom", "strand", "start1", "end1", "start2", "end2").agg(F.sum("n").alias("n"))
    first = members.select("module_id", F.col("j_idx").alias("i"), "chrom", "strand", F.col("start").alias("start1"), F.col("end").alias("end1"))
    second = members.select("module_id", F.col("j_idx").alias("j"), "chrom", "strand", F.col("start").alias("start2"), F.col("end").alias("end2"))
    got = total.join(first, ["chrom", "strand", "start1", "end1"]).join(second, ["module_id", "chrom", "strand", "start2", "end2"])
    return got.select("module_id", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "n")


def symmetric(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select("module_id", F.col("j").alias("i"), F.col("i").alias("j"), "n"))


def exclusive_pairs(members: DataFrame, edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs i < j of a module's junctions that no read holds together.

    There are nearly as many as pairs at all, so they are made last and never shuffled: junctions
    are dealt into blocks of about `block`, a junction meets each block once, with its neighbours
    there, and its pairs are those of the block but the neighbours.  A row comes to one block's
    pairs at most, which is what a task holds of them.
    """
    own = members.filter(F.col("j_idx").isNotNull()).select("module_id", F.col("j_idx").alias("x")).distinct()
    sizes = own.groupBy("module_id").agg(F.ceil(F.count("*") / block).alias("of"))
    own = own.join(sizes, "module_id").withColumn("p", F.pmod(F.xxhash64("x"), F.col("of")))
    other = own.select("module_id", F.col("x").alias("j"), F.col("p").alias("q"))
    near = symmetric(edges.filter("n > 0")).join(other, ["module_id", "j"]).groupBy("module_id", F.col("i").alias("x"), "q").agg(F.collect_set("j").alias("near"))
    near = near.groupBy("module_id", "x").agg(F.map_from_entries(F.collect_list(F.struct("q", "near"))).alias("all"))
    spark = members.sparkSession
    tasks = 4 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)  # rows are few and small, what they come to is not
    key = ["module_id", "p", "q"]
    one = own.join(near, ["module_id", "x"], "left").withColumn("q", F.explode(F.sequence("p", F.col("of") - 1)))
    one = one.select(*key, "x", F.element_at("all", F.col("q")).alias("near")).repartition(tasks, *key)
    blocks = own.groupBy("module_id", F.col("p").alias("q")).agg(F.collect_list("x").alias("ys"))
    blocks = blocks.withColumn("p", F.explode(F.sequence(F.lit(0).cast("bigint"), "q"))).repartition(tasks, *key)
    many = F.coalesce(F.size("near") > FEW, F.lit(False))
    met = one.join(blocks.hint("shuffle_hash"), key).select(*key, "x", "near", F.explode(F.when(many, F.array_except("ys", "near")).otherwise(F.col("ys"))).alias("y"))
    pairs = met.filter("p < q or x < y").filter(many | F.col("near").isNull() | ~F.array_contains("near", F.col("y")))
    return pairs.select("module_id", F.least("x", "y").alias("i"), F.greatest("x", "y").alias("j"))


def coordinated_groups(members: DataFrame, edges: DataFrame, least: int = 3) -> DataFrame:
    """(module_id, j_idx, group): components of edges seen at least so often; the rest stay alone."""
    name = lambda c: F.struct("module_id", F.col(c).alias("k"))
    strong = edges.filter(F.col("n") >= least).select(name("i").alias("a"), name("j").alias("b"))
    roots = components(strong).select(F.col("v.module_id").alias("module_id"), F.col("v.k").alias("j_idx"), F.col("root.k").alias("g"))
    return members.select("module_id", "j_idx").join(roots, ["module_id", "j_idx"], "left").select("module_id", "j_idx", F.coalesce("g", "j_idx").alias("group"))


def similar_junctions(edges: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Pairs i < j of a module whose neighbour sets have Jaccard similarity of the threshold or more, which is over 0.

    Sets that similar share a neighbour among the first (1 - threshold) of each, in one order, and
    differ in size by no more than the threshold: pairs meet at such neighbours, the rare ones first,
    and are then compared whole.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be over 0: all pairs are similar by 0")
    near = symmetric(edges).filter("n > 0").select("module_id", "i", "j").distinct()
    often = near.groupBy("module_id", "j").agg(F.count("*").alias("often"))
    own = Window.partitionBy("module_id", "i")
    placed = near.join(often, ["module_id", "j"]).withColumns({"place": F.row_number().over(own.orderBy("often", "j")), "size": F.count("*").over(own)})
    first = placed.filter(F.col("place") <= F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).select("module_id", "j", "i", "size")
    a, b = first.select("module_id", "j", "i", "size"), first.select("module_id", "j", F.col("i").alias("k"), F.col("size").alias("k_size"))
    alike = (F.col("i") < F.col("k")) & (F.least("size", "k_size") >= F.greatest("size", "k_size") * threshold - 1e-9)
    pairs = a.join(b, ["module_id", "j"]).filter(alike).select("module_id", "i", "k").distinct()
    sets = near.groupBy("module_id", "i").agg(F.collect_set("j").alias("near"))
    met = pairs.join(sets.withColumnRenamed("near", "x"), ["module_id", "i"]).join(sets.select("module_id", F.col("i").alias("k"), F.col("near").alias("y")), ["module_id", "k"])
    jaccard = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return met.withColumn("similarity", jaccard).filter(F.col("similarity") >= threshold).select("module_id", "i", F.col("k").alias("j"), "similarity")
