"""Event types from a module's topology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_type(js: str = "js") -> Column:
    """Type of an array<struct<start,end,donor,acceptor>> sorted by start and end."""
    j = lambda i, f: F.col(js)[i][f]
    holds = lambda o, i: (j(o, "start") <= j(i, "start")) & (j(i, "end") <= j(o, "end")) & (j(i, "start") < j(i, "end"))
    same_donor, same_acceptor = j(0, "donor") == j(1, "donor"), j(0, "acceptor") == j(1, "acceptor")
    pair = F.when(same_donor & ~same_acceptor, "A3SS").when(same_acceptor & ~same_donor, "A5SS").when(holds(0, 1) | holds(1, 0), "RI").otherwise("Complex")
    skips = lambda s, a, b: (j(s, "start") == j(a, "start")) & (j(s, "end") == j(b, "end")) & (j(a, "end") <= j(b, "start"))
    cassette = skips(0, 1, 2) | skips(1, 0, 2) | skips(2, 0, 1)
    return F.when(F.size(js) == 2, pair).when((F.size(js) == 3) & cassette, "SE").otherwise("Complex")


def classify(junctions: DataFrame, exclusive: DataFrame | None = None, coordinated: DataFrame | None = None) -> DataFrame:
    """(module_id, n_junctions, event_type).

    With co-occurrence, modules of four junctions become MXE where some pair is exclusive, else
    TandemCassette where at least two junctions share a group; without it they stay Complex.
    """
    strand = F.col("strand")
    one = F.struct("start", "end", F.when(strand == "-", F.col("end") - 1).otherwise(F.col("start")).alias("donor"), F.when(strand == "-", F.col("start")).otherwise(F.col("end") - 1).alias("acceptor"))
    # no more than five junctions matter to the type; the count is of all
    modules = junctions.groupBy("module_id").agg(F.count("*").alias("n_junctions"), F.sort_array(F.collect_list(one)).alias("js"))
    out = modules.select("module_id", "n_junctions", event_type("js").alias("event_type"))
    if exclusive is not None:
        out = out.join(exclusive.select("module_id").distinct().withColumn("__x", F.lit(True)), "module_id", "left")
        out = out.withColumn("event_type", F.when((F.col("n_junctions") == 4) & F.col("__x"), "MXE").otherwise(F.col("event_type"))).drop("__x")
    if coordinated is not None:
        several = coordinated.groupBy("module_id", "group").count().filter("count >= 2").select("module_id").distinct().withColumn("__t", F.lit(True))
        out = out.join(several, "module_id", "left")
        out = out.withColumn("event_type", F.when((F.col("n_junctions") == 4) & (F.col("event_type") == "Complex") & F.col("__t"), "TandemCassette").otherwise(F.col("event_type"))).drop("__t")
    return out


def type_counts(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def of_type(events: DataFrame, wanted: str) -> DataFrame:
    return events.filter(F.col("event_type") == wanted)


def significant_by_type(results: DataFrame, threshold: float = 0.05) -> DataFrame:
    """Per type: modules, significant ones, and their share of all tested modules in percent."""
    total = results.agg(F.count("*").alias("t"))
    each = results.groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(F.col("fdr") < threshold).alias("n_significant"))
    return each.crossJoin(F.broadcast(total)).select("event_type", "n", "n_significant", (100.0 * F.col("n") / F.col("t")).alias("percent"))
