"""Benjamini-Hochberg false-discovery rates over a whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bucket(p: Column) -> Column:
    """A monotone bucket of a p-value: a thousandth, or for smaller ones a twentieth of a power of ten; NaN last."""
    small = F.floor(F.log10(F.greatest(p, F.lit(1e-320))) * 20)
    return F.when(F.isnan(p), F.lit(1 << 40)).when(p >= 0.001, F.floor(F.least(p, F.lit(1e6)) * 1000)).otherwise(small)


def benjamini_hochberg(df: DataFrame, p: str = "p_value", out: str = "fdr", tie: str = "module_id") -> DataFrame:
    """Adds the adjusted p-value.  NaN sorts last, counts in n and stays NaN.

    Equal p-values share their rank's best value, so only distinct p-values are ranked, within
    buckets of near values; ranks before a bucket and the least value after it come from a table
    of a row a bucket, a few thousand at any size.
    """
    n = df.agg(F.count(p).alias("__n"))
    distinct = df.filter(F.col(p).isNotNull()).groupBy(F.col(p).alias("__p")).agg(F.count("*").alias("__k"))
    distinct = distinct.withColumn("__b", _bucket(F.col("__p")))
    inside, buckets = Window.partitionBy("__b").orderBy("__p"), Window.orderBy("__b")
    before = distinct.groupBy("__b").agg(F.sum("__k").alias("__k"))
    before = before.select("__b", F.coalesce(F.sum("__k").over(buckets.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    rank = F.col("__before") + F.sum("__k").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    ranked = distinct.join(before, "__b").withColumn("__rank", rank).crossJoin(F.broadcast(n))
    ranked = ranked.withColumn("__raw", F.when(F.isnan("__p"), F.lit(None)).otherwise(F.col("__p") * F.col("__n") / F.col("__rank")))
    after = ranked.groupBy("__b").agg(F.min("__raw").alias("__raw"))
    after = after.select("__b", F.min("__raw").over(buckets.rowsBetween(1, Window.unboundedFollowing)).alias("__after"))
    least = F.least(F.lit(1.0), "__after", F.min("__raw").over(inside.rowsBetween(0, Window.unboundedFollowing)))
    adjusted = ranked.join(after, "__b").withColumn("__q", least)
    adjusted = adjusted.select("__p", F.when(F.isnan("__p"), F.lit(float("nan"))).otherwise(F.col("__q")).alias(out))
    return df.join(adjusted, df[p].eqNullSafe(adjusted["__p"]), "left").drop("__p")
