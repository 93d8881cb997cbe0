"""Half-open intervals (chrom, start, end, strand): overlap joins, merging, subtraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..stages import written


#: Bins are of LEVELS widths, each SPAN of the one before; an interval of at most SPAN bins of a width is cut into those.
WIDTH = 1 << 14
LEVELS, SPAN = 4, 64
#: Intervals that a task sorts at once, some 100 bytes each.
ROWS = 1 << 20


def _level(start: Column, end: Column, least: int) -> Column:
    """The first width of which an interval covers few bins."""
    out = F
    for k in range(LEVELS - 1):
        out = out.when(end - start <= least * SPAN ** (k + 1), k)
    return out.otherwise(LEVELS - 1)


def _width(level: Column, least: int) -> Column:
    return F.element_at(F.array(*(F.lit(least * SPAN**k).cast("bigint") for k in range(LEVELS))), level + 1)


def _strands(strand: Column) -> Column:
    """Keys by which a strand meets others: "." has all."""
    return F.when(strand == ".", F.array(*map(F.lit, "+-?"))).when(strand.isNotNull(), F.array(F.when(strand.isin("+", "-"), strand).otherwise("?")))


def _binned(rows: DataFrame, others: DataFrame, tag: str, any_strand: bool, least: int = WIDTH) -> DataFrame:
    """Rows at the bins of their own level and of the higher ones that the other side has.

    A row is in at most 65 bins of its own level and two of each other.
    """
    start, end = F.col(f"{tag}start"), F.col(f"{tag}end")
    there = others.agg(F.collect_set(_level(F.col("start"), F.col("end"), least)).alias("__there"))  # one row of at most as many numbers as there are widths
    rows = rows.withColumn(f"__{tag}own", _level(start, end, least)).crossJoin(F.broadcast(there))
    rows = rows.withColumn("__level", F.explode(F.array_union(F.array(f"__{tag}own"), F.filter("__there", lambda x: x > F.col(f"__{tag}own"))))).drop("__there")
    width = _width(F.col("__level"), least)
    bins = F.sequence(F.floor(start / width), F.floor((F.greatest(end, start + 1) - 1) / width))
    key = F.col(f"{tag}strand")
    return rows.withColumn("__bin", F.explode(bins)).withColumn("__strand", F.explode(_strands(key)) if any_strand else key)


def overlap_join(left: DataFrame, right: DataFrame, width: int = WIDTH, any_strand: bool = False) -> DataFrame:
    """Pairs that overlap on the same chrom and strand; right columns get the prefix r_.

    With `any_strand`, "." on either side matches any strand.  A null in chrom, bounds or strand matches nothing.  Both sides are cut into bins, so
    the join's key is (chrom, strand, level, bin) and no chromosome is a hot key.  Long intervals
    are cut into wider bins, and the short ones of the other side meet them there, if there are any
    such.  A pair is kept at the longer one's level, in the one bin where its overlap begins, and
    two "." in one of the strands they meet in.
    """
    named = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    a = _binned(left, right, "", any_strand, width)
    b = _binned(named, left, "r_", any_strand, width)
    b = b.select(*named.columns, "__r_own", *(F.col(c).alias(f"__r{c}") for c in ("__level", "__bin", "__strand")))
    on = (a["chrom"] == b["r_chrom"]) & (a["__strand"] == b["__r__strand"]) & (a["__level"] == b["__r__level"]) & (a["__bin"] == b["__r__bin"]) & (a["start"] < b["r_end"]) & (a["end"] > b["r_start"])
    owned = (F.col("__level") == F.greatest("__own", "__r_own")) & (F.col("__bin") == F.floor(F.greatest("start", "r_start") / _width(F.col("__level"), width)))
    if any_strand:
        both = (F.col("strand") == ".") & (F.col("r_strand") == ".")
        owned = owned & F.when(both, F.col("__strand") == "+").otherwise((F.col("strand") == F.col("r_strand")) | (F.col("strand") == ".") | (F.col("r_strand") == "."))
    return a.join(b, on).filter(owned).select(*left.columns, *named.columns)


def _parts(spark: SparkSession, n: int) -> int:
    """Partitions of some ROWS rows at most for n rows, and enough for all cores."""
    return max(n // ROWS + 1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))


def _dealt(rows: DataFrame, place: list[str], n: int | None = None) -> DataFrame:
    """Rows by place in partitions of a bounded number of rows, so that no task sorts more as the input grows; `n` is how many there are at most, where known.

    The number of partitions is given: adaptive execution would join shuffle partitions until few are left.
    """
    n = rows.count() if n is None else n
    return rows if n < ROWS else rows.repartition(_parts(rows.sparkSession, n), *place)


def _with_bins(rows: DataFrame, bins: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Rows with the columns of their bin; keys may be null."""
    named = bins.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), *(c for c in bins.columns if c not in keys))
    on = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)))
    return rows.join(named, on, how).drop(*(f"__k{i}" for i in range(len(keys))))


def _with_reached(islands: DataFrame, reached: DataFrame, place: list[str]) -> DataFrame:
    """Islands with __reach where their bin is reached: bins that are few are broadcast, others meet the islands in partitions of a bounded number of rows."""
    n = reached.count()
    if n <= ROWS // 4:
        return _with_bins(islands, F.broadcast(reached), place, "left")
    parts = _parts(islands.sparkSession, islands.count() + n)
    key = F.struct(*place)  # equal where nulls are
    bins = reached.select(key.alias("__reached"), "__reach").repartition(parts, "__reached").hint("merge")
    met = islands.withColumn("__place", key).repartition(parts, "__place")
    return met.join(bins, F.col("__place") == F.col("__reached"), "left").drop("__place", "__reached")


def _apart(start: Column, reach: Column, touching: bool) -> Column:
    return start > reach if touching else start >= reach


def merge_intervals(intervals: DataFrame, keys: tuple[str, ...] = ("chrom", "strand"), touching: bool = True, carry: list[Column] | None = None, bin_width: int | None = 1 << 20) -> DataFrame:
    """Islands of overlapping intervals with their bounds and number; touching ones merge or stay apart.

    A running maximum of ends tells where an island begins.  Intervals are swept within bins of
    `bin_width` by start, so no task holds a chromosome, and the islands of a bin, taken from the
    same order by running figures, are written.  Most end within their bin and are reached by none
    before it.  Of the others, those of a bin that earlier bins reach are one island, and one at
    most goes over the bin's end, so two rows a bin are swept over bins.  None is for keys that have few intervals each, which are swept whole;
    `carry` adds aggregates, for which all intervals are swept over bins.  `island` is a number
    that rises with the place within a key.
    """
    if bin_width is None or carry:
        return _swept(intervals.withColumn("__n", F.lit(1)), keys, touching, bin_width, carry)
    place = [*keys, "__bin"]
    rows = _dealt(intervals.select(*keys, "start", "end", F.floor(F.col("start") / bin_width).alias("__bin")), place)
    order = Window.partitionBy(*place).orderBy("start", "end")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    new = F.col("__new") == 1
    before = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    flagged = rows.withColumn("__before", before).withColumn("__new", F.when(F.col("__before").isNull() | _apart(F.col("start"), F.col("__before"), touching), 1).otherwise(0))
    numbered = flagged.withColumns({"__number": F.sum("__new").over(so_far), "__at": F.row_number().over(order), "__next": F.lead("__new").over(order)})
    known = numbered.withColumns({
        "__island": F.max(F.struct("__number", "end")).over(so_far),
        "__start": F.last(F.when(new, F.col("start")), ignorenulls=True).over(so_far),
        "__from": F.max(F.when(new, F.col("__at"))).over(so_far),
        "__least": F.first("start").over(so_far),
    }).filter("__next is null or __next = 1")
    last = F.col("__next").isNull()
    local = known.select(
        *keys, "__bin", F.col("__start").alias("start"), F.col("__island.end").alias("end"), (F.col("__at") - F.col("__from") + 1).cast("bigint").alias("__n"),
        (F.col("__bin") * (1 << 32) + F.col("__number")).alias("__id"), last.alias("__last"), F.when(last, F.greatest("__before", "end")).alias("__top"), F.when(last, F.col("__least")).alias("__least"),
    )
    local = written(local, "islands")
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    ends = local.filter("__last and __bin is not null")
    bins = ends.count()
    tops = _dealt(ends, [*keys], bins).select(*place, "__least", F.max("__top").over(earlier).alias("__reach"))
    reached = written(tops.filter(~_apart(F.col("__least"), F.col("__reach"), touching)).drop("__least"), "reached")
    told = _with_reached(local, reached, place)
    joins = F.coalesce(~_apart(F.col("start"), F.col("__reach"), touching), F.lit(False))
    told = told.withColumns({"__joins": joins, "__leaves": F.coalesce(F.col("end") >= (F.col("__bin") + 1) * bin_width, F.lit(False))})
    whole = told.filter("not (__joins or __leaves)").select(*keys, F.col("__id").alias("island"), "start", "end", F.col("__n").alias("n"))
    few = told.filter("__joins or __leaves").groupBy(*place, "__joins").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("__n").alias("__n"), F.min("__id").alias("__id"))
    rest = _swept(_dealt(few, [*keys], 2 * bins), keys, touching, None, [F.min("__id").alias("__first")])
    return whole.unionByName(rest.select(*keys, F.col("__first").alias("island"), "start", "end", "n"))


def _swept(intervals: DataFrame, keys: tuple[str, ...], touching: bool, bin_width: int | None, carry: list[Column] | None = None) -> DataFrame:
    """Islands of rows that stand for __n intervals each.

    What earlier bins reach and how many islands they begin is carried over in a table of a row a bin.
    """
    place = [*keys] if bin_width is None else [*keys, "__bin"]
    rows = intervals if bin_width is None else intervals.withColumn("__bin", F.floor(F.col("start") / bin_width))
    order = Window.partitionBy(*place).orderBy("start", "end")
    earlier = Window.partitionBy(*keys).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    number = F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    if bin_width is not None:
        tops = rows.groupBy(*place).agg(F.max("end").alias("__top"))
        rows = _with_bins(rows, tops.select(*place, F.max("__top").over(earlier).alias("__reach")), place)
        reach = F.greatest("__reach", reach)
    flagged = rows.withColumn("__before", reach)
    flagged = flagged.withColumn("__new", F.when(F.col("__before").isNull() | _apart(F.col("start"), F.col("__before"), touching), 1).otherwise(0))
    if bin_width is not None:
        begun = flagged.groupBy(*place).agg(F.sum("__new").alias("__begun"))
        flagged = _with_bins(flagged, begun.select(*place, F.coalesce(F.sum("__begun").over(earlier), F.lit(0)).alias("__islands")), place)
        number = F.col("__islands") + number
    islands = flagged.withColumn("island", number)
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.sum("__n").alias("n"), *(carry or []))


def subtract(pairs: DataFrame) -> DataFrame:
    """Each row (chrom, start, end, strand, b_start, b_end, b_chrom) becomes what of [start, end) is outside b."""
    hit = (F.col("chrom") == F.col("b_chrom")) & (F.col("start") < F.col("b_end")) & (F.col("end") > F.col("b_start"))
    piece = lambda s, e: F.struct(s.alias("start"), e.alias("end"))
    left = F.when(F.col("start") < F.col("b_start"), piece(F.col("start"), F.col("b_start")))
    right = F.when(F.col("end") > F.col("b_end"), piece(F.col("b_end"), F.col("end")))
    parts = F.when(hit, F.array_compact(F.array(left, right))).otherwise(F.array(piece(F.col("start"), F.col("end"))))
    rest = [c for c in pairs.columns if c not in ("start", "end")]
    return pairs.withColumn("__p", F.explode(parts)).select(*rest, F.col("__p.start").alias("start"), F.col("__p.end").alias("end"))


def in_region(df: DataFrame, chrom: str, start: int, end: int, strand: str | None = None) -> DataFrame:
    """Rows that overlap a region, by half-open bounds."""
    hit = (F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start)
    return df.filter(hit if strand is None else hit & (F.col("strand") == strand))
