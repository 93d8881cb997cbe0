"""Result tables of this engine and of other tools, as one ten-column frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

COLUMNS = ["gene_id", "gene_name", "chrom", "strand", "event_type", "delta_psi", "p_value", "fdr", "significant", "tool"]
SCHEMA = "gene_id string, gene_name string, chrom string, strand string, event_type string, delta_psi double, p_value double, fdr double, significant boolean, tool string"
OWN = "own"
# Names that other programs write.
RMATS_TYPES = ("SE", "A3SS", "A5SS", "MXE", "RI")
ALPHA = 0.05


def read_tsv(spark: SparkSession, path: str, comment: str | None = None, infer: bool = False) -> DataFrame:
    reader = spark.read.option("sep", "\t").option("header", True).option("quote", "\u0000").option("inferSchema", infer)
    return (reader.option("comment", comment) if comment else reader).csv(path)


def first_of(df: DataFrame, names: tuple[str, ...], default: str | None = None) -> Column:
    """The first of these columns that exists, with a default for what is missing."""
    found = next((F.col(f"`{n}`") for n in names if n in df.columns), None)
    return F.lit(default) if found is None else found if default is None else F.coalesce(found, F.lit(default))


def _bare(c: Column) -> Column:
    return F.regexp_replace(c, '^"+|"+$', "")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p))


def own_results(spark: SparkSession, path: str) -> DataFrame:
    df = read_tsv(spark, path)
    number = lambda *names: first_of(df, names, None).cast("double")
    return df.select("gene_id", "gene_name", "chrom", "strand", "event_type", number("max_abs_delta_psi", "delta_psi").alias("delta_psi"), number("p_value").alias("p_value"), number("fdr").alias("fdr")).withColumns({"significant": F.col("fdr") < ALPHA, "tool": F.lit(OWN)})


def rmats_results(spark: SparkSession, directory: str) -> DataFrame:
    """Union of the up to five junction-count tables that are there."""
    out = spark.createDataFrame([], SCHEMA)
    for kind in RMATS_TYPES:
        path = f"{directory}/{kind}.MATS.JC.txt"
        if exists(spark, path):
            df = read_tsv(spark, path)
            text = lambda n, d: _bare(first_of(df, (n,), d))  # noqa: B023, E731
            number = lambda n, d: F.coalesce(first_of(df, (n,), str(d)).try_cast("double"), F.lit(d))  # noqa: B023, E731
            out = out.unionByName(df.select(
                text("GeneID", "").alias("gene_id"), text("geneSymbol", "").alias("gene_name"), text("chr", "").alias("chrom"), text("strand", "+").alias("strand"), F.lit(kind).alias("event_type"),
                number("IncLevelDifference", 0.0).alias("delta_psi"), number("PValue", 1.0).alias("p_value"), number("FDR", 1.0).alias("fdr"), (number("FDR", 1.0) < ALPHA).alias("significant"), F.lit("rMATS").alias("tool"),
            ))
    return out


def numbers(text: Column) -> Column:
    """array<double> of a ;-list; empty where any item is no number."""
    items = F.filter(F.split(text, ";"), lambda x: F.trim(x) != "")
    values = F.transform(items, lambda x: F.trim(x).try_cast("double"))
    return F.when(F.exists(values, lambda v: v.isNull()), F.array().cast("array<double>")).otherwise(values)


def largest(values: Column) -> Column:
    """The value with the largest magnitude, the first of equals, 0 of none."""
    return F.aggregate(values, F.lit(0.0), lambda a, v: F.when(F.abs(v) > F.abs(a), v).otherwise(a))


def majiq_results(spark: SparkSession, path: str) -> DataFrame:
    df = read_tsv(spark, path, comment="#")
    dpsi = largest(numbers(first_of(df, ("mean_dpsi_per_lsv_junction", "E(dPSI) per LSV junction"), "0")))
    p = F.coalesce(F.array_max(numbers(first_of(df, ("P(|dPSI|>=0.20) per LSV junction", "probability_changing"), "0"))), F.lit(0.0))
    rows = df.select(
        F.trim(first_of(df, ("Gene ID", "gene_id"), "")).alias("gene_id"), F.trim(first_of(df, ("Gene Name", "gene_name"), "")).alias("gene_name"), first_of(df, ("chr", "seqid"), "").alias("chrom"), first_of(df, ("strand",), "+").alias("strand"),
        F.lit("LSV").alias("event_type"), dpsi.alias("delta_psi"), (1 - p).alias("p_value"), (1 - p).alias("fdr"), (p > 0.95).alias("significant"), F.lit("MAJIQ").alias("tool"),
    )
    return rows


def suppa2_results(spark: SparkSession, path: str) -> DataFrame:
    """Composite names GENE;TYPE:CHR:..:STRAND; the first two numeric columns are difference and p-value."""
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f"))
    head = lines.first()
    n_names = len(head.f) if head else 0
    df = read_tsv(spark, path, infer=True)
    if head and len(df.columns) and n_names and lines.filter(F.size("f") == n_names + 1).limit(1).count():
        # the header has no name for the first column
        schema = T.StructType([T.StructField("event", T.StringType())] + [T.StructField(c, T.DoubleType()) for c in head.f])
        df = spark.read.option("sep", "\t").option("nanValue", "nan").schema(schema).csv(path).filter(F.col("event") != head.f[0])
    event = F.col(f"`{df.columns[0]}`")
    numeric = [f"`{f.name}`" for f in df.schema.fields[1:] if isinstance(f.dataType, T.NumericType)]
    number = lambda i, d: F.coalesce(F.nanvl(F.col(numeric[i]).cast("double"), F.lit(None)), F.lit(d)) if len(numeric) > i else F.lit(d)
    return _suppa2(df.select(event.alias("event"), number(0, 0.0).alias("delta_psi"), number(1, 1.0).alias("p_value")))


def _suppa2(df: DataFrame) -> DataFrame:
    parts = F.split("event", ";")
    fields = F.coalesce(F.split(F.try_element_at(parts, F.lit(2)), ":"), F.array().cast("array<string>"))
    last = lambda test, d: F.coalesce(F.try_element_at(F.filter(fields, test), F.lit(-1)), F.lit(d))
    return df.select(
        F.get(parts, F.lit(0)).alias("gene_id"), F.get(parts, F.lit(0)).alias("gene_name"), last(lambda x: x.startswith("chr"), "").alias("chrom"), last(lambda x: x.isin("+", "-"), "+").alias("strand"),
        F.coalesce(F.try_element_at(fields, F.lit(1)), F.lit("Unknown")).alias("event_type"), "delta_psi", "p_value", F.col("p_value").alias("fdr"), (F.col("p_value") < ALPHA).alias("significant"), F.lit("SUPPA2").alias("tool"),
    )


# Names that other programs write.
TRUTH_NAMES = {
    "gene_id": ("gene", "gene_id", "geneid"),
    "event_type": ("event", "event_type", "type"),
    "chrom": ("chr", "chrom", "chromosome", "seqid"),
    "start": ("start",),
    "end": ("end",),
    "strand": ("strand",),
    "is_differential": ("ds_status", "differential", "is_differential"),
}


def truth_table(df: DataFrame) -> DataFrame:
    """Columns under their usual names; text is "" and numbers 0 where a column is missing."""
    lower = {c.lower().strip(): c for c in df.columns}
    out = {}
    for name, aliases in TRUTH_NAMES.items():
        found = next((F.col(f"`{lower[a]}`") for a in aliases if a in lower), None)
        if name == "is_differential":
            text = F.lit(None).cast("string") if found is None else found.cast("string")
            out[name] = F.coalesce(text.try_cast("double") != 0, text.try_cast("boolean"), F.lit(False))
        elif name in ("start", "end"):
            out[name] = F.lit(0).cast("bigint") if found is None else found.cast("bigint")
        else:
            out[name] = F.lit("") if found is None else found.cast("string")
    return df.select(*(c.alias(n) for n, c in out.items()))
