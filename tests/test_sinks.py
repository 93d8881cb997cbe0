"""Outputs that no task and no driver holds whole: numbering, ordered parts, sheets."""

import re
import zipfile

from pyspark.sql import functions as F

from junctura.sinks import exports, tables, workbook


def test_numbering_is_the_order_of_the_key(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(2000).select(F.concat(F.lit("m"), F.hash("id")).alias("k"), "id").distinct().repartition(7)
        got = tables.numbered(rows, "k", "idx")
        assert [(r.k, r.idx) for r in got.orderBy("idx").collect()] == [(k, i) for i, k in enumerate(sorted(r.k for r in rows.collect()))]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert tables.numbered(rows.limit(0), "k", "idx").count() == 0


def test_no_export_has_a_window_over_all_rows(spark):
    schema = "module_id string, gene_id string, gene_name string, chrom string, strand string, n_junctions int, junction_coords array<string>, psi_group1 array<double>, psi_group2 array<double>, delta_psi array<double>, delta_psi_ci_low array<double>, delta_psi_ci_high array<double>, max_abs_delta_psi double, p_value double, fdr double, event_type string"
    values = ("g", "n", "chr1", "+", 2, ["chr1:1-5:+", "chr1:1-9:+"], [0.1, 0.9], [0.5, 0.5], [0.4, -0.4], [0.1, -0.5], [0.5, -0.1], 0.4, 0.01, 0.01, "SE")
    diff = spark.createDataFrame([(f"m{k}", *values) for k in range(5)], schema)
    for made in (exports.rmats_format(diff), exports.leafcutter_format(diff), exports.bed_format(diff), exports.gtf_format(diff), exports.majiq_format(diff)):
        plan = made._jdf.queryExecution().optimizedPlan().toString()
        assert set(re.findall(r"windowspecdefinition\((\w+)", plan)) <= {"__range"}
        assert made.count() >= 5


def test_parts_are_ranges_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_tsv(spark.range(500).select(F.format_string("j%04d", "id").alias("name"), "id").repartition(5), str(tmp_path / "t"), order=["name"])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = sorted((tmp_path / "t").glob("part-*"))
    lines = [p.read_text().splitlines() for p in parts]
    assert len(parts) > 1 and all(p[0] == "name\tid" for p in lines)
    assert [x.split("\t")[0] for p in lines for x in p[1:]] == [f"j{k:04}" for k in range(500)]


def test_a_long_table_goes_on_in_the_next_sheet(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MOST_ROWS", 11)
    rows = spark.range(25).select(F.col("id").alias("n"), F.lit("green").alias("fill"))
    workbook.write_workbook(str(tmp_path / "w.xlsx"), [("Some", rows.coalesce(1)), ("None", rows.limit(0))])
    with zipfile.ZipFile(tmp_path / "w.xlsx") as z:
        names = re.findall(r'sheet name="([^"]*)"', z.read("xl/workbook.xml").decode())
        values = [re.findall(r"<v>(\d+)</v>", z.read(f"xl/worksheets/sheet{k}.xml").decode()) for k in range(1, 5)]
    assert names == ["Some", "Some 2", "Some 3", "None"]
    assert [int(v) for sheet in values for v in sheet] == list(range(25)) and [len(v) for v in values] == [10, 10, 5, 0]
