"""Plans: columns are pruned, filters reach the scan, nothing multiplies tables."""

import contextlib
import io
import re

import pytest

from junctura.plans import base, catalog

SF = "/root/testdata/sf0.001"


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("name", ["reads_junction_counts", "interval_overlap_join", "psi_group_difference", "junction_confidence", "tools_concordance", "fdr_benjamini_hochberg"])
def test_no_cartesian_products(spark, name):
    assert "CartesianProduct" not in plan(catalog.QUERIES[name](spark, SF))


def test_scans_read_what_is_needed(spark):
    text = plan(catalog.QUERIES["reads_junction_counts"](spark, SF))
    schema = re.search(r"ReadSchema: (.*)", text)[1]
    assert "l_extendedprice" not in schema and "l_shipdate" not in schema
    text = plan(base.table(spark, SF, "lineitem").filter("l_suppkey = 3").select("l_orderkey"))
    assert re.search(r"PushedFilters: .*EqualTo\(l_suppkey,3\)", text)


def test_counts_are_combined_before_the_shuffle(spark):
    text = plan(catalog.QUERIES["reads_junction_counts"](spark, SF))
    assert text.count("HashAggregate") >= 2 and text.count("Exchange") >= 1
