"""Every registered query of the library runs, and equals its SQL where it has one."""

import pytest
from oracle import check

from junctura.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_equals_sql(spark, name):
    check(spark, SF, catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.count() > 0 and df.columns


def test_whole_analysis_finds_the_genes_that_change(spark):
    found = {r.module_id.split(":")[0]: r for r in catalog.QUERIES["whole_analysis"](spark, SF).collect()}
    changed = {f"g{k}" for k in range(0, 40, 4)}
    assert len(found) == 40
    assert {g for g, r in found.items() if r.fdr < 0.05} == changed
