"""Queries that SQL can express equal it."""

import pytest
from oracle import check

from junctura.llm import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_equals_sql(spark, name):
    check(spark, "/root/testdata/sf0.01", registry.QUERIES[name], registry.SQL[name])


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 13))
