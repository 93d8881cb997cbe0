"""Queries registered for the driver, by operator family, and their SQL."""

from __future__ import annotations

from . import compare, models, relational, sequences

FAMILIES = (relational, sequences, models, compare)
QUERIES = {name: query for family in FAMILIES for name, query in family.QUERIES.items()}
SQL = {name: sql for family in FAMILIES for name, sql in family.SQL.items()}


def flagship(spark, sf_dir):
    """Which modules change usage between two groups: usage, difference, depth rule, p-value, FDR, top 20."""
    return models.flagship(spark, sf_dir)
