"""A user's function once a chromosome."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def by_chromosome(rows: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, key: str = "chrom") -> DataFrame:
    """Apply `function` to each chromosome's rows, which must fit a worker; chromosomes run apart.

    The library's own operators are keyed more finely; this is for functions that need a
    chromosome whole.
    """
    return rows.groupBy(key).applyInPandas(function, schema)
