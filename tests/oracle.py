"""Compare a query with its SQL in DuckDB."""

import math

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _key(row, order):
    return tuple(None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 7) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in (row[i] for i in order))


def check(spark, sf, query, sql):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = query(spark, sf)
    got, want = df.collect(), db.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in df.columns]
    a = sorted((_key(r, range(len(df.columns))) for r in got), key=str)
    b = sorted((_key(r, order) for r in want.fetchall()), key=str)
    assert len(a) == len(b)
    assert a == b
