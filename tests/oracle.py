"""Compare a query with its DuckDB twin: columns, rows and values, floats at six digits."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    one = lambda v: repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)
    return sorted(tuple(one(r[i]) for i in order) for r in rows)


def same(spark, query, sql, sf_dir):
    df, want = query(spark, sf_dir), connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert plain(df.collect(), df.columns) == plain(want.fetchall(), want.columns)
