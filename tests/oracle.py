"""Order-insensitive comparison of a Spark query with its DuckDB oracle."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def norm(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "~"
        if isinstance(v, bool):
            return str(v)
        if isinstance(v, int | float):
            return repr(float(v))
        return str(v)

    return sorted(columns), sorted(tuple(norm(r[i]) for i in order) for r in data)


def same(spark, query, sql, sf_dir):
    df = query(spark, sf_dir)
    mine = rows(df.columns, [tuple(r) for r in df.collect()])
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    out = con.sql(sql)
    theirs = rows(out.columns, out.fetchall())
    assert mine[0] == theirs[0]
    assert mine[1] == theirs[1]
