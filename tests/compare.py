"""Compares a query with its oracle SQL in DuckDB."""

import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        at = f"{sf_dir}/{name}"
        con.execute(f"CREATE VIEW {name[:-8]} AS SELECT * FROM '{at + '/*.parquet' if os.path.isdir(at) else at}'")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def plain(v):
        if v is None or isinstance(v, float) and math.isnan(v):
            return "null"
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(v)

    return sorted(columns), sorted(tuple(plain(row[i]) for i in order) for row in values)


def check(spark, sf_dir, query, sql):
    got = query(spark, sf_dir)
    con = connect(sf_dir)
    result = con.execute(sql)
    want = rows([c[0] for c in result.description], result.fetchall())
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == want
    return len(want[1])
