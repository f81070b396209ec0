"""Runs a query's SQL in DuckDB over the same tables and compares the rows, whatever their order."""

import decimal
import glob
import os

import duckdb


def connect(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if isinstance(v, float):
        return repr(round(v, 6))
    if isinstance(v, decimal.Decimal):
        return str(int(v)) if v == int(v) else str(v)
    return str(v)


def rows(table):
    names = sorted(table.column_names)
    cols = [table.column(n).to_pylist() for n in names]
    return names, sorted(tuple(plain(v) for v in r) for r in zip(*cols, strict=True))


def assert_same(df, con, sql):
    mine, theirs = rows(df.toArrow()), rows(con.sql(sql).to_arrow_table())
    assert mine[0] == theirs[0]
    assert len(mine[1]) == len(theirs[1])
    assert mine[1] == theirs[1]
