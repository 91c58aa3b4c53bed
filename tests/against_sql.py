"""Runs a query on Spark and its SQL on DuckDB and compares the rows."""

import os

import duckdb

DATA = os.environ.get("QUARRY_TESTDATA", "/root/testdata/sf0.001")


def plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if hasattr(value, "to_pydatetime"):
        return value.to_pydatetime()
    return value


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(plain(r[k]) for k in order)) for r in found)


def compare(spark, query, sql):
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.sql(f"create view {name.split('.')[0]} as select * from read_parquet('{DATA}/{name}')")
    df = query(spark, DATA)
    want = con.sql(sql)
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
