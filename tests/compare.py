"""A query and its SQL on the same tables, compared as the driver does: names, rows, values in any order."""

import glob
import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def connection(sf: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{files}'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    df = df.reindex(sorted(df.columns), axis=1).astype(object)
    value = lambda v: None if v is None or v is pd.NaT or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted((tuple(value(v) for v in row) for row in df.itertuples(index=False)), key=repr)


def same(spark, con, query, sql: str, sf: str = SF) -> None:
    got, want = query(spark, sf).toPandas(), con.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)
