"""Runs a query's SQL on the same tables."""

import glob
import os

import duckdb

DATA = os.environ.get("TESTDATA", "/root/testdata/sf0.001")


def connection(d: str = DATA):
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{d}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def differs(spark, c, query, sql: str) -> str:
    from sievelight.compare import difference

    df = query(spark, DATA)
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    return difference([tuple(r) for r in df.collect()], df.columns, cur.fetchall(), names)
