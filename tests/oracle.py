"""Compare a query with its SQL twin on the driver's tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"create view {name} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def normal(value):
    if isinstance(value, float):
        if math.isnan(value):
            return None
        return int(value) if value == int(value) else value
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(normal(r[i]) for i in order) for r in rows), key=repr)


def assert_equal(df, con, text):
    twin = con.sql(text)
    assert sorted(df.columns) == sorted(twin.columns)
    ours, theirs = rows_of(df.columns, df.collect()), rows_of(twin.columns, twin.fetchall())
    assert len(ours) == len(theirs)
    assert ours == theirs
