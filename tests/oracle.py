"""Runs a registered query and its SQL on the same tables and compares their rows as multisets."""

import collections
import datetime
import glob
import os

import duckdb

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connection():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


def plain(v):
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, float):
        return round(v, 9)
    return bytes(v) if isinstance(v, bytearray) else v


def compare(spark, query, sql):
    df = query(spark, SF)
    got = collections.Counter(tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect())
    cur = connection().execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == sorted(df.columns)
    order = [names.index(c) for c in sorted(names)]
    want = collections.Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
    return sum(got.values())
