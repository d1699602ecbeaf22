"""Rows of a query against the rows of its SQL, with values levelled as the driver levels them."""

import datetime
import glob
import os
from collections import Counter

import duckdb

FOLDER = "/root/testdata/sf0.001"


def connect(folder=FOLDER):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for f in sorted(glob.glob(f"{folder}/*.parquet")):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def level(x):
    if isinstance(x, float):
        return round(x, 6)
    if isinstance(x, datetime.datetime):
        return str(x.replace(tzinfo=None))
    if isinstance(x, (list, tuple)):
        return tuple(level(y) for y in x)
    return round(float(x), 6) if type(x).__name__ == "Decimal" else x


def same(df, con, sql):
    cols = sorted(df.columns)
    ours = Counter(tuple(level(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    theirs = Counter(tuple(level(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert ours == theirs, (list((ours - theirs).items())[:3], list((theirs - ours).items())[:3])
