"""Compares a query with its SQL twin."""

import math
import os
from collections import Counter


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if getattr(v, "tzinfo", None):
        v = v.replace(tzinfo=None)
    return str(v)


def connect(path):
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(path):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{path}/{f}'")
    return c


def same(df, sql, path):
    columns = sorted(df.columns)
    got = Counter("|".join(plain(r[c]) for c in columns) for r in df.collect())
    found = connect(path).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = Counter("|".join(plain(row[names.index(c)]) for c in columns) for row in found.fetchall())
    assert got == want, (list((got - want))[:3], list((want - got))[:3])
