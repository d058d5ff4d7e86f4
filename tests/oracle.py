"""Side-by-side comparison of registered queries with their DuckDB SQL."""

import os
from collections import Counter
from datetime import date, datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v + 0.0)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, date):
        return v.isoformat()
    return (type(v).__name__, str(v)) if v is not None else None


def compare(df, con, sql):
    """None if equal, else what differs."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    order = [df.columns.index(n) for n in sorted(df.columns)]
    got = Counter(tuple(plain(r[i]) for i in order) for r in df.collect())
    worder = [names.index(n) for n in sorted(names)]
    exp = Counter(tuple(plain(r[i]) for i in worder) for r in want)
    if got != exp:
        return f"{sum(got.values())} and {sum(exp.values())} rows; only ours {list((got - exp).items())[:3]}; only theirs {list((exp - got).items())[:3]}"
    return None
