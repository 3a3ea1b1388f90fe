"""Compare a registered query with its SQL in DuckDB: rows, columns, values."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir):
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    return value


def _kind(value):
    return "num" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def difference(spark_df, con, sql):
    """None when equal, else a short description."""
    names = sorted(spark_df.columns)
    got = sorted((tuple(_plain(r[n]) for n in names) for r in spark_df.collect()), key=repr)
    cur = con.execute(sql)
    sql_names = [d[0] for d in cur.description]
    if sorted(sql_names) != names:
        return f"columns {names} != {sorted(sql_names)}"
    order = [sql_names.index(n) for n in names]
    want = sorted((tuple(_plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; e.g. {list(set(got) - set(want))[:2]} / {list(set(want) - set(got))[:2]}"
    for a, b in zip(got, want):
        if a != b:
            kinds = [(n, _kind(x), _kind(y)) for n, x, y in zip(names, a, b) if _kind(x) != _kind(y)]
            return f"{names}: {a} != {b} {kinds or ''}"
    return None
