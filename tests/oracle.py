"""Compare a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

import math
from collections import Counter
from datetime import datetime

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP",
}


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def bag(names, rows) -> Counter:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql: str) -> tuple[int, str]:
    """Number of rows, and what differs (empty if nothing does)."""
    cur = con.execute(sql)
    want_names = [c[0] for c in cur.description]
    want = bag(want_names, cur.fetchall())
    got = bag(df.columns, [tuple(r) for r in df.collect()])
    if sorted(df.columns) != sorted(want_names):
        return sum(got.values()), f"columns {sorted(df.columns)} != {sorted(want_names)}"
    types = {c[0]: str(c[1]) for c in cur.description}
    odd = {n: (t, types[n]) for n, t in df.dtypes if TYPES.get(t) != types[n]}
    if odd:
        return sum(got.values()), f"types {odd}"
    if got != want:
        extra, lack = got - want, want - got
        return sum(got.values()), f"{sum(extra.values())} extra {list(extra)[:3]}; {sum(lack.values())} missing {list(lack)[:3]}"
    return sum(got.values()), ""
