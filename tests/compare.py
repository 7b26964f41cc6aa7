"""Run a query in Spark and its SQL in DuckDB and compare schema, row count and values."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def normal(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(names), sorted(out, key=repr)


_SAME = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "timestamp_ntz": "TIMESTAMP"}


def differences(df, con, sql: str) -> str | None:
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    expected_names, expected = normal(cur.fetchall(), names)
    got_names, got = normal([tuple(r) for r in df.collect()], df.columns)
    if expected_names != got_names:
        return f"columns {got_names} != {expected_names}"
    for c, k in df.dtypes:
        if _SAME.get(k) != kinds[c]:
            return f"type of {c}: {k} != {kinds[c]}"
    if len(expected) != len(got):
        return f"rows {len(got)} != {len(expected)}"
    for a, b in zip(got, expected):
        if a != b:
            return f"{a}\n != {b}"
    return None
