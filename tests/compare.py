"""Row-by-row comparison of a Spark result with its DuckDB twin."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return "\x00" if v is None else str(v)


_KINDS = {"BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean", "INTEGER": "int",
          "TIMESTAMP": "timestamp"}


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, types and rows agree."""
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    kinds = dict(zip(names, [_KINDS.get(str(d[1]), str(d[1])) for d in res.description]))
    want = [dict(zip(names, r)) for r in res.fetchall()]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(set(df.columns) ^ set(names))}"]
    found = dict(df.dtypes)
    out = [f"type {n}: spark {found[n]} sql {kinds[n]}" for n in names if found[n] != kinds[n]]
    order = sorted(names)
    left = sorted(tuple(_cell(r[n]) for n in order) for r in df.collect())
    right = sorted(tuple(_cell(r[n]) for n in order) for r in want)
    if len(left) != len(right):
        out.append(f"rows spark {len(left)} sql {len(right)}")
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        a, b = bad[0]
        out.append(f"{len(bad)} of {len(left)} rows differ, e.g. " + "; ".join(f"{n}: {x} / {y}" for n, x, y in zip(order, a, b) if x != y)[:300])
    return out
