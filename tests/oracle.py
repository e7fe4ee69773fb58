"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _value(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    picked = [tuple(_value(r[i]) for i in order) for r in rows]
    return [names[i] for i in order], sorted(picked, key=lambda r: tuple(str(v) for v in r))


def differences(df, con, sql: str) -> list[str]:
    """Empty when columns, types of Python values and all rows agree."""
    ours = _rows(df.columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    theirs = _rows(names, result.fetchall())
    if ours[0] != theirs[0]:
        return [f"columns {ours[0]} != {theirs[0]}"]
    out = []
    if len(ours[1]) != len(theirs[1]):
        out.append(f"rows {len(ours[1])} != {len(theirs[1])}")
    out += [f"{a} != {b}" for a, b in zip(ours[1], theirs[1]) if a != b][:5]
    kinds = [
        (n, {type(v) for v in c} - {type(None)}, {type(v) for v in d} - {type(None)})
        for n, c, d in zip(ours[0], zip(*ours[1]), zip(*theirs[1]))
    ]
    out += [f"{n}: {a} != {b}" for n, a, b in kinds if a != b]
    return out
