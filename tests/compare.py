"""Compare a Spark result with the DuckDB result of its SQL twin."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(sf_dir, t)}.parquet')")
    return con


def _kind(t: str) -> str:
    t = t.lower()
    return {"int": "integer", "long": "bigint", "string": "varchar", "str": "varchar", "bool": "boolean"}.get(t, t)


def _norm(v):
    if isinstance(v, float):
        return "nan" if v != v else repr(v)
    return str(v)


def compare(df, con, sql: str) -> dict:
    cols = sorted(df.columns)
    got = [tuple(r[c] for c in cols) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    rel = con.sql(sql)
    names = list(rel.columns)
    want_types = {n: _kind(str(t)) for n, t in zip(names, rel.types)}
    have_types = {f.name: _kind(f.dataType.simpleString()) for f in df.schema.fields}
    out = {"rows": len(got), "columns": cols == sorted(names), "types": {}}
    if not out["columns"]:
        out["detail"] = f"{cols} vs {sorted(names)}"
        out["ok"] = False
        return out
    at = [names.index(c) for c in cols]
    want = [tuple(r[i] for i in at) for r in rel.fetchall()]
    out["types"] = {c: (have_types[c], want_types[c]) for c in cols if have_types[c] != want_types[c]}
    a = Counter(tuple(map(_norm, r)) for r in got)
    b = Counter(tuple(map(_norm, r)) for r in want)
    only_a, only_b = a - b, b - a
    out["want_rows"] = len(want)
    out["ok"] = not only_a and not only_b
    if not out["ok"]:
        out["detail"] = f"spark only {sum(only_a.values())}: {list(only_a)[:3]}\n   sql only {sum(only_b.values())}: {list(only_b)[:3]}"
    return out
