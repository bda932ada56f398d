"""Row-by-row comparison of a Spark result with the result of its SQL twin."""

from __future__ import annotations

import math

import duckdb

from fieldglass.workload.views import TABLES

#: The smallest tables.
DATA = "/root/testdata/sf0.001"


def connect(data: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{data}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 5)
    if isinstance(value, int):
        return float(value)
    if type(value).__name__ == "Decimal":
        return round(float(value), 5)
    return str(value)


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    """Empty when both sides have the same columns, type families and rows."""
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    kinds = {d[0]: str(d[1]) for d in found.description}
    want = found.fetchall()
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} vs {sorted(names)}"]
    families = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    odd = [f"type of {n}: {t} vs {kinds[n]}" for n, t in df.dtypes
           if families.get(t) != kinds[n] and not (t in families and kinds[n] == '"NULL"')]
    order = sorted(names)
    got = [tuple(_plain(r[c]) for c in order) for r in df.collect()]
    at = [names.index(c) for c in order]
    exp = [tuple(_plain(r[i]) for i in at) for r in want]
    if len(got) != len(exp):
        odd.append(f"rows {len(got)} vs {len(exp)}")
    key = lambda r: tuple(str(x) for x in r)
    got.sort(key=key), exp.sort(key=key)
    extra = [g for g in set(got) - set(exp)][:limit]
    missing = [e for e in set(exp) - set(got)][:limit]
    if got != exp:
        odd.append(f"columns {order}; only Spark {extra}; only SQL {missing}")
    return odd
