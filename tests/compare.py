"""Run registered queries and their SQL on the same tables and compare all rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, (list, tuple)):
        return tuple(_cell(i) for i in v)
    if isinstance(v, dict):
        return tuple((k, _cell(i)) for k, i in sorted(v.items()))
    return v


def _sorted(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(type(x)), x if not isinstance(x, float) else round(x, 4)) if not isinstance(x, tuple) else (False, "t", str(x)) for x in r))


SPARK_OF = {
    "INTEGER": "int", "BIGINT": "bigint", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "INTEGER[]": "array<int>", "DOUBLE[]": "array<double>", "TIMESTAMP": "timestamp_ntz",
}


def compare(df, con, sql: str) -> list[str]:
    """Differences between a Spark result and its SQL; an empty list means equal."""
    problems = []
    cols = sorted(df.columns)
    cur = con.execute(f"SELECT * FROM ({sql}) AS q")
    names = [d[0] for d in cur.description]
    if sorted(names) != cols:
        return [f"columns {cols} vs {sorted(names)}"]
    types = {r[0]: r[1] for r in con.execute(f"DESCRIBE SELECT * FROM ({sql}) AS q").fetchall()}
    spark_types = dict(df.dtypes)
    for c in cols:
        if SPARK_OF.get(types[c], types[c]) != spark_types[c]:
            problems.append(f"type of {c}: spark {spark_types[c]}, sql {types[c]}")
    sel = ", ".join(f'"{c}"' for c in cols)
    right = [tuple(_cell(v) for v in r) for r in con.execute(f"SELECT {sel} FROM ({sql}) AS q").fetchall()]
    left = [tuple(_cell(v) for v in r) for r in df.select(*[f"`{c}`" for c in cols]).collect()]
    if len(left) != len(right):
        problems.append(f"rows: spark {len(left)}, sql {len(right)}")
    left, right = _sorted(left), _sorted(right)
    bad = [(a, b) for a, b in zip(left, right) if a != b]
    if bad:
        problems.append(f"{len(bad)} rows differ, e.g. spark {bad[0][0]} sql {bad[0][1]}")
    if not left:
        problems.append("no rows")
    return problems
