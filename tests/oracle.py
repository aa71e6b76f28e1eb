"""Run a registered query and its SQL over the same tables and compare them."""

from __future__ import annotations

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted(
        (tuple(row[i] for i in order) for row in rows), key=lambda r: tuple(map(repr, r))
    )


def kind(value):
    return {bool: "bool", int: "int", float: "float", str: "str"}.get(type(value), type(value).__name__)


def differences(spark_df, con, sql: str) -> list[str]:
    """Empty when columns, rows, values and value kinds agree."""
    got_cols, got = canonical(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    rel = con.execute(sql)
    want_cols, want = canonical([d[0] for d in rel.description], rel.fetchall())
    if got_cols != want_cols:
        return [f"columns {got_cols} vs {want_cols}"]
    if len(got) != len(want):
        return [f"rows {len(got)} vs {len(want)}"]
    out = []
    for g, w in zip(got, want):
        if tuple(map(repr, g)) != tuple(map(repr, w)) or list(map(kind, g)) != list(map(kind, w)):
            out.append(f"{g} vs {w}")
    return out[:5] + ([f"... {len(out)} rows differ"] if len(out) > 5 else [])
