"""Run a query and its SQL over the same tables and compare rows."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(
        tuple(repr(r[i]) for i in order) for r in rows)


SPARK_TO_SQL = {
    "bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "boolean": "BOOLEAN",
    "double": "DOUBLE",
}


def compare(spark, con, folder, query, sql) -> str | None:
    """None when equal, else a description of the difference."""
    df = query(spark, folder)
    got_cols, got = _rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want_cols, want = _rows(rel.columns, rel.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    types = {n: SPARK_TO_SQL.get(t, t) for n, t in df.dtypes}
    sql_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    if types != sql_types:
        diff = {n: (types[n], sql_types[n]) for n in types if types[n] != sql_types[n]}
        return f"types {diff}"
    if got != want:
        extra = sorted(set(got) - set(want))[:2]
        missing = sorted(set(want) - set(got))[:2]
        return f"{len(got)} rows against {len(want)}; only here {extra}; only there {missing}"
    return None
