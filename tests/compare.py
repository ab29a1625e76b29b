"""Run a query in Spark and its SQL in DuckDB, and compare names, types and values."""

from __future__ import annotations

import glob
import os

import duckdb

TYPES = {
    "string": "VARCHAR", "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "boolean": "BOOLEAN",
    "timestamp_ntz": "TIMESTAMP", "timestamp": "TIMESTAMP WITH TIME ZONE",
}


def connect(sf: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    key = lambda r: tuple((v is None, str(v)) for v in r)
    return sorted((tuple(r[i] for i in order) for r in rows), key=key)


def difference(spark, con, sf: str, query, sql: str) -> str | None:
    df = query(spark, sf)
    mine = {f.name: TYPES.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}
    described = con.execute(f"describe {sql}").fetchall()
    theirs = {r[0]: r[1] for r in described}
    if sorted(mine) != sorted(theirs):
        return f"columns differ: {sorted(mine)} / {sorted(theirs)}"
    types = {c: (mine[c], theirs[c]) for c in mine if mine[c] != theirs[c]}
    a = _rows(df.columns, [tuple(r) for r in df.collect()])
    b = _rows([r[0] for r in described], con.execute(sql).fetchall())
    if len(a) != len(b):
        return f"rows differ: {len(a)} / {len(b)}" + _first(a, b)
    if a != b:
        return "values differ" + _first(a, b)
    if types:
        return f"types differ: {types}"
    return None if a else "no rows"


def _first(a, b) -> str:
    only_a = [r for r in a if r not in set(b)][:2]
    only_b = [r for r in b if r not in set(a)][:2]
    return f"\n  spark only: {str(only_a)[:900]}\n  sql only:   {str(only_b)[:900]}"
