"""Run a query and its SQL side by side and compare the rows."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = os.path.join(folder, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def kind(value) -> str:
    return "number" if isinstance(value, (int, float)) and not isinstance(value, bool) else type(value).__name__


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return sorted(columns), sorted(out, key=repr)


def from_spark(df):
    return rows_of(df.columns, [tuple(r) for r in df.collect()])


def from_sql(con, sql):
    result = con.execute(sql)
    return rows_of([d[0] for d in result.description], result.fetchall())


def spark_types(df):
    names = {"bigint": "int", "int": "int", "double": "float", "string": "str", "boolean": "bool"}
    return {f.name: names.get(f.dataType.simpleString(), f.dataType.simpleString()) for f in df.schema}


def sql_types(con, sql):
    names = {"BIGINT": "int", "INTEGER": "int", "DOUBLE": "float", "VARCHAR": "str", "BOOLEAN": "bool"}
    return {d[0]: names.get(str(d[1]), str(d[1])) for d in con.execute(f"SELECT * FROM ({sql}) LIMIT 0").description}


def difference(df, con, sql) -> str | None:
    """None when both sides agree; else what differs first."""
    got_types, want_types = spark_types(df), sql_types(con, sql)
    if got_types != want_types:
        return f"types differ: {got_types} vs {want_types}"
    columns, got = from_spark(df)
    _, want = from_sql(con, sql)
    if got == want:
        return None
    extra, missing = sorted(set(got) - set(want), key=repr)[:3], sorted(set(want) - set(got), key=repr)[:3]
    return f"{columns}: {len(got)} rows vs {len(want)}; only here {extra}; only there {missing}"
