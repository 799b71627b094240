"""Side-by-side comparison of a Spark result and the checking SQL."""

from __future__ import annotations

import datetime as dt
import decimal
import math
from pathlib import Path

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        path = Path(folder) / f"{table}.parquet"
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path}')")
    return con


def kind(value):
    if value is None:
        return None
    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "int"
    if isinstance(value, float):
        return "float"
    return type(value).__name__


def canonical(value):
    if isinstance(value, float):
        if math.isnan(value):
            return "NaN"
        return repr(0.0 if value == 0 else value)
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, decimal.Decimal):
        raise TypeError("decimal in a result: cast it to double")
    return repr(value)


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(canonical(r[i]) for i in order) for r in rows)


def kinds(columns, rows):
    found = {}
    for i, c in enumerate(columns):
        found[c] = {kind(r[i]) for r in rows} - {None}
    return found


def differences(df, con, sql) -> list[str]:
    """Empty when both sides agree on columns, value kinds and every value."""
    spark_rows = [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    sql_columns = [d[0] for d in cursor.description]
    huge = [d[0] for d in cursor.description if str(d[1]) in ("HUGEINT", "INT128")]
    sql_rows = cursor.fetchall()
    left, a = sorted_rows(df.columns, spark_rows)
    right, b = sorted_rows(sql_columns, sql_rows)
    problems = [f"check column {c} is a 128-bit integer" for c in huge]
    if left != right:
        return problems + [f"columns {left} != {right}"]
    ka, kb = kinds(df.columns, spark_rows), kinds(sql_columns, sql_rows)
    problems += [f"kind of {c}: {ka[c]} != {kb[c]}" for c in ka if ka[c] != kb[c]]
    if len(a) != len(b):
        problems.append(f"rows {len(a)} != {len(b)}")
    if a != b:
        only_a, only_b = sorted(set(a) - set(b)), sorted(set(b) - set(a))
        problems.append(f"{len(only_a)} rows only in Spark, {len(only_b)} only in SQL; {left}\n"
                        f"   spark {only_a[:3]}\n   sql   {only_b[:3]}")
    return problems
