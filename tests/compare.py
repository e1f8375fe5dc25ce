"""Holds a query's rows against its SQL in DuckDB."""

import datetime
import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def views(folder: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, decimal.Decimal):
        return ("decimal", x)
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, con, name, run, sql, folder):
    got = run(spark, folder)
    want = con.sql(sql)
    if sorted(got.columns) != sorted(want.columns):
        return f"{name}: columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = rows_of(got.columns, [tuple(r) for r in got.collect()]), rows_of(want.columns, want.fetchall())
    if a != b:
        bad = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        return f"{name}: {len(a)} and {len(b)} rows; at {bad}: {a[bad : bad + 2]} and {b[bad : bad + 2]}"
    return None if a else f"{name}: no rows"
