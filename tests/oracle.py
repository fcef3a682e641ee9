"""Compare a registered query with its SQL as the driver does: names, rows and values, in any order."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    if isinstance(v, int):
        return v
    return float(f"{float(v):.10g}") if type(v).__name__ == "Decimal" else v


def rows(columns, data):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in data), key=str)


def compare(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(rel.columns, rel.fetchall())
    if sorted(df.columns) != sorted(rel.columns):
        return f"columns {sorted(df.columns)} and {sorted(rel.columns)}"
    if got != want:
        first = next(((g, w) for g, w in zip(got, want) if g != w), None)
        return f"{len(got)} and {len(want)} rows, first difference {first}"
    return None if got else "no rows"
