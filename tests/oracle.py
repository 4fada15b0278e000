"""Compare a registered query with its SQL in DuckDB."""

from __future__ import annotations

import math
import os

import duckdb

from murmurate.session import TABLES


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    if isinstance(value, (list, tuple)):
        return tuple(plain(x) for x in value)
    if type(value).__name__ == "Decimal":
        return float(f"{float(value):.9g}")
    return str(value)[:19] if hasattr(value, "isoformat") else value


def rows(columns, found):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted((tuple(plain(r[i]) for i in order) for r in found), key=lambda r: tuple((v is None, str(v)) for v in r))


def compare(spark, con, folder, query, sql):
    df = query(spark, folder)
    rel = con.sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert rows(df.columns, df.collect()) == rows(list(rel.columns), rel.fetchall())
