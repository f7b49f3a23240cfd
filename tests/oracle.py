"""Compares a query's rows with those that DuckDB gives for its SQL."""

from __future__ import annotations

import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.isdir(path):
            path += "/*.parquet"
        if glob.glob(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def _plain(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if hasattr(x, "item"):
        x = x.item()
    if isinstance(x, float):
        return round(x, 9)
    if isinstance(x, (list, tuple)):
        return tuple(map(_plain, x))
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted((tuple(_plain(r[k]) for k in order) for r in data), key=repr)


def differences(df, sql: str, con) -> list[str]:
    """What differs; empty if nothing does."""
    relation = con.execute(sql)
    names = [d[0] for d in relation.description]
    want, got = rows(names, relation.fetchall()), rows(df.columns, df.collect())
    wide = [n for n, d in zip(names, relation.description) if "HUGEINT" in str(d[1]) or "DECIMAL" in str(d[1])]
    if wide:
        return [f"the SQL gives wide numbers in {wide}"]
    if sorted(names) != sorted(df.columns):
        return [f"columns {sorted(df.columns)} instead of {sorted(names)}"]
    if want != got:
        odd = [(a, b) for a, b in zip(want, got) if a != b][:2]
        return [f"{len(got)} rows instead of {len(want)}; first odd (wanted, got): {odd}"]
    return []
