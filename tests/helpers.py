"""Comparing a query with its DuckDB SQL the way the driver does: sorted columns, any row order."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def rows(df) -> list[tuple[str, ...]]:
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(float(v)) if isinstance(v, float) else str(v) for v in r) for r in df.itertuples(index=False))
