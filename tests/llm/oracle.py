"""DuckDB over the tables of one folder."""

from __future__ import annotations

import glob
import os

import duckdb


def answer(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in ("documents", "embeddings", "conversations", "labels"):
        path = f"{sf_dir}/{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'" if glob.glob(path) else "SELECT 1")
    got = con.execute(sql)
    return [d[0] for d in got.description], got.fetchall()


def same(df, sf_dir: str, sql: str) -> bool:
    names, rows = answer(sf_dir, sql)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    return sorted(df.columns) == sorted(names) and sorted((tuple(r) for r in df.select(*names).collect()), key=key) == sorted(rows, key=key)
