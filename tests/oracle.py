"""Comparison of a query with its SQL on the same tables."""

from __future__ import annotations

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _cell(v) -> str:
    if v is None or (not isinstance(v, (list, str)) and pd.isna(v)):
        return "~"
    if type(v).__name__ in ("bool", "bool_"):
        return str(bool(v))
    if isinstance(v, (int, float)) or type(v).__module__ == "numpy":
        return repr(round(float(v), 6))
    return str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(_cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))
