"""Rows of two results, as the driver compares them: columns by name, rows in any order."""

from __future__ import annotations

import numpy as np
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and v != v):
        return ""
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (int, float, np.integer, np.floating)):
        return f"{float(v):.6f}".replace("-0.000000", "0.000000")
    return str(list(v)) if isinstance(v, np.ndarray) else str(v)


def rows(df: pd.DataFrame) -> list[tuple]:
    return sorted(tuple(map(cell, r)) for r in df[sorted(df.columns)].itertuples(index=False))


def duck(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con
