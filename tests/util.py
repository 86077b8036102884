"""Comparison of rows by value."""

from __future__ import annotations

import os

SMALL = "/root/testdata/sf0.001"


def plain(df) -> list[tuple]:
    """Rows of a pandas frame with columns in name order, as comparable tuples."""
    import pandas as pd

    def cell(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return None
        if isinstance(x, (bool, int, str)):
            return x
        return round(float(x), 5) if type(x).__name__ in ("float", "float64", "Decimal") else str(x)

    rows = [tuple(map(cell, r)) for r in df[sorted(df.columns)].astype(object).itertuples(index=False, name=None)]
    return sorted(rows, key=lambda r: [(x is None, str(x)) for x in r])


def duck(root: str = SMALL):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(root):
        con.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{root}/{f}'")
    return con
