"""Comparison of a query's rows with those of its SQL in DuckDB."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def database(sf: str = SF) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.sql(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def _text(x) -> str:
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return "~"
    if hasattr(x, "year"):
        return str(x)[:10]
    return str(x) if isinstance(x, (bool, str)) or not hasattr(x, "__float__") else repr(round(float(x), 6))


def rows(pdf: pd.DataFrame) -> list[tuple[str, ...]]:
    cols = sorted(pdf.columns)
    return sorted(tuple(map(_text, r)) for r in pdf[cols].itertuples(index=False))


def one(spark, **values):
    """A frame of one row of literals."""
    return spark.createDataFrame([tuple(values.values())], list(values))
