"""Rows of a query and of its SQL in one comparable form."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pandas as pd
from conftest import TABLES


def sql_rows(sql: str, sf_dir: str) -> pd.DataFrame:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in (t for t in TABLES if Path(f"{sf_dir}/{t}.parquet").exists()):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.execute(sql).fetchdf()


def one(v: object) -> str:
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v.tolist()) if hasattr(v, "tolist") else str(v)


def canon(df: pd.DataFrame) -> list[tuple[str, ...]]:
    return sorted(tuple(map(one, r)) for r in df[sorted(df.columns)].itertuples(index=False))
