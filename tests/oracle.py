"""Holds a query's rows against DuckDB's."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(root: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def _plain(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows[sorted(rows.columns)].copy()
    for c in rows.columns:
        if pd.api.types.is_datetime64_any_dtype(rows[c]):
            rows[c] = rows[c].astype("datetime64[us]").astype(str)
        elif pd.api.types.is_numeric_dtype(rows[c]) and not pd.api.types.is_bool_dtype(rows[c]):
            rows[c] = rows[c].astype("float64").round(4)
        else:
            rows[c] = rows[c].astype(object).where(rows[c].notna(), None).map(str)  # a null is None here and <NA> there
    return rows.sort_values(list(rows.columns)).reset_index(drop=True)


def same(found: pd.DataFrame, wanted: pd.DataFrame) -> None:
    pd.testing.assert_frame_equal(_plain(found), _plain(wanted), check_dtype=False, rtol=1e-6)
