"""A query's rows against those of its SQL form in DuckDB."""

from pathlib import Path

import duckdb
import pandas as pd


def plain(value):
    if value is None or not hasattr(value, "__len__") and pd.isna(value):
        return None
    if isinstance(value, float):
        return int(value) if value.is_integer() else round(value, 6)
    if hasattr(value, "isoformat"):
        return pd.Timestamp(value).isoformat()
    if hasattr(value, "tolist"):
        return plain(value.tolist()) if not hasattr(value, "__len__") else [plain(x) for x in value.tolist()]
    return value


def rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(repr([plain(x) for x in r]) for r in frame.itertuples(index=False))


def differing(queries, forms, spark, folder, names):
    """The queries whose rows are not those of their SQL form, and those that return none."""
    base = duckdb.connect()
    base.execute("SET TimeZone = 'UTC'")
    for file in Path(folder).glob("*.parquet"):
        base.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    wrong, empty = [], []
    for name in names:
        got, want = queries[name](spark, folder).toPandas(), base.execute(forms[name]).df()
        if sorted(got.columns) != sorted(want.columns) or rows(got) != rows(want):
            wrong.append(name)
        if not len(want):
            empty.append(name)
    return wrong, empty
