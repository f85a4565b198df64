"""Compare a query with its SQL on DuckDB, value by value."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for name in TABLES:
        path = Path(folder) / f"{name}.parquet"
        if path.exists():
            db.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return db


def _cell(value):
    if isinstance(value, float) and math.isnan(value):
        return "nan"
    return value


def _key(row):
    return tuple((v is None, str(type(v)), v if v is not None else 0) for v in row)


def normal(rows):
    return sorted((tuple(_cell(v) for v in row) for row in rows), key=_key)


def difference(df, db, sql: str) -> str | None:
    """What differs between a frame and a SQL result, None if nothing does."""
    want = db.sql(sql)
    names = sorted(want.columns)
    if sorted(df.columns) != names:
        return f"columns {sorted(df.columns)} against {names}"
    got = normal(df.select(*[f"`{n}`" for n in names]).collect())
    quoted = ", ".join(f'"{n}"' for n in names)
    expected = normal(db.sql(f"SELECT {quoted} FROM ({sql})").fetchall())
    if len(got) != len(expected):
        return f"{len(got)} rows against {len(expected)}"
    if not got:
        return "no rows at all"
    wrong = [(g, e) for g, e in zip(got, expected) if g != e]
    return f"{len(wrong)} rows differ, first {wrong[0]} of {names}" if wrong else None
