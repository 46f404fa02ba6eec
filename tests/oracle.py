"""Compare a registered query with its SQL on DuckDB, as multisets of rows."""

from __future__ import annotations

import datetime
from collections import Counter
from pathlib import Path

DATA = Path("/root/testdata/sf0.001")


def _plain(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return tuple(map(_plain, v)) if isinstance(v, list) else v


def same(spark, query, sql: str) -> None:
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in DATA.glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from '{p}'")
    df = query(spark, str(DATA))
    cols = sorted(df.columns)
    mine = Counter(tuple(_plain(r[k]) for k in cols) for r in df.collect())
    names = ", ".join(f'"{k}"' for k in cols)
    theirs = Counter(tuple(map(_plain, r)) for r in c.execute(f"select {names} from ({sql})").fetchall())
    assert mine == theirs
