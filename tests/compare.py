"""Rows of a Spark query against rows of its SQL, columns sorted by name."""

from __future__ import annotations

import math
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set threads = 4")
    for path in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {path.stem} as select * from '{path}'")
    return con


def _plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.10g}")
    if isinstance(value, Decimal):
        return format(value, "f")
    return value


def _bag(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], Counter(
        tuple(_plain(row[i]) for i in order) for row in rows
    )


def spark_rows(df):
    return _bag(df.columns, df.collect())


def sql_rows(con, sql):
    result = con.execute(sql)
    return _bag([d[0] for d in result.description], result.fetchall())


def difference(df, con, sql):
    """None when equal, else a short account of what differs."""
    names, mine = spark_rows(df)
    their_names, theirs = sql_rows(con, sql)
    if names != their_names:
        return f"columns {names} != {their_names}"
    if mine != theirs:
        return (
            f"{sum(mine.values())} vs {sum(theirs.values())} rows;"
            f" only Spark {list((mine - theirs))[:2]}; only SQL {list((theirs - mine))[:2]}"
        )
    return None
