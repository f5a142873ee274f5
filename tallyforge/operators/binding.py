"""Columns that are computed once per row, however often they are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(rows: DataFrame, **values: Column) -> DataFrame:
    """Add columns behind a generator of one row.

    Catalyst copies the expression of a plain column into every filter and
    projection that reads it; parsing one JSON text would then happen once per use.
    It never copies what a generator makes.
    """
    once = F.array(F.struct(*[v.alias(n) for n, v in values.items()]))
    return rows.select("*", F.inline_outer(once))
