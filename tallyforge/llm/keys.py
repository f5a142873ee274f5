"""A join key for rows whose id may be null or repeated."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

KEY = "__row_key"


def row_key(id_col: str, text_col: str) -> Column:
    """Equal for rows with equal id and text: such repeated rows count as one document."""
    return F.concat_ws(
        ":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")),
        F.hex(F.xxhash64(F.col(text_col))),
    )
