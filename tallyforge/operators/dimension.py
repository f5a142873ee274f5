"""Join of a fact table with a small dimension, with the size checked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.settings import BROADCAST_BYTE_LIMIT, BROADCAST_ROW_LIMIT

_SALT = "__salt"


def is_small(
    table: DataFrame, row_limit: int = BROADCAST_ROW_LIMIT, byte_limit: int = BROADCAST_BYTE_LIMIT
) -> bool:
    """True when `table` holds at most `row_limit` rows and about `byte_limit` bytes.

    One job, which reads no more rows than that; values count by their length as text.
    """
    size = sum(
        (F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in table.columns), F.lit(0)
    )
    seen = table.select(size.cast("bigint").alias("size")).limit(row_limit + 1).agg(
        F.count("*").alias("rows"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")
    ).first()
    return seen["rows"] <= row_limit and seen["bytes"] <= byte_limit


def left_join_dimension(
    facts: DataFrame,
    dimension: DataFrame,
    on: str,
    spread: Sequence[str],
    row_count: int | None = None,
    row_limit: int = BROADCAST_ROW_LIMIT,
    salts: int = 32,
) -> DataFrame:
    """Left join by `on`: broadcast when the dimension is known to be small.

    `row_count` is given where the driver built the dimension; else it is counted.

    A larger dimension is repeated once per salt and shuffled.  The salt of a fact
    row is the hash of its `spread` columns, so a key that holds a third of all
    facts still spreads over `salts` tasks and a rerun salts alike.
    """
    small = is_small(dimension, row_limit) if row_count is None else row_count <= row_limit
    if small:
        return facts.join(F.broadcast(dimension), on, "left")
    salted = facts.withColumn(_SALT, F.pmod(F.xxhash64(*spread), F.lit(salts)).cast("int"))
    repeated = dimension.withColumn(
        _SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted.join(repeated, [on, _SALT], "left").drop(_SALT)
