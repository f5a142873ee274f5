"""Running sums that no single key can pile onto one task.

A plain ``sum() over (partition by key order by seq)`` sorts all rows of a key in one
task.  Here rows are cut into ranges of (keys, seq), as many as there are shuffle
partitions: a key that holds a third of the log spreads over a third of them.  Sums run
within each part of a key.  Only the last key of a range can go on in the next one, so
what a part has to add is at most one number per range: its key's total in the ranges
before.  Every row is summed once; the bounds of the ranges decide speed only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.sources.scratch import materialize

_RANGE = "__range"
_ALL = "__all"


def running_sums(
    rows: DataFrame,
    keys: Sequence[str],
    seq: str,
    sums: Mapping[str, tuple[Column, str]],
    ranges: int | None = None,
) -> DataFrame:
    """Add the running total, own row included, of each ``name: (column, type)``.

    `seq` is unique per key.  `keys` may be empty: then the whole table is one ordered
    log.  `ranges` defaults to the session's number of shuffle partitions.  The rows are
    written once to the scratch folder, in ranges, by zstd: they carry whole texts.
    """
    spark = rows.sparkSession
    columns, names = rows.columns, list(sums)
    keys = list(keys) or [_ALL]
    valued = rows.withColumn(_ALL, F.lit(0)).select(
        *columns, *([_ALL] if keys == [_ALL] else []),
        *[v.cast(t).alias(n) for n, (v, t) in sums.items()],
    )
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = materialize(
        valued.repartitionByRange(count, *keys, seq).withColumn(_RANGE, F.spark_partition_id()),
        "running", "zstd",
    )
    totals = ranged.groupBy(_RANGE, *keys).agg(
        *[F.coalesce(F.sum(n), F.lit(0)).cast(t).alias(n) for n, (_, t) in sums.items()]
    )
    # One row per range: its first and last key, and the last key's total there.
    edges = totals.groupBy(_RANGE).agg(
        F.min(F.struct(*keys)).alias("first"), F.max(F.struct(*keys, *names)).alias("end")
    )
    so_far = Window.partitionBy(*[f"end.{k}" for k in keys]).orderBy(_RANGE)
    through = [
        F.sum(f"end.{n}").over(so_far).cast(t).alias(n) for n, (_, t) in sums.items()
    ]
    before = Window.orderBy(_RANGE)
    ended = edges.select(_RANGE, "first", "end", F.struct(*through).alias("through"))
    offsets = ended.select(
        _RANGE, "first", F.lag(F.struct(*[f"end.{k}" for k in keys])).over(before).alias("previous"),
        F.lag("through").over(before).alias("through"),
    ).filter(F.col("first").eqNullSafe(F.col("previous"))).select(
        F.col(_RANGE).alias("__of"), F.col("first").alias("__first"), F.col("through").alias("__through")
    )
    same = reduce(
        lambda a, b: a & b,
        [F.col(k).eqNullSafe(F.col(f"__first.{k}")) for k in keys], F.col(_RANGE) == F.col("__of"),
    )
    window = (
        Window.partitionBy(_RANGE, *keys).orderBy(seq)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    # At most one row per range, thus fewer than there are tasks.
    carried = ranged.join(F.broadcast(offsets), same, "left")

    def total(name: str, kind: str) -> Column:
        carry = F.coalesce(F.col(f"__through.{name}"), F.lit(0).cast(kind))
        return (F.coalesce(F.sum(name).over(window), F.lit(0)) + carry).cast(kind).alias(name)

    return carried.select(*columns, *[total(n, t) for n, (_, t) in sums.items()])


def enumerate_rows(
    rows: DataFrame, seq: str, name: str = "prompt_idx", start: int = 0
) -> DataFrame:
    """Position of each row in the order of a unique integer column."""
    counted = running_sums(rows, [], seq, {name: (F.lit(1), "BIGINT")})
    return counted.withColumn(name, F.col(name) - 1 + start)
