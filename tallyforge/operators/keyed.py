"""One row per key, the last one winning, as assignment into a dict has it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def last_per_key(rows: DataFrame, keys: Sequence[str], seq: Sequence[str]) -> DataFrame:
    """Keep the row with the greatest `seq` per key.

    An aggregate, not a window: copies of a hot key collapse in each map task before
    the shuffle.  Afterwards a prompt has one row per model, which bounds every
    later per-prompt group by the length of the model list.
    """
    rest = [f for f in rows.schema.fields if f.name not in keys and f.name not in seq]
    columns = [*seq, *[f.name for f in rest]]
    if all(_orderable(f.dataType) for f in rest):
        # One struct in the shuffle; equal `seq` values are told apart by the rest.
        last = F.max(F.struct(*columns))
    else:
        last = F.max_by(F.struct(*columns), F.struct(*seq))
    kept = rows.groupBy(*keys).agg(last.alias("kept"))
    return kept.select(*keys, "kept.*")


def _orderable(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return all(_orderable(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return _orderable(kind.elementType)
    return not isinstance(kind, (T.MapType, T.VariantType))
