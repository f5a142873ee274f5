"""Arrow batches as byte arrays, cut so that one block of texts stays small."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK_BYTES = 2 << 20
BLOCK_ROWS = 2048

_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


@contextmanager
def small_batches(spark: SparkSession, limit: int = BLOCK_BYTES) -> Iterator[None]:
    """Jobs started in here hand rows to Python in batches of about `limit` bytes, or of one row.

    By count alone, a batch holds 10,000 rows, whole texts or blocks: it is built outside the
    JVM's heap, in buffers that double as they grow, and once more in Python.
    """
    old = spark.conf.get(_BATCH_CONF, None)
    spark.conf.set(_BATCH_CONF, str(limit))
    try:
        yield
    finally:
        if old is None:
            spark.conf.unset(_BATCH_CONF)
        else:
            spark.conf.set(_BATCH_CONF, old)


def text_blocks(
    batches: Iterable[pa.RecordBatch], text_col: str, limit: int = BLOCK_BYTES,
    max_rows: int = BLOCK_ROWS,
) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of at most `limit` text bytes and `max_rows` rows, or of
    one row."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.binary_length(batch.column(text_col)).fill_null(0)
        ends = np.cumsum(sizes.to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + limit, "right")))
            stop = min(stop, start + max_rows)
            yield batch.slice(start, stop - start)
            start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts in one array, and where each text starts and the last ends.

    A null text counts as empty.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if column.offset:
        column = pa.concat_arrays([column])
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1)
    data = column.buffers()[2]
    first, last = int(offsets[0]), int(offsets[-1])
    if data is None or first == last:
        return np.zeros(0, np.uint8), offsets - first
    return np.frombuffer(data, np.uint8, last)[first:], offsets - first


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; other bytes stay."""
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def word_spans(
    is_word: np.ndarray, offsets: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of word bytes within a text, and the first
    word's number of each text (with the total at the end)."""
    n = len(is_word)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    cut = np.zeros(n + 1, bool)
    cut[offsets[:-1]] = True
    cut[n] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | cut[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | cut[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def whole_groups(
    batches: Iterable[pa.RecordBatch], keys: list[str], limit: int = 1 << 16
) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Sorted rows in tables of whole groups, with the first row of each group and the
    number of rows at the end.  A table holds at most twice `limit` rows, or one group."""
    held: list[pa.RecordBatch] = []
    rows = 0
    pieces = (b.slice(i, limit) for b in batches for i in range(0, b.num_rows, limit))
    for batch in pieces:
        held.append(batch)
        rows += batch.num_rows
        if rows < limit:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        starts = _group_starts(table, keys)
        last = int(starts[-1])
        held, rows = table.slice(last).to_batches(), table.num_rows - last
        if last:
            yield table.slice(0, last), starts
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, np.append(_group_starts(table, keys), table.num_rows)


def _group_starts(table: pa.Table, keys: list[str]) -> np.ndarray:
    changed = np.zeros(table.num_rows, bool)
    changed[0] = True
    for key in keys:
        values = table.column(key)
        differs = pc.not_equal(values.slice(1), values.slice(0, table.num_rows - 1))
        changed[1:] |= differs.to_numpy(zero_copy_only=False)
    return np.flatnonzero(changed)
