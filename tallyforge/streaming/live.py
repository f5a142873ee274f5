"""Costs and win tallies over logs that keep arriving."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge import schemas
from tallyforge.operators.cost import cost_rollup, price_calls
from tallyforge.operators.keyed import last_per_key
from tallyforge.operators.winners import named_winner
from tallyforge.settings import PriceBook

COMPACT_EVERY = 16

BATCH, _SLOT = "batch_id", "slot"


def live_cost_rollup(
    calls: DataFrame, prices: PriceBook | DataFrame = PriceBook()
) -> DataFrame:
    """Calls and cost so far per (session, book, model).

    State is one row per key for as long as the tracker lives; where sessions never
    end, `run_window_costs` keeps none.
    """
    return cost_rollup(price_calls(calls, prices))


def cost_per_window(
    calls: DataFrame, width: str, prices: PriceBook | DataFrame = PriceBook()
) -> DataFrame:
    """Calls and cost per time window, book and model of a table of calls."""
    return price_calls(calls, prices).groupBy(F.window("ts", width), "book", "model").agg(
        F.count("*").alias("calls"), F.sum("cost").cast(schemas.TOTAL_COST).alias("cost")
    ).select("window.start", "window.end", "book", "model", "calls", "cost")


def live_win_tally(winners: DataFrame, order: str = "prompt_id") -> DataFrame:
    return winners.filter(named_winner(F.col("winner"))).groupBy("winner").agg(
        F.count("*").alias("wins"), F.min(order).alias("first_win")
    )


def run_updates(
    stream: DataFrame, path: str, keys: Sequence[str], compact_every: int = COMPACT_EVERY
) -> DataFrame:
    """Drain what has arrived; return the latest row per key."""

    def latest(rows: DataFrame) -> DataFrame:
        return last_per_key(rows, keys, [BATCH])

    return _drain(stream, path, lambda batch: batch, latest, compact_every, "update")


def run_merged(
    stream: DataFrame, path: str, merge: Callable[[DataFrame], DataFrame],
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Drain the rows that have arrived; return all of them merged.

    `merge` sees each row's batch in the column `BATCH` and keeps it; it may be applied to
    what it gave before.
    """
    return _drain(stream, path, lambda batch: batch, merge, compact_every, "append")


def run_window_costs(
    calls: DataFrame, path: str, width: str, prices: PriceBook | DataFrame = PriceBook(),
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Drain what has arrived; return calls and cost of every window so far.

    A micro-batch adds its own sums per window, so there is no state to bound by a
    watermark: windows still open are there, and a call counts however late it comes.
    """

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("start", "end", "book", "model").agg(
            F.sum("calls").alias("calls"), F.sum("cost").cast(schemas.TOTAL_COST).alias("cost"),
            F.max(BATCH).alias(BATCH),
        )

    return _drain(
        calls, path, lambda batch: cost_per_window(batch, width, prices), sums, compact_every, "append"
    )


def run_call_costs(
    calls: DataFrame, path: str, prices: PriceBook | DataFrame = PriceBook(),
    compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Drain what has arrived; return calls and cost so far per (session, book, model).

    Like `live_cost_rollup`, but each micro-batch adds its own sums, so the stream may be
    one that already keeps state (`read_call_stream`).
    """

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("session_id", "book", "model").agg(
            F.sum("calls").alias("calls"), F.sum("cost").cast(schemas.TOTAL_COST).alias("cost"),
            F.min("first_seq").alias("first_seq"), F.max(BATCH).alias(BATCH),
        )

    return _drain(
        calls, path, lambda batch: live_cost_rollup(batch, prices), sums, compact_every, "append"
    )


def _drain(
    stream: DataFrame, path: str, rows_of: Callable[[DataFrame], DataFrame],
    merge: Callable[[DataFrame], DataFrame], compact_every: int, mode: str,
) -> DataFrame:
    """Write each micro-batch's rows, merged now and then; return all of them merged.

    Batches are written to a ring of folders, so one that is repeated after a failure
    overwrites itself.  Every `compact_every` batches the snapshot and the batches after
    it are merged into a new snapshot, which goes to the other one of two folders; then a
    manifest beside it names the last batch it holds.  A snapshot without its manifest
    does not count, so a merge that fails leaves the older one and all batches after it
    valid.  Folders are overwritten only once a newer snapshot holds what is in them: what
    lies on disk, as what a read takes in, follows the number of keys and not the age of
    the stream.

    The table returned stays readable until the second snapshot after it.  The ring's
    size is fixed by the stream's first drain; a later `compact_every` can shorten the
    time between snapshots, and lengthen it up to half the ring.
    """
    spark = stream.sparkSession
    empty = rows_of(spark.createDataFrame([], stream.schema))
    nullable = [T.StructField(f.name, f.dataType) for f in empty.schema.fields]
    kept = T.StructType([*nullable, T.StructField(BATCH, T.LongType())])
    updates = f"{path}/updates"
    found = _manifest(spark, path)
    valid = found or _Manifest(slot=0, upto=-1, ring=2 * compact_every)
    every = min(compact_every, valid.ring // 2)
    last = None

    def newer(last: int) -> DataFrame:
        """Rows of the batches after the snapshot, up to `last`."""
        slots = ",".join(str(i % valid.ring) for i in range(valid.upto + 1, last + 1))
        rows = _read(spark, f"{updates}/{_SLOT}={{{slots}}}", kept)
        return rows.filter(F.col(BATCH).between(valid.upto + 1, last))

    def so_far(last: int) -> DataFrame:
        """Rows of all batches up to `last`: the valid snapshot and what came after."""
        rows = spark.createDataFrame([], kept)
        if valid.upto >= 0:
            rows = _read(spark, f"{path}/snapshots/{_SLOT}={valid.slot}", kept)
        return merge(rows.unionByName(newer(last)) if last > valid.upto else rows)

    def write(batch: DataFrame, batch_id: int) -> None:
        nonlocal valid, last
        if batch_id <= valid.upto:  # The snapshot has it; only its commit was lost.
            return
        if found is None and last is None:
            if batch_id > 0:
                raise ValueError(f"{path}: the stream is at batch {batch_id}, but no manifest is there")
            _write_manifest(spark, path, valid)
        rows_of(batch).withColumn(BATCH, F.lit(batch_id).cast("bigint")).write.mode(
            "overwrite"
        ).parquet(f"{updates}/{_SLOT}={batch_id % valid.ring}")
        last = batch_id
        if batch_id - valid.upto >= every:
            newest = _Manifest(slot=1 - valid.slot, upto=batch_id, ring=valid.ring)
            so_far(batch_id).select(kept.names).write.mode("overwrite").parquet(
                f"{path}/snapshots/{_SLOT}={newest.slot}"
            )
            _write_manifest(spark, path, newest)
            valid = newest

    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", f"{path}/state")
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )
    query.awaitTermination()
    if last is None:  # Nothing arrived: ask the folders of the batches after the snapshot.
        last = newer(valid.upto + valid.ring // 2).agg(F.max(BATCH)).first()[0]
    return so_far(valid.upto if last is None else last).drop(BATCH)


class _Manifest(NamedTuple):
    """Names the snapshot that holds all batches up to `upto`."""

    slot: int
    upto: int
    ring: int


_MANIFEST = T.StructType([T.StructField(f, T.LongType()) for f in _Manifest._fields])


def _manifest(spark: SparkSession, path: str) -> _Manifest | None:
    """The newest complete manifest: one of two rows at most."""
    found = _read(spark, f"{path}/manifests/{_SLOT}=*", _MANIFEST).collect()
    return max((_Manifest(*row) for row in found), key=lambda m: m.upto, default=None)


def _write_manifest(spark: SparkSession, path: str, manifest: _Manifest) -> None:
    row = spark.createDataFrame([tuple(manifest)], _MANIFEST)
    row.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifests/{_SLOT}={manifest.slot}")


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of the folders that match `path`; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)
