"""A live cost tracker that can be reset, for calls that arrive in any order.

Every call is a row of its own, by session and number, until nothing can change it: a late
reset splits a session where it stands, and a call that is delivered again replaces itself.
A read takes the last delivery of each call and numbers the sessions by running sums over
ranges of (session, call), so neither many short sessions nor one endless one meet in a task.

With a `horizon`, a session's calls are looked at in blocks of call numbers.  Once the newest
timestamp of the log is that far ahead of a block's newest call, the next snapshot folds the
block: each part between resets becomes one row, in the place of its first call, with the
part's sums.  Calls that arrive for a folded block are dropped: they cannot be numbered any
more.  Without a horizon, calls are kept as long as the tracker lives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators.cost import price_calls
from tallyforge.operators.keyed import last_per_key
from tallyforge.operators.running import running_sums
from tallyforge.settings import PriceBook
from tallyforge.streaming.live import BATCH, COMPACT_EVERY, run_merged

BLOCK_CALLS = 4096

_BLOCK = ["session_id", "block"]


def _last_calls(rows: DataFrame) -> DataFrame:
    """The last delivery of a call counts."""
    return last_per_key(rows, [*_BLOCK, "call_seq"], [BATCH])


def _folded(rows: DataFrame, horizon: str) -> DataFrame:
    """The last calls, those of blocks older than the horizon as one row per part."""
    # A block's calls at most are in one window.
    block = Window.partitionBy(*_BLOCK)
    open_or_folded = rows.withColumn("closed", F.max("is_folded").over(block)).filter(
        F.col("is_folded") | ~F.col("closed")
    ).drop("closed")
    last = _last_calls(open_or_folded)
    newest = rows.agg(F.max("at_ms").alias("newest"))
    aged = last.withColumn("block_ms", F.max("at_ms").over(block)).crossJoin(F.broadcast(newest)).withColumn(
        "is_old", F.timestamp_millis("block_ms") + F.expr(f"INTERVAL {horizon}") < F.timestamp_millis("newest")
    )
    parts = aged.filter("is_old").withColumn("part", F.sum("is_reset").over(block.orderBy("call_seq")))
    # Only a part's first call can be a reset.
    sums = parts.groupBy(*_BLOCK, "part").agg(
        F.min("call_seq").alias("call_seq"), F.sum("calls").alias("calls"), F.sum("nano").alias("nano"),
        F.max("is_reset").alias("is_reset"), F.max("at_ms").alias("at_ms"), F.lit(True).alias("is_folded"),
        F.max(BATCH).alias(BATCH),
    )
    return aged.filter("NOT is_old").select(rows.columns).unionByName(sums.select(rows.columns))


def run_reset_sessions(
    calls: DataFrame, path: str, is_reset: Column, prices: PriceBook | DataFrame = PriceBook(),
    block_calls: int = BLOCK_CALLS, horizon: str | None = None, compact_every: int = COMPACT_EVERY,
) -> DataFrame:
    """Drain what has arrived; calls and total so far per (session_id, session_no).

    `session_no` counts the session's resets up to and including a call, as
    `number_sessions` does; the call that resets belongs to what it starts.  Calls without
    session or number are left out.
    """
    numbered = price_calls(calls, prices).withColumn("is_reset", F.coalesce(is_reset, F.lit(False)))
    keyed = numbered.filter("session_id IS NOT NULL AND call_seq IS NOT NULL").select(
        F.col("session_id").cast("bigint").alias("session_id"),
        F.floor(F.col("call_seq") / block_calls).cast("bigint").alias("block"),
        F.col("call_seq").cast("bigint").alias("call_seq"),
        F.lit(1).cast("bigint").alias("calls"),
        (F.col("cost") * 1_000_000_000).cast("bigint").alias("nano"),
        F.col("is_reset").cast("bigint").alias("is_reset"),
        F.coalesce(F.unix_millis("ts"), F.lit(0)).alias("at_ms"),
        F.lit(False).alias("is_folded"),
    )

    def merge(rows: DataFrame) -> DataFrame:
        return _folded(rows, horizon) if horizon else _last_calls(rows)

    latest = run_merged(keyed, path, merge, compact_every).select(
        "session_id", "call_seq", "calls", "nano", "is_reset"
    )
    through = running_sums(latest, ["session_id"], "call_seq", {"session_no": (F.col("is_reset"), "BIGINT")})
    return through.groupBy("session_id", "session_no").agg(
        F.sum("calls").alias("calls"),
        (F.sum("nano").cast("decimal(28,0)") / F.lit(1_000_000_000).cast("decimal(10,0)"))
        .cast(schemas.TOTAL_COST).alias("total"),
    )
