import random
import shutil
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import cost as C
from tallyforge.operators import winners as W
from tallyforge.sources.responses import read_call_log, read_call_stream
from tallyforge.sources.scratch import scratch_path
from tallyforge.streaming import live
from tallyforge.streaming.tracker import run_reset_sessions

START = datetime(2024, 1, 1)


def calls(spark, first, last):
    return spark.createDataFrame(
        [(n % 3, n, START + timedelta(minutes=n), ["gpt-4", "x"][n % 2], ["judge", "model"][n % 5 > 0], n, 2 * n)
         for n in range(first, last)],
        schemas.CALL_LOG,
    )


def stream(spark, path):
    return spark.readStream.schema(schemas.CALL_LOG).option("maxFilesPerTrigger", 1).parquet(path)


def test_live_rollup_equals_the_batch_rollup_after_each_drain(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "rollup")
    keys = ["session_id", "book", "model"]
    for first, last in ((0, 40), (40, 95)):
        calls(spark, first, last).write.mode("append").parquet(log)
        live_rows = live.run_updates(live.live_cost_rollup(stream(spark, log)), out, keys)
        batch = C.cost_rollup(C.price_calls(read_call_log(spark, log)))
        columns = sorted(batch.columns)
        assert sorted(live_rows.select(columns).collect()) == sorted(batch.select(columns).collect())


def test_windows_count_open_hours_and_late_calls(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "windows")
    # Files arrive in the wrong order, hours late.
    for first, last in ((120, 200), (0, 60), (60, 120)):
        calls(spark, first, last).coalesce(1).write.mode("append").parquet(log)
        rows = live.run_window_costs(stream(spark, log), out, "1 hour", compact_every=2)
        batch = live.cost_per_window(read_call_log(spark, log), "1 hour")
        assert sorted(rows.select(batch.columns).collect()) == sorted(batch.collect())
    assert {r.start for r in rows.collect()} == {START + timedelta(hours=h) for h in range(4)}
    assert sum(r.calls for r in rows.collect()) == 200


def test_reads_follow_the_keys_and_not_the_batches(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "rollup")
    keys = ["session_id", "book", "model"]
    files = []
    for n in range(12):
        calls(spark, 30 * n, 30 * n + 30).coalesce(1).write.mode("append").parquet(log)
        rows = live.run_updates(live.live_cost_rollup(stream(spark, log)), out, keys, compact_every=3)
        files.append(len(rows.inputFiles()))
    batch = C.cost_rollup(C.price_calls(read_call_log(spark, log)))
    columns = sorted(batch.columns)
    assert sorted(rows.select(columns).collect()) == sorted(batch.select(columns).collect())
    # After a snapshot nothing older is read.
    assert files[11] <= files[2] and files[8] <= files[2]


def on_disk(path):
    """Bytes and folders of a stream's rows."""
    found = [f for part in ("updates", "snapshots", "manifests") for f in Path(path, part).rglob("*")]
    return sum(f.stat().st_size for f in found if f.is_file()), sum(f.is_dir() for f in found)


def test_what_lies_on_disk_follows_the_keys_and_not_the_batches(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "rollup")
    sizes = []
    for n in range(5):
        for file in range(4):
            first = 120 * n + 30 * file
            calls(spark, first, first + 30).coalesce(1).write.mode("append").parquet(log)
        rows = live.run_call_costs(stream(spark, log), out, compact_every=2)
        sizes.append(on_disk(out))
    batch = C.cost_rollup(C.price_calls(read_call_log(spark, log)))
    columns = sorted(batch.columns)
    assert sorted(rows.select(columns).collect()) == sorted(batch.select(columns).collect())
    # Four folders of updates, two of snapshots, two of manifests; the same keys in each drain.
    assert all(folders == 8 for _, folders in sizes[1:])
    assert max(size for size, _ in sizes[1:]) < 1.1 * min(size for size, _ in sizes[1:])


def test_a_table_read_before_stays_readable_for_one_more_snapshot(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "rollup")
    calls(spark, 0, 30).coalesce(1).write.mode("append").parquet(log)
    before = live.run_call_costs(stream(spark, log), out, compact_every=2)
    for n in (1, 2, 3):
        calls(spark, 30 * n, 30 * n + 30).coalesce(1).write.mode("append").parquet(log)
    live.run_call_costs(stream(spark, log), out, compact_every=2)
    assert before.agg(F.sum("calls")).first()[0] == 30


@pytest.mark.parametrize("fails", ["snapshot", "manifest", "commit"])
def test_a_compaction_that_fails_loses_nothing_and_counts_nothing_twice(spark, monkeypatch, fails):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "calls")
    for n in range(7):
        calls(spark, 30 * n, 30 * n + 30).coalesce(1).write.mode("append").parquet(log)
    whole = live._write_manifest

    def broken(session, path, manifest):
        if manifest.upto == 5 and fails == "snapshot":
            # The folder of the new snapshot is cut short.
            session.range(3).write.mode("overwrite").parquet(f"{path}/snapshots/slot={manifest.slot}")
        if manifest.upto == 5 and fails == "commit":
            whole(session, path, manifest)
        if manifest.upto == 5:
            raise RuntimeError("the executor with the snapshot is gone")
        whole(session, path, manifest)

    monkeypatch.setattr(live, "_write_manifest", broken)
    with pytest.raises(StreamingQueryException):
        live.run_call_costs(stream(spark, log), out, compact_every=3)
    monkeypatch.undo()
    rows = live.run_call_costs(stream(spark, log), out, compact_every=3)
    batch = C.cost_rollup(C.price_calls(read_call_log(spark, log)))
    columns = sorted(batch.columns)
    assert sorted(rows.select(columns).collect()) == sorted(batch.select(columns).collect())


def test_a_stream_whose_rows_are_gone_does_not_go_on(spark):
    log, out, other = (scratch_path(spark, name) for name in ("log", "calls", "calls"))
    for n in range(2):
        calls(spark, 30 * n, 30 * n + 30).coalesce(1).write.mode("append").parquet(log)
        if n == 0:
            live.run_call_costs(stream(spark, log), out)
            shutil.copytree(f"{out}/state", f"{other}/state")
    with pytest.raises(StreamingQueryException, match="no manifest"):
        live.run_call_costs(stream(spark, log), other)
    rows = live.run_call_costs(stream(spark, log), out)
    assert rows.agg(F.sum("calls")).first()[0] == 60


def test_another_number_of_batches_between_snapshots(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "calls")
    for n, every in enumerate((2, 5, 1, 3)):
        for file in range(5):
            first = 50 * n + 10 * file
            calls(spark, first, first + 10).coalesce(1).write.mode("append").parquet(log)
        rows = live.run_call_costs(stream(spark, log), out, compact_every=every)
        assert rows.agg(F.sum("calls")).first()[0] == 50 * (n + 1)


def test_live_tally_equals_the_batch_tally(spark):
    path, out = scratch_path(spark, "winners"), scratch_path(spark, "tally")
    schema = "prompt_id INT, winner STRING"
    rows = [(n, ["a", "b", None, ""][n * 7 % 4]) for n in range(60)]
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(path)
    arriving = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    got = live.run_updates(live.live_win_tally(arriving), out, ["winner"]).collect()
    expected = W.win_tally(spark.read.parquet(path)).collect()
    assert sorted((r.winner, r.wins, r.first_win) for r in got) == sorted(tuple(r) for r in expected)


def test_an_idle_stream_gives_empty_tables(spark):
    log = scratch_path(spark, "log")
    calls(spark, 0, 0).write.parquet(log)
    rollup = live.run_updates(
        live.live_cost_rollup(stream(spark, log)), scratch_path(spark, "rollup"), ["session_id", "book", "model"])
    assert rollup.count() == 0
    windows = live.run_window_costs(stream(spark, log), scratch_path(spark, "windows"), "1 hour")
    assert windows.count() == 0


def test_replayed_files_count_once(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "calls")
    # Each part is delivered, then some of them again, in another order and cut otherwise.
    for first, last in ((0, 60), (30, 120), (0, 60)):
        calls(spark, first, last).coalesce(1).write.mode("append").parquet(log)
        live_rows = live.run_call_costs(
            read_call_stream(spark, log, horizon="1 day", files_per_batch=1), out, compact_every=3
        )
        batch = C.cost_rollup(C.price_calls(read_call_log(spark, log).dropDuplicates(["session_id", "call_seq"])))
        columns = sorted(batch.columns)
        assert sorted(live_rows.select(columns).collect()) == sorted(batch.select(columns).collect())
    everything = live.run_call_costs(
        read_call_stream(spark, log, horizon=None), scratch_path(spark, "calls")
    )
    assert everything.agg(F.sum("calls")).first()[0] == read_call_log(spark, log).count()


def test_resets_in_any_order(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "tracker")
    rng = random.Random(7)
    order = list(range(240))
    rng.shuffle(order)
    reset = (F.col("call_seq") % 17 == 5) | (F.col("call_seq") < 3)
    for n, first in enumerate(range(0, 240, 80)):
        # The last file repeats calls that were there before.
        mine = order[first:first + 80] + (order[:20] if n == 2 else [])
        calls(spark, 0, 240).filter(F.col("call_seq").isin(mine)).coalesce(1).write.mode("append").parquet(log)
        live_rows = run_reset_sessions(
            stream(spark, log), out, reset, block_calls=32, horizon="1 day", compact_every=2
        )
        so_far = C.price_calls(read_call_log(spark, log).dropDuplicates(["session_id", "call_seq"]))
        numbered = C.number_sessions(so_far, reset, ["session_id"])
        batch = C.cost_total(numbered, ["session_id", "session_no"])
        columns = sorted(batch.columns)
        assert sorted(live_rows.select(columns).collect()) == sorted(batch.select(columns).collect())


def test_a_tracker_of_many_short_sessions_runs_no_python_per_session(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "tracker")
    # Every block of every session holds one call.
    many = spark.range(30_000).select(
        (F.col("id") % 6_000).alias("session_id"), F.col("id").alias("call_seq"),
        F.lit(START).alias("ts"), F.lit("gpt-4").alias("model"), F.lit("judge").alias("call_type"),
        F.col("id").alias("input_tokens"), F.col("id").alias("output_tokens"),
    )
    many.coalesce(1).write.parquet(log)
    reset = F.col("call_seq") % 7 == 0
    rows = run_reset_sessions(stream(spark, log), out, reset, block_calls=256)
    numbered = C.number_sessions(C.price_calls(read_call_log(spark, log)), reset, ["session_id"])
    batch = C.cost_total(numbered, ["session_id", "session_no"])
    columns = sorted(batch.columns)
    assert sorted(rows.select(columns).collect()) == sorted(batch.select(columns).collect())
    # Spark keeps no state: a group of Python for each block took 3 ms.
    assert not list(Path(out, "state").glob("state/*"))


def test_blocks_past_the_horizon_are_folded_and_stay_right(spark):
    log, out = scratch_path(spark, "log"), scratch_path(spark, "tracker")
    reset = F.col("call_seq") % 17 == 5

    def drained():
        return run_reset_sessions(
            stream(spark, log), out, reset, block_calls=32, horizon="5 hours", compact_every=1
        ).collect()

    for first in (0, 90, 600):
        calls(spark, first, first + 90).coalesce(1).write.mode("append").parquet(log)
    numbered = C.number_sessions(C.price_calls(read_call_log(spark, log)), reset, ["session_id"])
    batch = C.cost_total(numbered, ["session_id", "session_no"])
    before = sorted(drained())
    assert before == sorted(batch.select("session_id", "session_no", "calls", "total").collect())
    # Calls for a folded block come too late.
    calls(spark, 40, 60).coalesce(1).write.mode("append").parquet(log)
    assert sorted(drained()) == before
    held = spark.read.parquet(f"{out}/snapshots")
    assert held.filter("is_folded AND calls > 1").count() > 0
