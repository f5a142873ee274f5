import random
import re
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators import cost as C
from tallyforge.operators.dimension import is_small, left_join_dimension
from tallyforge.operators.running import enumerate_rows, running_sums
from tallyforge.plans.evaluation import priced_documents
from tallyforge.settings import PriceBook

MODELS = ["gpt-4", "gpt-4-turbo", "gpt-3.5-turbo", "gpt-3.5-turbo-16k", "strange"]
PRICES = PriceBook()


def py_cost(model, tokens_in, tokens_out):
    price_in, price_out = PRICES.per_1k.get(model, PRICES.per_1k["gpt-3.5-turbo"])
    return (tokens_in * Decimal(price_in) + tokens_out * Decimal(price_out)) / 1000


def log(spark, n=900, seed=4):
    """A third of the calls sit in one session; numbers have gaps."""
    rng = random.Random(seed)
    rows, seq = [], 0
    for _ in range(n):
        seq += rng.choice([1, 1, 1, 7, 5000])
        session = 0 if rng.random() < 0.35 else rng.randint(1, 20)
        kind = rng.choice(["model", "judge", "other", None])
        rows.append((session, seq, None, rng.choice(MODELS), kind, rng.randint(0, 5000), rng.randint(0, 900)))
    return rows, spark.createDataFrame(rows, schemas.CALL_LOG).repartition(5)


def test_known_costs(spark):
    rows = [(1, 1, None, "gpt-4", "judge", 150, 200), (1, 2, None, "strange", "model", 1000, 1000)]
    got = C.price_calls(spark.createDataFrame(rows, schemas.CALL_LOG)).orderBy("call_seq").collect()
    assert [(r.model, r.book, r.cost) for r in got] == [
        ("gpt-4", "judge_calls", Decimal("0.0165")), ("strange", "model_calls", Decimal("0.0035")),
    ]


def test_rollup_totals_and_breakdown(spark):
    rows, calls = log(spark)
    priced = C.price_calls(calls)
    books = defaultdict(lambda: [0, Decimal(0), 10**9])
    totals = defaultdict(Decimal)
    for s, seq, _, model, kind, i, o in rows:
        entry = books[s, "judge_calls" if kind == "judge" else "model_calls", model]
        entry[0] += 1
        entry[1] += py_cost(model, i, o)
        entry[2] = min(entry[2], seq)
        totals[s] += py_cost(model, i, o)
    rollup = C.cost_rollup(priced)
    assert {(r.session_id, r.book, r.model): [r.calls, r.cost, r.first_seq] for r in rollup.collect()} == books
    assert {r.session_id: r.total for r in C.cost_total(priced).collect()} == totals
    docs = C.cost_breakdown(rollup).withColumn("names", F.map_keys("cost_breakdown.model_calls"))
    for doc in docs.collect():
        seen = [m for (s, b, m), e in sorted(books.items(), key=lambda kv: kv[1][2])
                if s == doc.session_id and b == "model_calls"]
        assert doc.names == seen
        assert doc.cost_breakdown.total == totals[doc.session_id]


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_running_sums_of_a_hot_session(spark, ranges):
    rows, calls = log(spark)
    priced = C.price_calls(calls)
    got = running_sums(priced, ["session_id"], "call_seq", {
        "running": (F.col("cost"), schemas.TOTAL_COST), "n": (F.lit(1), "BIGINT"),
    }, ranges).collect()
    assert len(got) == len(rows)
    total, count, expected = defaultdict(Decimal), defaultdict(int), {}
    for s, seq, _, model, _, i, o in rows:
        total[s] += py_cost(model, i, o)
        count[s] += 1
        expected[s, seq] = (total[s], count[s])
    assert {(r.session_id, r.call_seq): (r.running, r.n) for r in got} == expected


def test_running_sums_keep_null_keys(spark):
    rows, calls = log(spark)
    got = running_sums(
        calls, ["session_id", "call_type"], "call_seq", {"n": (F.lit(1), "BIGINT")}, 9
    )
    assert got.count() == len(rows)
    assert got.filter("call_type IS NULL").count() == sum(r[4] is None for r in rows)


def test_running_sums_of_one_ordered_log_and_of_nothing(spark):
    _, calls = log(spark)
    got = running_sums(calls, [], "call_seq", {"n": (F.lit(1), "BIGINT")}, 11).orderBy("call_seq").collect()
    assert [r.n for r in got] == list(range(1, len(got) + 1))
    assert running_sums(calls.limit(0), ["session_id"], "call_seq", {"n": (F.lit(1), "BIGINT")}).count() == 0


def test_each_call_is_billed_once(spark):
    rows = [(1, 1, None, "a", "model", 1000, 0), (1, 2, None, "a", "model", None, 1000), (1, 3, None, None, "model", 1000, 0)]
    prices = spark.createDataFrame(
        [("a", Decimal("0.01"), Decimal("0.02")), ("a", Decimal("0.03"), Decimal("0.01")), (None, Decimal(9), Decimal(9))],
        schemas.PRICES)
    got = C.price_calls(spark.createDataFrame(rows, schemas.CALL_LOG), prices).orderBy("call_seq").collect()
    assert [r.cost for r in got] == [Decimal("0.03"), Decimal("0.01"), Decimal("0.0015")]


def test_a_wide_dimension_is_not_small(spark):
    wide = spark.range(50).select(F.col("id").cast("string").alias("model"), F.repeat(F.lit("x"), F.lit(1000)).alias("t"))
    assert is_small(wide) and not is_small(wide, byte_limit=10_000) and not is_small(wide, row_limit=49)
    assert is_small(wide.limit(0))


def test_breakdown_so_far_repeats_models_of_earlier_prompts(spark):
    rows = [(1, 1, None, "a", "model", 1000, 0), (1, 2, None, "b", "judge", 1000, 0), (1, 101, None, "a", "model", 1000, 0),
            (1, 201, None, "c", "model", 1000, 0), (2, 3, None, "a", "model", 1000, 0)]
    calls = spark.createDataFrame(rows, schemas.CALL_LOG).withColumn("prompt_id", F.floor(F.col("call_seq") / 100))
    docs = calls.select("session_id", "prompt_id").distinct()
    got = {(r.session_id, r.prompt_id): r.cost_breakdown for r in priced_documents(docs, calls, session=["session_id"]).collect()}
    shown = {k: ({m: v.calls for m, v in d.model_calls.items()}, {m: v.calls for m, v in d.judge_calls.items()}, d.total)
             for k, d in got.items()}
    each = Decimal("0.0015")
    assert shown == {(1, 0): ({"a": 1}, {"b": 1}, 2 * each), (1, 1): ({"a": 2}, {"b": 1}, 3 * each),
                     (1, 2): ({"a": 2, "c": 1}, {"b": 1}, 4 * each), (2, 0): ({"a": 1}, {}, each)}


def test_breakdown_so_far_of_a_hot_session_in_many_ranges(spark):
    rows, calls = log(spark)
    calls = calls.withColumn("prompt_id", F.floor(F.col("call_seq") / 40))
    priced = C.price_calls(calls)
    rows = [(r.session_id, r.prompt_id, r.book, r.model, r.call_seq, r.cost) for r in priced.collect()]
    prompts, first = defaultdict(set), {}
    for session, prompt, book, model, seq, _ in rows:
        prompts[session].add(prompt)
        first[session, book, model] = min(seq, first.get((session, book, model), seq))
    expected = {}
    for session, prompt, book, model, seq, cost in rows:
        for later in prompts[session]:
            if later >= prompt:
                calls_so_far, so_far = expected.get((session, later, book, model), (0, Decimal(0)))
                expected[session, later, book, model] = (calls_so_far + 1, so_far + cost)
    for ranges in (1, 7, 40):
        rollup = C.running_rollup(priced, "prompt_id", ranges=ranges)
        got = rollup.collect()
        assert {(r.session_id, r.prompt_id, r.book, r.model): (r.calls, r.cost) for r in got} == expected
        assert len(got) == len(expected)
        assert all(r.first_seq == first[r.session_id, r.book, r.model] for r in got)
    assert rollup.schema["cost"].dataType.simpleString() == schemas.TOTAL_COST.lower()


def test_breakdown_so_far_never_shuffles_rows_by_session_alone(spark):
    _, calls = log(spark)
    priced = C.price_calls(calls.withColumn("prompt_id", F.floor(F.col("call_seq") / 40)))
    plan = C.running_rollup(priced, "prompt_id", ranges=7)._jdf.queryExecution().toString()
    alone = [line for line in plan.splitlines() if re.search(r"hashpartitioning\(session_id#\d+L?, \d+\)", line)]
    # The only such exchange counts the ranges of the sessions at their edges, two rows a range.
    assert len(alone) == 1


def test_breakdown_so_far_of_awkward_rows(spark):
    rows = [(None, 1, None, "a", "model", 1000, 0), (None, 41, None, "a", "model", 1000, 0),
            (1, 2, None, None, "model", 1000, 0), (1, 42, None, "a", "model", 1000, 0), (1, None, None, "a", "model", 1000, 0)]
    calls = spark.createDataFrame(rows, schemas.CALL_LOG).withColumn("prompt_id", F.floor(F.col("call_seq") / 40))
    got = C.running_rollup(C.price_calls(calls), "prompt_id", ranges=3).collect()
    assert {(r.session_id, r.prompt_id, r.model): r.calls for r in got} == {
        (None, 0, "a"): 1, (None, 1, "a"): 2, (1, 0, None): 1, (1, 1, None): 1, (1, 1, "a"): 1}
    assert C.running_rollup(C.price_calls(calls).limit(0), "prompt_id").count() == 0


def test_sessions_between_resets(spark):
    rows, calls = log(spark)
    calls = calls.withColumn("is_reset", F.col("input_tokens") % 5 == 0)
    got = C.number_sessions(calls, F.col("is_reset")).collect()
    n, expected = 0, {}
    for r in rows:
        n += r[5] % 5 == 0
        expected[r[1]] = n
    assert {r.call_seq: r.session_no for r in got} == expected


def test_enumerate_rows(spark):
    rows = spark.range(0, 3000, 3).repartition(6).withColumnRenamed("id", "k")
    got = enumerate_rows(rows, "k").collect()
    assert all(r.prompt_idx == r.k // 3 for r in got) and len(got) == 1000


def test_snapshots_show_the_running_total_and_its_sum_counts_twice(spark):
    rows = [(1, n, None, "gpt-3.5-turbo", "model", 1000, 0) for n in range(4)]
    running = C.running_cost(C.price_calls(spark.createDataFrame(rows, schemas.CALL_LOG)))
    snaps = C.cost_snapshots(running.withColumn("prompt", F.floor(F.col("call_seq") / 2)), ["prompt"])
    got = {r.prompt: (r.cost_own, r.cost_running) for r in snaps.collect()}
    assert got == {0: (Decimal("0.003"), Decimal("0.003")), 1: (Decimal("0.003"), Decimal("0.006"))}
    total = C.cost_over_documents(snaps).first()
    assert (total.total_own, total.total_of_running) == (Decimal("0.006"), Decimal("0.009"))


def test_summary_lines(spark):
    rows = [(1, 1, None, "gpt-4", "model", 150, 200), (1, 2, None, "gpt-4", "judge", 150, 200)]
    rollup = C.cost_rollup(C.price_calls(spark.createDataFrame(rows, schemas.CALL_LOG)))
    lines = C.cost_summary_lines(C.cost_breakdown(rollup)).orderBy("line_no").collect()
    assert [r.line for r in lines] == [
        "COST SUMMARY", "MODEL CALLS:", "   gpt-4: 1 calls, $0.0165",
        "JUDGE CALLS:", "   gpt-4: 1 calls, $0.0165", "TOTAL COST: $0.0330",
    ]


def test_large_price_table_joins_without_broadcast(spark):
    _, calls = log(spark)
    prices = spark.createDataFrame(PRICES.rows(), schemas.PRICES)
    spread = ["session_id", "call_seq"]
    small = left_join_dimension(calls, prices, "model", spread)
    large = left_join_dimension(calls, prices, "model", spread, row_limit=2, salts=4)
    assert "hint" not in large._jdf.queryExecution().logical().toString().lower()
    assert sorted(small.collect(), key=str) == sorted(large.select(small.columns).collect(), key=str)
