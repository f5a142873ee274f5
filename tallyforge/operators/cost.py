"""Pricing of calls, cost roll-ups, running totals and cost documents."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions.text import money
from tallyforge.operators.dimension import left_join_dimension
from tallyforge.operators.keyed import last_per_key
from tallyforge.operators.running import running_sums
from tallyforge.settings import PriceBook
from tallyforge.sources.scratch import materialize

_RANGE = "__range"
_SUMS = {"calls": "bigint", "cost": schemas.TOTAL_COST}

# The two books of calls.
MODEL_CALLS, JUDGE_CALLS = "model_calls", "judge_calls"


def call_cost(
    input_tokens: Column, output_tokens: Column, input_per_1k: Column, output_per_1k: Column
) -> Column:
    """Exact decimal cost of a call."""
    per_1k = (
        input_tokens.cast("decimal(12,0)") * input_per_1k
        + output_tokens.cast("decimal(12,0)") * output_per_1k
    )
    return (per_1k * F.lit("0.001").cast("decimal(3,3)")).cast(schemas.COST)


def book(call_type: Column) -> Column:
    """Any type other than ``judge`` is booked as a model call."""
    return F.when(call_type == "judge", F.lit(JUDGE_CALLS)).otherwise(F.lit(MODEL_CALLS))


def price_calls(
    calls: DataFrame, prices: PriceBook | DataFrame = PriceBook(), fallback: PriceBook = PriceBook()
) -> DataFrame:
    """Add `cost` and `book`.

    A model without a price pays the fallback price but keeps its own name.  A model
    with several prices pays the highest (input, then output): each call is billed
    once.  Tokens that were not recorded (NULL) cost nothing; the call still counts.
    A `PriceBook` lives on the driver, so its size is known; a table of prices is
    counted before it is broadcast.
    """
    if isinstance(prices, PriceBook):
        fallback, rows = prices, prices.rows()
        table, row_count = calls.sparkSession.createDataFrame(rows, schemas.PRICES), len(rows)
    else:
        one_each = last_per_key(
            prices.filter("model IS NOT NULL"), ["model"], ["input_per_1k", "output_per_1k"]
        )
        table, row_count = one_each.select("model", "input_per_1k", "output_per_1k"), None
    priced = left_join_dimension(
        calls, table, "model", ["session_id", "call_seq"], row_count=row_count
    )
    in_fallback, out_fallback = (
        F.lit(p).cast("decimal(10,6)") for p in fallback.fallback
    )
    cost = call_cost(
        F.coalesce("input_tokens", F.lit(0)), F.coalesce("output_tokens", F.lit(0)),
        F.coalesce("input_per_1k", in_fallback), F.coalesce("output_per_1k", out_fallback),
    )
    return priced.select(
        *calls.columns, book(F.col("call_type")).alias("book"), cost.alias("cost")
    )


def _cost_sum(column: str = "cost") -> Column:
    return F.sum(column).cast(schemas.TOTAL_COST)


def cost_rollup(
    priced: DataFrame, session: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Calls and cost per (session, book, model), with the first call's position."""
    return priced.groupBy(*session, "book", "model").agg(
        F.count("*").alias("calls"),
        _cost_sum().alias("cost"),
        F.min("call_seq").alias("first_seq"),
    )


def cost_total(priced: DataFrame, session: Sequence[str] = ("session_id",)) -> DataFrame:
    return priced.groupBy(*session).agg(
        F.count("*").alias("calls"), _cost_sum().alias("total")
    )


def cost_rollup_and_total(
    priced: DataFrame, session: Sequence[str] = ("session_id",)
) -> DataFrame:
    """`cost_rollup` and `cost_total` from one scan and one shuffle.

    Rows of the total have neither book nor model and `is_total` true.  Grouping sets send
    each partial aggregate to both of its groups, so the log is read and shuffled once;
    rows of a missing model stay apart from the total.
    """
    keys = [F.col(k) for k in session]
    grouped = priced.groupingSets(
        [[*keys, F.col("book"), F.col("model")], keys], *keys, F.col("book"), F.col("model")
    )
    return grouped.agg(
        (F.grouping("book") == 1).alias("is_total"), F.count("*").alias("calls"),
        _cost_sum().alias("cost"), F.min("call_seq").alias("first_seq"),
    )


def running_cost(
    priced: DataFrame, session: Sequence[str] = ("session_id",), ranges: int | None = None
) -> DataFrame:
    """Total of the session up to and including each call."""
    return running_sums(
        priced, session, "call_seq",
        {"running_cost": (F.col("cost"), schemas.TOTAL_COST)}, ranges,
    )


def running_cost_by_model(
    priced: DataFrame, session: Sequence[str] = ("session_id",)
) -> DataFrame:
    """Calls and cost so far per (session, book, model)."""
    return running_sums(
        priced, [*session, "book", "model"], "call_seq",
        {
            "running_calls": (F.lit(1), "BIGINT"),
            "running_cost": (F.col("cost"), schemas.TOTAL_COST),
        },
    )


def number_sessions(
    log: DataFrame, is_reset: Column, tracker: Sequence[str] = (), seq: str = "call_seq"
) -> DataFrame:
    """Add `session_no`: resets of the tracker up to and including the row."""
    return running_sums(
        log, tracker, seq, {"session_no": (is_reset.cast("int"), "BIGINT")}
    )


def cost_snapshots(running: DataFrame, prompt: Sequence[str]) -> DataFrame:
    """Per prompt: its own cost and the running total its document shows."""
    return running.groupBy(*prompt).agg(
        _cost_sum().alias("cost_own"),
        F.max_by("running_cost", "call_seq").alias("cost_running"),
    )


def running_rollup(
    priced: DataFrame, prompt: str, session: Sequence[str] = ("session_id",),
    ranges: int | None = None,
) -> DataFrame:
    """Calls and cost so far per (book, model), for every prompt of a session.

    Like `cost_rollup`, with one row per prompt, book and model seen up to that prompt;
    `prompt` is an integer column in the order of the session.  A prompt without a call
    to a model repeats what the model had before, so the result is as long as the
    documents that show it.

    Prompts are cut into ranges of (session, prompt), as many as there are shuffle
    partitions, and meet the session's kinds range by range: a hot session spreads over
    its ranges.  Only a session that goes on in another range has something to carry,
    and of those there are fewer than ranges.  Rows without a prompt number are left out.
    """
    spark = priced.sparkSession
    kind = [*session, "book", "model"]
    count = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = priced.filter(F.col(prompt).isNotNull()).groupBy(*session, prompt, "book", "model").agg(
        F.count("*").alias("own_calls"), _cost_sum().alias("own_cost"),
        F.min("call_seq").alias("own_seq"),
    )
    ranged = materialize(
        own.repartitionByRange(count, *session, prompt).withColumn(_RANGE, F.spark_partition_id()),
        "running-rollup",
    )
    sums = ranged.groupBy(_RANGE, *kind).agg(
        F.sum("own_calls").alias("calls"), _cost_sum("own_cost").alias("cost"),
        F.min(prompt).alias("first_prompt"), F.min("own_seq").alias("first_seq"),
    )
    carried = _carried_kinds(sums, session)
    # What a range has to show of a kind: its sums before the range and its first prompt.
    before = [F.coalesce(f"carried.{c}", F.lit(0)).cast(t).alias(f"{c}_before") for c, t in _SUMS.items()]
    seen = sums.alias("own").join(
        carried.alias("carried"), _same("own", "carried", [_RANGE, *kind]), "full"
    ).select(
        *[F.coalesce(f"own.{k}", f"carried.{k}").alias(k) for k in [_RANGE, *kind]], *before,
        F.coalesce("carried.first_prompt", "own.first_prompt").alias("first_prompt"),
        F.coalesce("carried.first_seq", "own.first_seq").alias("first_seq"),
    )
    shown = ranged.select(_RANGE, *session, prompt).distinct().alias("shown").join(
        seen.alias("seen"), _same("shown", "seen", [_RANGE, *session])
    ).filter(F.col(prompt) >= F.col("first_prompt")).select(
        "shown.*", *[f"seen.{c}" for c in ("book", "model", "calls_before", "cost_before", "first_seq")]
    )
    dense = shown.alias("shown").join(
        ranged.alias("own"), _same("shown", "own", [_RANGE, *session, prompt, "book", "model"]), "left"
    ).select("shown.*", "own_calls", "own_cost")
    so_far = (
        Window.partitionBy(_RANGE, *kind).orderBy(prompt)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def through(name: str, kept: str) -> Column:
        inside = F.coalesce(F.sum(f"own_{name}").over(so_far), F.lit(0)).cast(kept)
        return (F.col(f"{name}_before") + inside).cast(kept).alias(name)

    return dense.select(
        *session, prompt, "book", "model", *[through(c, t) for c, t in _SUMS.items()], "first_seq"
    )


def _carried_kinds(sums: DataFrame, session: Sequence[str]) -> DataFrame:
    """For sessions in several ranges: every kind in every range from its first one on,
    with its sums in the ranges before; also the session's first prompt and call of it."""
    kind = [*session, "book", "model"]
    # A session in several ranges is the first or the last of each: two rows per range.
    edges = sums.groupBy(_RANGE).agg(
        F.min(F.struct(*session)).alias("first"), F.max(F.struct(*session)).alias("end")
    ).select(_RANGE, F.explode(F.array("first", "end")).alias("__session")).select(
        _RANGE, *[F.col(f"__session.{k}").alias(k) for k in session]
    ).distinct()
    several = edges.withColumn(
        "__ranges", F.count("*").over(Window.partitionBy(*session))
    ).filter("__ranges > 1").drop("__ranges")
    kinds = sums.groupBy(*kind).agg(
        F.min(_RANGE).alias("__from"), F.min("first_prompt").alias("first_prompt"),
        F.min("first_seq").alias("first_seq"),
    )
    spread = kinds.alias("kinds").join(
        F.broadcast(several.alias("several")), _same("kinds", "several", session)
    ).filter(F.col(_RANGE) >= F.col("__from")).select(_RANGE, "kinds.*")
    before = Window.partitionBy(*kind).orderBy(_RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return spread.alias("spread").join(
        sums.alias("sums"), _same("spread", "sums", [_RANGE, *kind]), "left"
    ).select("spread.*", "calls", "cost").select(
        _RANGE, *kind, "first_prompt", "first_seq",
        F.sum("calls").over(before).alias("calls"), F.sum("cost").over(before).alias("cost"),
    )


def _same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal in all keys; a missing one equals a missing one."""
    return reduce(
        lambda a, b: a & b, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys]
    )


def cost_over_documents(snapshots: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Correct sum of own costs, and the sum of running totals (counts twice)."""
    return snapshots.groupBy(*by).agg(
        _cost_sum("cost_own").alias("total_own"),
        F.sum("cost_running").cast("decimal(38,9)").alias("total_of_running"),
    )


def cost_breakdown(rollup: DataFrame, session: Sequence[str] = ("session_id",)) -> DataFrame:
    """One `cost_breakdown` document per session, models in order of first call.

    Its group is a session's (book, model) pairs, already pre-aggregated.
    """
    entry = F.struct("first_seq", "model", "calls", "cost")

    def calls_of(name: str) -> Column:
        rows = F.array_sort(F.collect_list(F.when(F.col("book") == name, entry)))
        return F.map_from_entries(
            F.transform(rows, lambda r: F.struct(
                r["model"].alias("key"),
                F.struct(r["calls"].alias("calls"), r["cost"].alias("cost")).alias("value"),
            ))
        )

    grouped = rollup.groupBy(*session).agg(
        calls_of(MODEL_CALLS).alias(MODEL_CALLS),
        calls_of(JUDGE_CALLS).alias(JUDGE_CALLS),
        _cost_sum().alias("total"),
    )
    return grouped.select(
        *session, F.struct(MODEL_CALLS, JUDGE_CALLS, "total").alias("cost_breakdown")
    )


def breakdown_rows(breakdown: DataFrame, session: Sequence[str] = ("session_id",)) -> DataFrame:
    """A breakdown document back as rows (session, book, model, calls, cost, total)."""
    doc = F.col("cost_breakdown")

    def rows_of(name: str) -> Column:
        return F.transform(F.map_entries(doc[name]), lambda e: F.struct(
            F.lit(name).alias("book"), e["key"].alias("model"),
            e["value"]["calls"].alias("calls"), e["value"]["cost"].alias("cost"),
        ))

    return breakdown.select(
        *session, doc["total"].alias("total"),
        F.inline(F.concat(rows_of(MODEL_CALLS), rows_of(JUDGE_CALLS))),
    )


def cost_summary_lines(
    breakdown: DataFrame, session: Sequence[str] = ("session_id",)
) -> DataFrame:
    """The cost summary as rows (session, line_no, line)."""
    doc = F.col("cost_breakdown")

    def lines_of(name: str) -> Column:
        return F.transform(F.map_entries(doc[name]), lambda e: F.concat(
            F.lit("   "), e["key"], F.lit(": "), e["value"]["calls"].cast("string"),
            F.lit(" calls, "), money(e["value"]["cost"]),
        ))

    lines = F.concat(
        F.array(F.lit("COST SUMMARY"), F.lit("MODEL CALLS:")), lines_of(MODEL_CALLS),
        F.array(F.lit("JUDGE CALLS:")), lines_of(JUDGE_CALLS),
        F.array(F.concat(F.lit("TOTAL COST: "), money(doc["total"]))),
    )
    return breakdown.select(*session, F.posexplode(lines).alias("line_no", "line"))
