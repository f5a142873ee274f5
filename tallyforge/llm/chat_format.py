"""Conversations as one training text each, with a loss mask, and back again.

Spark expressions only.  The rows of a conversation are collected as structs, sorted by
turn (null first; ties by role, then text), and neighbours of one role are merged into one
message: a turn that has the role of the turn before it is joined by `NEXT` in place of a
new head.  So the text reads::

    <|turn|>user<|text|>first<|next|>second<|end|><|turn|>assistant<|text|>reply<|end|>

Control strings inside roles and texts are escaped by one more backslash after their first
character (``<|end|>`` becomes ``<\\|end|>``, and that ``<\\\\|end|>``), which the reader takes
out again; every other text stays as it is.  No control string holds a backslash, nor the
first character of any control string a second time.  Hence an escaped text holds none, and
none can arise where a text and a mark meet.

The loss mask lists, in order, the spans of the formatted text (0-based start and length, in
code points) that hold the text of a turn whose role is learned.

Every row is a turn, repeated rows too.  A null text or role counts as empty; rows without
conversation id make up one conversation.  Columns other than the four that are named are
dropped.  A conversation becomes one value, so it has to fit one; it is the only group that
is gathered.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.let import let
from tallyforge.operators.binding import bind

TURN, TEXT, NEXT, END = "<|turn|>", "<|text|>", "<|next|>", "<|end|>"
#: Marks of other templates, which readers of the output may also act on.
FOREIGN = ("<s>", "</s>", "[INST]", "[/INST]")
CONTROL = (TURN, TEXT, NEXT, END, *FOREIGN)

_REST = "|".join(re.escape(c[1:]) for c in CONTROL)
_FIRST = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
#: A control string with any number of backslashes after its first character.
PLAIN = rf"([{_FIRST}])(\\*)({_REST})"
ESCAPED = rf"([{_FIRST}])\\(\\*)({_REST})"

#: Lengths are added up in runs of this many turns.
_RUN = 32


def escape(text: Column) -> Column:
    return F.regexp_replace(text, PLAIN, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPED, "$1$2$3")


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def _sum(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("bigint"), lambda a, x: a + x)


def _starts(lengths: Column) -> Column:
    """Sum of the lengths before each element, in time linear but for the run totals."""
    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / _RUN).cast("int")),
        lambda r: _sum(F.slice(lengths, r * _RUN + 1, F.lit(_RUN))),
    )
    none = F.array(F.lit(0).cast("bigint"))
    before = F.aggregate(
        runs, none, lambda done, n: F.array_append(done, F.element_at(done, -1) + n)
    )
    return let(before, lambda run_start: F.transform(lengths, lambda _, i: (
        F.get(run_start, F.floor(i / _RUN).cast("int"))
        + _sum(F.slice(lengths, F.floor(i / _RUN).cast("int") * _RUN + 1, i % _RUN))
    )))


def format_chats(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
    text: str = "text", learned: Sequence[str] = ("assistant",),
) -> DataFrame:
    """One row per conversation: `conv`, `formatted`, `loss_mask` and `n_messages`."""
    row = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    chats = turns.groupBy(conv).agg(F.array_sort(F.collect_list(row)).alias("turns"))

    def rendered(t: Column, i: Column) -> Column:
        opens = ~F.get("turns", i - 1)["role"].eqNullSafe(t["role"])
        closes = ~F.get("turns", i + 1)["role"].eqNullSafe(t["role"])
        head = F.concat(F.lit(TURN), escape(t["role"]), F.lit(TEXT))
        return F.struct(
            F.when(opens, head).otherwise(F.lit(NEXT)).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(closes, F.lit(END)).otherwise(F.lit("")).alias("tail"),
            t["role"].isin(*learned).alias("learned"),
        )

    def span(piece: Column, i: Column) -> Column:
        start = F.get("starts", i) + F.length(piece["head"])
        return F.struct(
            start.alias("start"), F.length(piece["body"]).cast("bigint").alias("length"),
            piece["learned"].alias("learned"),
        )

    def whole(piece: Column) -> Column:
        return F.concat(piece["head"], piece["body"], piece["tail"])

    pieces = bind(chats, pieces=F.transform("turns", rendered))
    placed = bind(pieces, starts=let(
        F.transform("pieces", lambda p: F.length(whole(p)).cast("bigint")), _starts
    ))
    spans = F.filter(F.transform("pieces", span), lambda s: s["learned"])
    return placed.select(
        conv,
        _joined(F.transform("pieces", whole)).alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"], s["length"])).alias("loss_mask"),
        F.size(F.filter("pieces", lambda p: p["tail"] != "")).alias("n_messages"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text in order: ``array<struct<role, text>>``."""

    def turns_of(message: Column) -> Column:
        parts = F.split(F.substring(message, len(TURN) + 1, F.length(message)), re.escape(TEXT), 2)
        return let(parts, lambda p: F.transform(
            F.split(p[1], re.escape(NEXT), -1),
            lambda t: F.struct(unescape(p[0]).alias("role"), unescape(t).alias("text")),
        ))

    messages = F.split(formatted, re.escape(END), -1)
    closed = let(messages, lambda m: F.slice(m, F.lit(1), F.size(m) - 1))
    return F.flatten(F.transform(closed, turns_of))


def read_learned(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between its spans."""
    return _joined(F.transform(loss_mask, lambda s: unescape(F.substring(
        formatted, (s["start"] + 1).cast("int"), s["length"].cast("int")
    ))))
