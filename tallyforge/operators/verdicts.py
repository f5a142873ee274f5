"""Judge answers to statuses, winners, marks and mark statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions import verdict as V
from tallyforge.functions.json import (
    allow_duplicate_keys,
    finite_numbers,
    json_span,
    strict_json,
)
from tallyforge.functions.let import let
from tallyforge.functions.scoring import ERROR, EVALUATED
from tallyforge.operators.binding import bind
from tallyforge.settings import RESERVED_VERDICT_KEYS


def _opened(answers: DataFrame, text: str) -> DataFrame:
    """Add `json_text` and `parsed`; each answer is searched and parsed once.

    Spark takes a VARIANT for 2 KB: a table that drops it counts as a fiftieth of its
    size, and a later join would broadcast millions of verdicts.  Hence the hint, which
    holds for any join of these rows.
    """
    allow_duplicate_keys(answers.sparkSession)
    spans = bind(answers, json_text=let(json_span(F.col(text)), finite_numbers))
    return bind(spans, parsed=strict_json(F.col("json_text"))).hint("merge")


def _reserved_fields() -> list[Column]:
    return [V.field(F.col("parsed"), k).alias(k) for k in RESERVED_VERDICT_KEYS]


def parse_text_verdicts(answers: DataFrame, text: str = "judge_text") -> DataFrame:
    """Add `parsed`, `status`, `winner`, the two reasonings, `error`, `details`.

    A failed verdict keeps its row (its call was paid for) with `parsed` NULL.
    """
    opened = _opened(answers, text)
    judged = bind(opened, details=V.text_failure(F.col("json_text"), F.col("parsed")))
    failed = F.col("details").isNotNull()
    kept = judged.withColumn("parsed", F.when(~failed, F.col("parsed")))
    return kept.select(
        "*",
        F.when(failed, F.lit(ERROR)).otherwise(F.lit(EVALUATED)).alias("status"),
        F.when(failed, F.lit(V.FAILED_TEXT)).alias("error"),
        *_reserved_fields(),
    )


def parse_code_verdicts(answers: DataFrame, text: str = "judge_text") -> DataFrame:
    """Add `parsed` and its reserved fields; broken JSON counts as an empty object.

    Extra keys that hold no object are tolerated here.
    """
    empty = F.parse_json(F.lit("{}"))
    opened = _opened(answers, text).withColumn("parsed", F.coalesce("parsed", empty))
    return opened.select("*", *_reserved_fields())


def verdict_marks(verdicts: DataFrame, key: str = "prompt_id") -> DataFrame:
    """One row per model a verdict marks."""
    entries = verdicts.select(
        key, F.explode(V.model_entries(F.col("parsed"))).alias("model", "entry")
    )
    entry = F.col("entry")
    return entries.select(
        key, "model",
        V.mark(entry, "correctness").alias("correctness"),
        V.mark(entry, "relevance").alias("relevance"),
        F.coalesce(V.field(entry, "reasoning"), F.lit("")).alias("reasoning"),
    )


def mark_stats(marks: DataFrame) -> DataFrame:
    """Mean marks per model."""
    return marks.groupBy("model").agg(
        F.count("*").alias("verdicts"),
        F.avg("correctness").alias("mean_correctness"),
        F.avg("relevance").alias("mean_relevance"),
    )
