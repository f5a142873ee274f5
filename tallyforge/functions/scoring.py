"""Code scores: outcomes, pass rate, style, final score, status."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions.let import let
from tallyforge.settings import ScoreWeights

# Statuses of a candidate.
EVALUATED, SYNTAX_ERROR, ERROR = "evaluated", "syntax_error", "error"

# Recorded outcomes of a test run.
PASS = "pass"
ASSERT_THEN_PASS = "assert_then_pass"
ASSERT_ASSERT = "assert_assert"
ASSERT_THEN_ERROR = "assert_then_error"
RUNTIME_ERROR = "runtime_error"
NO_OUTPUT = "no_output"
TIMEOUT = "timeout"


# Up to here, a value times 1,000 has room for a ten-millionth behind the point.
CLEAR_BELOW = 1e6


def round_binary(x: Column, digits: int) -> Column:
    """Round a non-negative double as Python does: half even, by its binary value.

    Spark's ``round`` works on the printed decimal, so 2.675 becomes 2.68 instead of
    2.67; ``format_number`` looks at the binary value.  It fails where the first
    digit is the one to round, so values below one unit are compared with half a unit.
    It is slow, and only values near the middle of two results need it: the product
    below is off by less than a millionth.
    """
    unit, half = float(f"1e-{digits}"), float(f"5e-{digits + 1}")
    half_rounds_up = Decimal(half) > Decimal(f"5e-{digits + 1}")

    def rounded(x: Column) -> Column:
        units = x * F.lit(10.0**digits)
        clear = (x < F.lit(CLEAR_BELOW)) & (F.abs(units - F.floor(units) - F.lit(0.5)) > F.lit(1e-4))
        nearest = F.floor(units + F.lit(0.5)).cast("double") / F.lit(10.0**digits)
        formatted = F.call_function("format_number", x, F.lit("0." + "0" * digits)).cast("double")
        up = x >= half if half_rounds_up else x > half
        above = F.when(clear, nearest).otherwise(formatted)
        return F.when(x >= unit, above).when(up, F.lit(unit)).otherwise(F.lit(0.0))

    # Behind a lambda: written out, the scores of a row make one Java method of over 8,000
    # bytes, which the JVM never compiles.
    return let(x, rounded)


def outcome_counts(outcome: Column, total_asserts: Column) -> Column:
    """``struct(passed, failed)`` of a recorded run; NULL for a timeout."""

    def counts(passed, failed):
        return F.struct(passed.cast("bigint").alias("passed"), failed.cast("bigint").alias("failed"))

    zero, ten = F.lit(0), F.lit(10)
    return (
        F.when(outcome == PASS, counts(total_asserts, zero))
        .when(outcome == ASSERT_THEN_PASS, counts(ten, zero))
        .when(outcome == ASSERT_ASSERT, counts(F.lit(9), F.lit(1)))
        .when(outcome == ASSERT_THEN_ERROR, counts(zero, ten))
        .when(outcome == RUNTIME_ERROR, counts(zero, total_asserts))
        .when(outcome == NO_OUTPUT, counts(zero, zero))
    )


def pass_rate(passed: Column, failed: Column) -> Column:
    total = passed + failed
    return F.when(total > 0, passed.cast("double") / total).otherwise(F.lit(0.0))


def style_score(rating: Column, avg_complexity: Column) -> Column:
    """rating/10 damped by complexity, from unrounded parts, to three digits."""
    damping = F.lit(1.0) / (F.lit(1.0) + avg_complexity / F.lit(10.0))
    return round_binary((rating / F.lit(10.0)) * damping, 3)


def style_report(
    rating: Column, avg_complexity: Column, score: Column | None = None
) -> Column:
    """`score` is the style score where it is at hand."""
    return F.struct(
        round_binary(rating, 2).alias("pylint_score"),
        round_binary(avg_complexity, 2).alias("average_complexity"),
        (style_score(rating, avg_complexity) if score is None else score).alias("style_score"),
    )


def final_score(
    rate: Column, issues: Column, style: Column, weights: ScoreWeights = ScoreWeights()
) -> Column:
    """Weighted score; the issue penalty hits the functional part only."""
    functional = F.greatest(
        rate - issues.cast("double") * F.lit(weights.penalty_per_issue), F.lit(0.0)
    )
    mixed = F.lit(weights.functionality) * functional + F.lit(weights.style) * style
    return round_binary(mixed, 3).cast(schemas.SCORE)


def status(syntax_ok: Column, counts: Column) -> Column:
    """A candidate whose syntax was never checked (NULL) is not evaluated: ``error``."""
    return (
        F.when(syntax_ok.isNull(), F.lit(ERROR))
        .when(~syntax_ok, F.lit(SYNTAX_ERROR))
        .when(counts.isNull(), F.lit(ERROR))
        .otherwise(F.lit(EVALUATED))
    )
