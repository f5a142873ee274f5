"""Text helpers: strip, code fences, generated tests, tool and test-run output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyforge.functions.let import let

# Every character Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Marks and line patterns of generated text and tool output.
FENCE = "```"
FENCE_LANGUAGE = "python"
DROPPED_TEST_LINES = r"(?md)^(?:import|from.*import|```).*\n?"
RUN_COUNT_LINE = r"(?md)^{label}:([^:\n]*)"
INTEGER = r"\A[+-]?[0-9]+(?:_[0-9]+)*\z"
LINT_RATING = r"rated at ([0-9\.]+)/10"


def strip(text: Column) -> Column:
    """Drop leading and trailing Unicode white space (a scan, not a regex)."""
    return F.trim(text, F.lit(WHITESPACE))


def extract_code(text: Column) -> Column:
    """First fenced block, or the whole text when no fence is closed; stripped."""
    pieces = F.split(text, FENCE, 3)
    body = pieces[1]
    without_tag = F.when(
        F.startswith(body, F.lit(FENCE_LANGUAGE)),
        F.substring(body, F.lit(len(FENCE_LANGUAGE) + 1), F.length(body)),
    ).otherwise(body)
    return strip(F.when(F.size(pieces) == 3, without_tag).otherwise(text))


def clean_tests(text: Column) -> Column:
    """Generated tests without import lines and fence lines.

    Whole lines that begin with ``import``, hold ``from...import`` or begin with a
    fence go; indented imports stay.
    """
    return F.regexp_replace(extract_code(text), DROPPED_TEST_LINES, "")


def _lines(text: Column) -> Column:
    return F.transform(F.split(text, "\n"), strip)


def first_test_name(text: Column, default: str = "test_function") -> Column:
    """Name of the first ``def test_...`` line."""
    heads = F.filter(_lines(extract_code(text)), lambda l: F.startswith(l, F.lit("def test_")))
    after_def = F.split(F.get(heads, F.lit(0)), "def ")[1]
    return F.coalesce(F.split(after_def, r"\(")[0], F.lit(default))


def assert_count(text: Column) -> Column:
    """Lines that read ``assert `` plus something, over the whole test text."""
    hits = F.filter(_lines(extract_code(text)), lambda l: F.startswith(l, F.lit("assert ")))
    return F.size(hits)


def _reported_count(stdout: Column, label: str) -> Column:
    found = F.regexp_extract_all(stdout, F.lit(RUN_COUNT_LINE.format(label=label)), F.lit(1))

    def last(fields: Column) -> Column:
        numeric = F.forall(fields, lambda v: F.rlike(v, F.lit(INTEGER)))
        value = F.regexp_replace(F.try_element_at(fields, F.lit(-1)), "_", "")
        zero = F.lit(0).cast("bigint")
        return F.when(F.size(fields) == 0, zero).when(numeric, value.try_cast("bigint"))

    return let(F.transform(found, strip), last)


def run_output_counts(stdout: Column) -> Column:
    """``struct(passed, failed)`` from a test run's output.

    No ``PASSED:`` anywhere gives (0, 0).  The last line of a kind counts; a count
    that is no integer makes the whole struct NULL, which is status ``error``.
    """
    read = F.struct(
        _reported_count(stdout, "PASSED").alias("passed"),
        _reported_count(stdout, "FAILED").alias("failed"),
    )
    integers = let(read, lambda c: F.when(c["passed"].isNotNull() & c["failed"].isNotNull(), c))
    zero = F.lit(0).cast("bigint")
    none = F.struct(zero.alias("passed"), zero.alias("failed"))
    return F.when(F.contains(stdout, F.lit("PASSED:")), integers).otherwise(none)


def lint_rating(stdout: Column) -> Column:
    """Rating out of ten; 0 when absent, negative or malformed."""
    rating = F.regexp_extract(stdout, LINT_RATING, 1).try_cast("double")
    return F.coalesce(rating, F.lit(0.0))


def preview(text: Column, length: int = 50) -> Column:
    return F.substring(text, 1, length)


def model_label(name: Column) -> Column:
    return F.upper(name)


def category_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def money(amount: Column) -> Column:
    """``$0.0000``, half up."""
    return F.concat(F.lit("$"), amount.cast("decimal(28,4)").cast("string"))


def file_stamp(ts: Column) -> Column:
    """ISO seconds with ``-`` in place of ``:``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH-mm-ss")


def document_name(stamp: Column, prompt_idx: Column | None = None) -> Column:
    """``eval_code_{1-based idx}_{stamp}`` in a batch, ``eval_{stamp}`` alone."""
    if prompt_idx is None:
        return F.concat(F.lit("eval_"), stamp)
    return F.concat(
        F.lit("eval_code_"), (prompt_idx + 1).cast("string"), F.lit("_"), stamp
    )


def prompt_key(prompt: Column, prompt_idx: Column) -> Column:
    """Id of a prompt that a rerun of the job, or of one lost task, repeats."""
    return F.sha2(F.concat_ws("\x1f", prompt_idx.cast("string"), prompt), 256)
