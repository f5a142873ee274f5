"""Candidate answers with their recorded tool reports to score rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions import scoring as S
from tallyforge.functions.json import allow_duplicate_keys, security_issue_count
from tallyforge.functions.python_syntax import syntax_ok
from tallyforge.functions.text import extract_code, lint_rating, run_output_counts
from tallyforge.settings import ScoreWeights

# Error texts of rows that reached no result.
TIMED_OUT = "test run timed out or reported no integer count"
UNCHECKED = "syntax was not checked"

_STYLE = "__style_score"


def score_candidates(
    candidates: DataFrame, weights: ScoreWeights = ScoreWeights()
) -> DataFrame:
    """Add `status, tests, lint, style, score, error`; one projection, no shuffle.

    Reads ``syntax_ok, security_issues, rating, avg_complexity`` and `tests`, a
    struct(passed, failed) that is NULL where the run failed.  Optional:
    `bandit_output`, `error`.

    An absent report counts as one that found nothing: NULL issues, rating and
    complexity are 0, as a scanner or linter that printed nothing is read.  A NULL
    `syntax_ok` is status ``error``.
    """
    absent = {"security_issues": "int", "rating": "double", "avg_complexity": "double"}
    candidates = candidates.withColumns({
        c: F.coalesce(F.col(c).cast(t), F.lit(0).cast(t)) for c, t in absent.items()
    })
    # A column, as it is read twice and Catalyst computes such ones once.
    candidates = candidates.withColumn(
        _STYLE, S.style_score(F.col("rating"), F.col("avg_complexity"))
    )
    style = S.style_report(F.col("rating"), F.col("avg_complexity"), F.col(_STYLE))
    report = F.col("bandit_output") if "bandit_output" in candidates.columns else F.lit(None)
    reason = F.col("error") if "error" in candidates.columns else F.lit(TIMED_OUT)
    reason = F.when(F.col("syntax_ok").isNull(), F.lit(UNCHECKED)).otherwise(reason)
    lint = F.struct(
        "syntax_ok", "security_issues",
        report.cast("string").alias("bandit_output"),
    )
    used = {"syntax_ok", "security_issues", "rating", "avg_complexity", "bandit_output",
            "tests", "error", _STYLE}
    passed, failed = F.col("tests.passed"), F.col("tests.failed")
    status = S.status(F.col("syntax_ok"), F.col("tests"))
    score = S.final_score(
        S.pass_rate(passed, failed), F.col("security_issues"), F.col(_STYLE), weights,
    )
    return candidates.select(
        *[c for c in candidates.columns if c not in used],
        status.alias("status"),
        F.when(status == S.EVALUATED, F.col("tests")).alias("tests"),
        lint.alias("lint"),
        style.alias("style"),
        F.when(status == S.EVALUATED, score)
        .otherwise(F.lit(0)).cast(schemas.SCORE).alias("score"),
        F.when(status == S.ERROR, reason).alias("error"),
    )


def candidates_from_reports(
    responses: DataFrame, reports: DataFrame, runs: DataFrame
) -> DataFrame:
    """Responses with what the outside tools wrote about them, ready to score.

    `reports` (prompt_id, model, lint_stdout, report_json, avg_complexity) and `runs`
    (prompt_id, model, stdout) have one row per answer; all three tables meet on the
    same keys.  Candidates are compiled here unless `reports` has `syntax_ok`.  Every
    text but the answer and the scanner report, which the result keeps, is reduced to
    its few values below the joins.
    """
    keys = ["prompt_id", "model"]
    allow_duplicate_keys(responses.sparkSession)
    compiled = "syntax_ok" not in reports.columns
    answers = responses
    if compiled:
        answers = answers.withColumn("syntax_ok", syntax_ok(extract_code(F.col("response"))))
    read_reports = reports.select(
        *keys, *([] if compiled else ["syntax_ok"]), "avg_complexity",
        security_issue_count(F.col("report_json")).alias("security_issues"),
        F.col("report_json").alias("bandit_output"),
        lint_rating(F.col("lint_stdout")).alias("rating"),
    )
    read_runs = runs.filter("stdout IS NOT NULL").select(
        *keys, run_output_counts(F.col("stdout")).alias("tests")
    )
    joined = answers.join(read_reports, keys, "left").join(read_runs, keys, "left")
    return joined.select(
        *responses.columns, "syntax_ok", "bandit_output", "tests",
        F.coalesce("security_issues", F.lit(0)).alias("security_issues"),
        F.coalesce("rating", F.lit(0.0)).alias("rating"),
        F.coalesce("avg_complexity", F.lit(0.0)).alias("avg_complexity"),
    )


def with_scores(rows: DataFrame, scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Attach score columns by prompt and model; rows nobody scored keep NULLs.

    Responses may lack a score, and a verdict may name models nobody ran.
    """
    return rows.join(
        scored.select("prompt_id", "model", *columns), ["prompt_id", "model"], "left"
    )


def only_where_valid(
    rows: DataFrame, costly: Callable[[DataFrame], DataFrame], valid: str = "syntax_ok"
) -> DataFrame:
    """Run a costly step on valid rows only; the others pass with NULLs.

    The two branches are disjoint filters on the input, put together by a union, so
    no join brings them back.
    """
    done = costly(rows.filter(F.col(valid)))
    skipped = rows.filter(~F.coalesce(F.col(valid), F.lit(False)))
    return done.unionByName(skipped, allowMissingColumns=True)
