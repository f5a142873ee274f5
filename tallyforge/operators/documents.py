"""Assembly of evaluation documents, one row per prompt."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.scoring import EVALUATED, SYNTAX_ERROR
from tallyforge.functions.verdict import FAILED_TEXT
from tallyforge.operators.winners import best_model
from tallyforge.settings import NO_WINNER

NO_VERDICT = "no verdict recorded"


def _model_map(value: Column) -> Column:
    """Aggregate: ``map<model, value>`` in model order."""
    rows = F.array_sort(F.collect_list(F.struct("model_pos", "model", value.alias("value"))))
    return F.map_from_entries(
        F.transform(rows, lambda r: F.struct(r["model"].alias("key"), r["value"].alias("value")))
    )


def code_result() -> Column:
    """A score row; each status keeps only the fields it has."""
    status = F.col("status")
    evaluated, broken = status == EVALUATED, status == SYNTAX_ERROR
    return F.struct(
        status.alias("status"),
        F.col("score").alias("score"),
        F.when(evaluated, F.col("tests")).alias("tests"),
        F.when(evaluated, F.col("lint")).alias("lint"),
        F.when(broken, F.col("lint")).alias("details"),
        F.when(evaluated | broken, F.col("style")).alias("style"),
        F.when(~evaluated & ~broken, F.col("error")).alias("error"),
    )


def code_documents(prompts: DataFrame, scored: DataFrame) -> DataFrame:
    """(prompt_id, prompt, results, winner) per prompt.

    (prompt_id, model) is unique in `scored`; results and winner come from one
    aggregate, so the score rows are shuffled once.
    """
    grouped = scored.groupBy("prompt_id").agg(
        _model_map(code_result()).alias("results"), best_model().alias("winner")
    )
    named = F.when(F.col("winner") != "", F.col("winner")).otherwise(F.lit(NO_WINNER))
    return prompts.join(grouped, "prompt_id", "left").withColumn("winner", named)


def response_maps(responses: DataFrame) -> DataFrame:
    """(prompt_id, responses) with models in order."""
    return responses.groupBy("prompt_id").agg(_model_map(F.col("response")).alias("responses"))


def text_documents(
    prompts: DataFrame, responses: DataFrame, verdicts: DataFrame, written: bool = False
) -> DataFrame:
    """Text evaluations, or error and details where the verdict failed or never came.

    (prompt_id, model) is unique in `responses`, prompt_id in `verdicts`.  Further columns of `prompts` (a run's stamp, a batch) stay.
    With `written`, `scores_text` holds the verdict's JSON as the judge wrote it.
    """
    kept = ["json_text"] if written else []
    joined = prompts.join(response_maps(responses), "prompt_id", "left").join(
        verdicts.select("prompt_id", "status", "parsed", "winner", "error", "details", *kept),
        "prompt_id", "left",
    )
    held, missing = F.col("status") == EVALUATED, F.col("status").isNull()
    return joined.select(
        *[c for c in prompts.columns if c != "prompt"],
        F.when(held, F.col("prompt")).alias("prompt"),
        F.when(held, F.col("responses")).alias("responses"),
        F.when(held, F.col("parsed")).alias("scores"),
        "winner",
        F.when(missing, F.lit(FAILED_TEXT)).otherwise(F.col("error")).alias("error"),
        F.when(missing, F.lit(NO_VERDICT)).otherwise(F.col("details")).alias("details"),
        *[F.when(held, F.col(c)).alias("scores_text") for c in kept],
    )


def with_cost(
    documents: DataFrame, breakdown: DataFrame, on: str | list[str] = "prompt_id"
) -> DataFrame:
    """Attach a `cost_breakdown` per document."""
    return documents.join(breakdown, on, "left")
