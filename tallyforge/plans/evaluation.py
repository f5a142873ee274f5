"""Evaluation kinds.  A new kind is a class with the same `evaluate`."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.functions.json import is_empty_object
from tallyforge.operators.candidates import score_candidates
from tallyforge.operators.cost import cost_breakdown, cost_rollup, price_calls, running_rollup
from tallyforge.operators.documents import code_documents, text_documents, with_cost
from tallyforge.operators.keyed import last_per_key
from tallyforge.operators.verdicts import parse_code_verdicts, parse_text_verdicts
from tallyforge.settings import PriceBook, ScoreWeights


class Evaluator(Protocol):
    """From prompts and recorded responses to one document row per prompt."""

    def evaluate(self, prompts: DataFrame, responses: DataFrame) -> DataFrame: ...


@dataclass(frozen=True)
class CodeEvaluator:
    """Scores code answers; `responses` carry their tool reports and test counts.

    `verdicts` (prompt_id, judge_text) adds the judge's analysis.  It never changes
    the winner, which the score alone decides.  Of repeated answers of a model, and of
    repeated verdicts, the last by the columns of `order` counts; equal ones are told
    apart by their other columns.
    """

    weights: ScoreWeights = field(default_factory=ScoreWeights)
    verdicts: DataFrame | None = None
    order: Sequence[str] = ()
    written: bool = False

    def evaluate(self, prompts: DataFrame, responses: DataFrame) -> DataFrame:
        last = _last(responses, ["prompt_id", "model"], self.order)
        documents = code_documents(prompts, score_candidates(last, self.weights))
        if self.verdicts is None:
            return documents
        # Broken JSON counts as an empty object, which then has no text of its own.
        parsed = parse_code_verdicts(_last(self.verdicts, ["prompt_id"], self.order))
        own_text = F.when(~is_empty_object(F.col("parsed")), F.col("json_text"))
        analysis = parsed.select(
            "prompt_id", F.col("parsed").alias("judge_analysis"),
            *([own_text.alias("judge_analysis_text")] if self.written else []),
        )
        return documents.join(analysis, "prompt_id", "left")


@dataclass(frozen=True)
class TextEvaluator:
    """Takes the judge's word: `verdicts` (prompt_id, judge_text) name the winners.

    Repeated answers and verdicts collapse to the last, as in `CodeEvaluator`.  With
    `written`, documents carry the verdict's own text too (`scores_text`).
    """

    verdicts: DataFrame
    order: Sequence[str] = ()
    written: bool = False

    def evaluate(self, prompts: DataFrame, responses: DataFrame) -> DataFrame:
        return text_documents(
            prompts, _last(responses, ["prompt_id", "model"], self.order),
            parse_text_verdicts(_last(self.verdicts, ["prompt_id"], self.order)), self.written,
        )


def _last(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key; `order` may name columns that only one of the tables has."""
    return last_per_key(rows, keys, [c for c in order if c in rows.columns])


def priced_documents(
    documents: DataFrame, calls: DataFrame, prices: PriceBook | DataFrame = PriceBook(),
    session: Sequence[str] | None = None,
) -> DataFrame:
    """Attach a cost breakdown per prompt; `calls` carry the prompt_id.

    Without `session` it is the prompt's own.  With the columns of a session, which
    `documents` have too, it is what the session's tracker shows at that prompt: all
    calls so far, in the order of the prompt ids.
    """
    priced = price_calls(calls, prices)
    if session is None:
        return with_cost(documents, cost_breakdown(cost_rollup(priced, ["prompt_id"]), ["prompt_id"]))
    keys = [*session, "prompt_id"]
    rollup = running_rollup(priced, "prompt_id", session)
    return with_cost(documents, cost_breakdown(rollup, keys), keys)
