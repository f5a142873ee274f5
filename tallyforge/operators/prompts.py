"""Fan-out of prompts to models, request messages and judge prompts."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge import prompt_texts as P
from tallyforge.functions.scoring import EVALUATED, SYNTAX_ERROR


def fill(template: str, **values: Column) -> Column:
    """Concatenate a template's literal parts with columns.

    Values are never searched for marks, so a prompt that contains one is safe.
    """
    parts = re.split(r"<<(\w+)>>", template)
    columns = [values[p] if i % 2 else F.lit(p) for i, p in enumerate(parts)]
    return F.concat(*columns)


def fan_out(prompts: DataFrame, models: Sequence[str]) -> DataFrame:
    """One row per prompt and model, in model order.

    The ordered model list is an argument, so this is a row-local explode and no join.
    """
    names = F.array(*[F.lit(m) for m in models])
    return prompts.select("*", F.posexplode(names).alias("model_pos", "model"))


def messages(prompt: Column, kind: Column) -> Column:
    """System and user message of a request."""
    system = F.when(kind == "code", F.lit(P.SYSTEM_TEXT["code"])).otherwise(
        F.lit(P.SYSTEM_TEXT["text"])
    )
    return F.array(
        F.struct(F.lit("system").alias("role"), system.alias("content")),
        F.struct(F.lit("user").alias("role"), prompt.alias("content")),
    )


def request_rows(fanned: DataFrame, kind: Column | str) -> DataFrame:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    return fanned.withColumn("messages", messages(F.col("prompt"), kind))


def writer_prompt(prompt: Column, code: Column) -> Column:
    return fill(P.TEST_WRITER, prompt=prompt, code=code)


def text_judge_section() -> Column:
    return fill(P.TEXT_JUDGE_SECTION, model=F.col("model"), response=F.col("response"))


def code_judge_section() -> Column:
    """A model's code with its results, printed as the score row has them."""
    status = F.coalesce("status", F.lit("unknown"))
    evaluated = status == EVALUATED
    styled = evaluated | (status == SYNTAX_ERROR)

    def style(name: str) -> Column:
        return F.when(styled, F.col(f"style.{name}").cast("string")).otherwise(F.lit("0"))

    tests = F.concat(
        F.lit("{'passed': "), F.col("tests.passed").cast("string"),
        F.lit(", 'failed': "), F.col("tests.failed").cast("string"), F.lit("}"),
    )
    return fill(
        P.CODE_JUDGE_SECTION,
        model=F.col("model"),
        response=F.col("response"),
        status=status,
        score=F.when(evaluated, F.col("score").cast("double").cast("string")).otherwise(F.lit("0")),
        tests=F.when(evaluated, tests).otherwise(F.lit("{}")),
        style_score=style("style_score"),
        pylint_score=style("pylint_score"),
        complexity=style("average_complexity"),
        issues=F.when(evaluated, F.col("lint.security_issues").cast("string")).otherwise(F.lit("0")),
    )


def _ordered_models() -> Column:
    return F.transform(
        F.array_sort(F.collect_list(F.struct("model_pos", "model"))), lambda r: r["model"]
    )


def text_judge_prompts(
    responses: DataFrame, format_models: Sequence[str] | None = None
) -> DataFrame:
    """(prompt_id, judge_prompt) from (prompt_id, prompt, model, model_pos, response).

    One row holds all answers to a prompt, so its group is one model list; apply
    `last_per_key` first when an answer may be logged twice.  The JSON format names
    the prompt's own models, or `format_models` when given.
    """
    grouped = responses.withColumn("section", text_judge_section()).groupBy("prompt_id").agg(
        F.min("prompt").alias("prompt"),
        _sections().alias("sections"),
        _ordered_models().alias("models"),
    )
    models = _named_or(format_models)

    def entry(model: Column, first: Column) -> Column:
        return fill(
            P.TEXT_JUDGE_ENTRY, model=model,
            correctness=F.when(first, F.lit("5")).otherwise(F.lit("3")),
            relevance=F.when(first, F.lit("5")).otherwise(F.lit("4")),
        )

    text = F.concat(
        fill(P.TEXT_JUDGE_HEAD, prompt=F.col("prompt")),
        F.col("sections"),
        F.lit(P.TEXT_JUDGE_TASK),
        F.array_join(F.transform(models, lambda m, i: entry(m, i == 0)), ""),
        fill(P.TEXT_JUDGE_TAIL, winner=models[0]),
    )
    return grouped.select("prompt_id", text.alias("judge_prompt"))


def code_judge_prompts(
    scored: DataFrame, format_models: Sequence[str] | None = None
) -> DataFrame:
    """As `text_judge_prompts`, each answer with its evaluation results."""
    grouped = scored.withColumn("section", code_judge_section()).groupBy("prompt_id").agg(
        F.min("prompt").alias("prompt"),
        _sections().alias("sections"),
        _ordered_models().alias("models"),
    )
    entries = F.transform(
        _named_or(format_models), lambda m: fill(P.CODE_JUDGE_ENTRY, model=m)
    )
    text = F.concat(
        fill(P.CODE_JUDGE_HEAD, prompt=F.col("prompt")),
        F.col("sections"),
        F.lit(P.CODE_JUDGE_TASK),
        F.array_join(entries, ""),
        F.lit(P.CODE_JUDGE_TAIL),
    )
    return grouped.select("prompt_id", text.alias("judge_prompt"))


def _sections() -> Column:
    return F.expr("listagg(section, '') within group (order by model_pos)")


def _named_or(format_models: Sequence[str] | None) -> Column:
    if format_models is None:
        return F.col("models")
    return F.array(*[F.lit(m) for m in format_models])
