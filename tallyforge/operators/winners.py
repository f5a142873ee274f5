"""Winners, rankings, runners-up and win tallies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.functions.scoring import EVALUATED
from tallyforge.settings import NO_WINNER


def contest_key(status: Column, score: Column) -> Column:
    """An evaluated 0 beats any row that was not evaluated."""
    return F.when(status == EVALUATED, score).otherwise(F.lit(-1))


def _named(winner: Column) -> Column:
    return F.when(winner != "", winner).otherwise(F.lit(NO_WINNER))


def best_model() -> Column:
    """Aggregate: first greatest score in model order."""
    key = contest_key(F.col("status"), F.col("score"))
    return F.max_by(F.col("model"), F.struct(key, -F.col("model_pos")))


def code_winner(scored: DataFrame) -> DataFrame:
    """(prompt_id, winner).  Rows that all failed still let the first model win."""
    best = scored.groupBy("prompt_id").agg(best_model().alias("winner"))
    return best.select("prompt_id", _named(F.col("winner")).alias("winner"))


def code_winner_of_prompts(prompts: DataFrame, scored: DataFrame) -> DataFrame:
    """As `code_winner`, with the sentinel for prompts nobody answered."""
    joined = prompts.select("prompt_id").join(code_winner(scored), "prompt_id", "left")
    return joined.select("prompt_id", F.coalesce("winner", F.lit(NO_WINNER)).alias("winner"))


def code_ranking(scored: DataFrame) -> DataFrame:
    """Every model's place in its prompt; place 1 is the winner.

    (prompt_id, model) is unique in `scored`, so a window holds one model list.
    """
    key = contest_key(F.col("status"), F.col("score"))
    order = Window.partitionBy("prompt_id").orderBy(key.desc(), F.col("model_pos"))
    return scored.select(
        "prompt_id", "model", "model_pos", "score", F.row_number().over(order).alias("place")
    )


def first_two_models(responses: DataFrame) -> DataFrame:
    """(prompt_id, first_model, second_model) by position.

    ``row_number <= 2`` lets Spark keep two rows per prompt in each map task before
    the shuffle (WindowGroupLimit).
    """
    order = Window.partitionBy("prompt_id").orderBy("model_pos")
    top = (
        responses.select("prompt_id", "model", "model_pos")
        .withColumn("nth", F.row_number().over(order))
        .filter("nth <= 2")
    )

    def nth(n: int) -> Column:
        return F.max(F.when(F.col("nth") == n, F.col("model")))

    return top.groupBy("prompt_id").agg(
        nth(1).alias("first_model"), nth(2).alias("second_model")
    )


def runner_up(responses: DataFrame, winners: DataFrame) -> DataFrame:
    """First model in order that is not the winner; NULL when there is none.

    The winner is one of the first two models or neither, so two models per prompt
    decide, and both sides of the join hold one row per prompt.
    """
    pairs = first_two_models(responses).join(winners, "prompt_id")
    other = F.when(
        ~F.col("first_model").eqNullSafe(F.col("winner")), F.col("first_model")
    ).otherwise(F.col("second_model"))
    return pairs.select("prompt_id", "winner", other.alias("runner_up"))


def runner_up_in_order(models: Column, winner: Column) -> Column:
    """The same from an ordered array of one prompt's models."""
    return F.get(F.filter(models, lambda m: ~m.eqNullSafe(winner)), F.lit(0))


def named_winner(winner: Column) -> Column:
    return winner.isNotNull() & (winner != "")


def win_tally(winners: DataFrame, order: str = "prompt_id") -> DataFrame:
    """(winner, wins, first_win), listed by first win."""
    return (
        winners.filter(named_winner(F.col("winner")))
        .groupBy("winner")
        .agg(F.count("*").alias("wins"), F.min(order).alias("first_win"))
        .orderBy("first_win")
    )


def winner_disagreement(score_winners: DataFrame, judge_winners: DataFrame) -> DataFrame:
    """Prompts where the score and the judge name different winners."""
    pairs = score_winners.select("prompt_id", F.col("winner").alias("score_winner")).join(
        judge_winners.select("prompt_id", F.col("winner").alias("judge_winner")), "prompt_id"
    )
    return pairs.filter(~F.col("score_winner").eqNullSafe(F.col("judge_winner")))
