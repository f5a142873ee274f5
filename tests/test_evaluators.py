from pyspark.sql import functions as F

from tallyforge.operators.candidates import candidates_from_reports, score_candidates, with_scores
from tallyforge.operators.winners import win_tally
from tallyforge.plans.evaluation import Evaluator, priced_documents
from tallyforge import schemas


class ShortestAnswer:
    """A kind of evaluation a user adds."""

    def evaluate(self, prompts, responses):
        best = responses.groupBy("prompt_id").agg(
            F.min_by("model", F.struct(F.length("response"), "model_pos")).alias("winner"))
        return prompts.join(best, "prompt_id", "left")


def test_a_new_kind_fits_the_protocol_and_the_tally(spark):
    kind: Evaluator = ShortestAnswer()
    prompts = spark.createDataFrame([(1, "p"), (2, "q")], "prompt_id BIGINT, prompt STRING")
    responses = spark.createDataFrame(
        [(1, "a", 0, "long one"), (1, "b", 1, "no"), (2, "a", 0, "x")], schemas.RESPONSES)
    tally = win_tally(kind.evaluate(prompts, responses)).collect()
    assert [(t.winner, t.wins) for t in tally] == [("b", 1), ("a", 1)]


def test_candidates_from_reports(spark):
    keys = "prompt_id BIGINT, model STRING"
    responses = spark.createDataFrame(
        [(1, "a", 0, "```python\nx = 1\n```"), (1, "b", 1, "def oops(:"), (1, "c", 2, "y = 2")], schemas.RESPONSES)
    reports = spark.createDataFrame(
        [(1, "a", "rated at 8.50/10", '{"results": [{}]}', 2.0)],
        keys + ", lint_stdout STRING, report_json STRING, avg_complexity DOUBLE")
    runs = spark.createDataFrame([(1, "a", "PASSED: 8\nFAILED: 2")], keys + ", stdout STRING")
    scored = score_candidates(candidates_from_reports(responses, reports, runs))
    got = {r.model: (r.status, float(r.score), r.lint.security_issues) for r in scored.collect()}
    assert got == {"a": ("evaluated", 0.702, 1), "b": ("syntax_error", 0.0, 0), "c": ("error", 0.0, 0)}
    asked = spark.createDataFrame([(1, "a"), (1, "gpt-4")], keys)
    kept = {r.model: r.status for r in with_scores(asked, scored, ["status"]).collect()}
    assert kept == {"a": "evaluated", "gpt-4": None}


def test_priced_documents(spark):
    docs = spark.createDataFrame([(1, "p"), (2, "q")], "prompt_id BIGINT, prompt STRING")
    calls = spark.createDataFrame(
        [(9, 1, None, "gpt-4", "model", 150, 200), (9, 2, None, "gpt-4", "judge", 150, 200)], schemas.CALL_LOG
    ).withColumn("prompt_id", F.lit(1).cast("bigint"))
    got = {r.prompt_id: r.cost_breakdown for r in priced_documents(docs, calls).collect()}
    assert float(got[1].total) == 0.033 and got[2] is None
