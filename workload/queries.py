"""Registered queries: each runs an operator over whole tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scoring as S
from tallyforge.functions import text as X
from tallyforge.functions.json import allow_duplicate_keys, security_issue_count
from tallyforge.functions.python_syntax import syntax_ok as compiles
from tallyforge.operators import cost as C
from tallyforge.operators import documents as D
from tallyforge.operators import prompts as P
from tallyforge.operators import reports as R
from tallyforge.operators import verdicts as VD
from tallyforge.operators import winners as W
from tallyforge.operators.calls import call_models
from tallyforge.operators.candidates import (
    candidates_from_reports,
    only_where_valid,
    score_candidates,
    with_scores,
)
from tallyforge.operators.keyed import last_per_key
from tallyforge.operators.running import enumerate_rows
from tallyforge.operators.snippets import avg_complexity as mean_complexity
from tallyforge.operators.snippets import finding_count
from tallyforge.plans.evaluation import CodeEvaluator, TextEvaluator, priced_documents
from tallyforge.settings import PriceBook, ScoreWeights
from tallyforge.sources import documents as SD
from tallyforge.sources.prompts import (
    read_prompt_arrays,
    read_prompts,
    single_prompt,
    write_prompt_arrays,
    write_prompt_batches,
)
from tallyforge.sources.responses import (
    read_call_log,
    read_call_stream,
    read_responses,
    responses_from_map,
    stripped,
)
from tallyforge.sources.scratch import scratch_path
from tallyforge.streaming import live
from tallyforge.streaming.tracker import run_reset_sessions
from workload import views as V

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# ---- code scores and winners -------------------------------------------------

def _score_columns(scored: DataFrame) -> DataFrame:
    return scored.select(
        "prompt_id", "model", "model_pos", "status",
        F.col("tests.passed").alias("passed"), F.col("tests.failed").alias("failed"),
        F.col("style.style_score").alias("style_score"), "score",
    )


@query
def code_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _score_columns(V.scored_runs(spark, sf))


@query
def code_scores_custom_weights(spark, sf):
    weights = ScoreWeights(functionality=0.5, style=0.5, penalty_per_issue=0.05)
    return _score_columns(V.scored_runs(spark, sf, weights))


@query
def scores_from_sparse_reports(spark, sf):
    """Linter and scanner reports for some snippets only; absent ones found nothing."""
    parts = V.tool_outputs(spark, sf)
    reports = parts.filter("lint_stdout <> ''").select(
        "snippet_id", X.lint_rating(F.col("lint_stdout")).alias("rating"),
        security_issue_count(F.col("report_json")).alias("security_issues"),
    )
    candidates = parts.select("snippet_id", "stdout").join(reports, "snippet_id", "left").select(
        F.col("snippet_id").alias("prompt_id"), F.lit("model-0").alias("model"),
        F.lit(0).alias("model_pos"), F.when(F.col("snippet_id") % 5 > 0, True).alias("syntax_ok"),
        "security_issues", "rating", F.lit(None).cast("double").alias("avg_complexity"),
        X.run_output_counts(F.col("stdout")).alias("tests"),
    )
    return score_candidates(candidates).select("prompt_id", "status", "score", "error")


@query
def scores_from_reports(spark, sf):
    """From answers, linter and scanner output, block table and run output to scores."""
    outputs = V.tool_outputs(spark, sf).select(
        F.col("snippet_id").alias("prompt_id"), F.lit("model-0").alias("model"),
        F.lit(0).alias("model_pos"), "text", "lint_stdout", "report_json", "stdout",
    )
    blocks = V.blocks(spark, sf).withColumnRenamed("snippet_id", "prompt_id")
    candidates = candidates_from_reports(
        outputs.select("prompt_id", "model", "model_pos", F.col("text").alias("response")),
        mean_complexity(
            outputs.select("prompt_id", "model", "lint_stdout", "report_json"), blocks, "prompt_id"
        ),
        outputs.select("prompt_id", "model", "stdout"),
    )
    return _score_columns(score_candidates(candidates))


@query
def code_winner(spark, sf):
    return W.code_winner(V.scored_runs(spark, sf))


@query
def code_winner_of_prompts(spark, sf):
    prompts = V.table(spark, sf, "orders").select(F.col("o_orderkey").alias("prompt_id"))
    return W.code_winner_of_prompts(prompts, V.scored_runs(spark, sf))


@query
def code_ranking(spark, sf):
    return W.code_ranking(V.scored_runs(spark, sf))


@query
def code_win_tally(spark, sf):
    return W.win_tally(W.code_winner(V.scored_runs(spark, sf)))


@query
def code_win_lines(spark, sf):
    return R.tally_lines(W.win_tally(W.code_winner(V.scored_runs(spark, sf))))


@query
def code_runner_up(spark, sf):
    scored = V.scored_runs(spark, sf)
    return W.runner_up(scored, W.code_winner(scored))


@query
def syntax_short_circuit(spark, sf):
    """Test-writing requests for parseable candidates only."""

    def write_requests(valid: DataFrame) -> DataFrame:
        code = X.extract_code(F.col("response"))
        return valid.withColumn("test_request", P.writer_prompt(F.col("prompt"), code))

    return only_where_valid(V.code_runs(spark, sf), write_requests).select(
        "prompt_id", "model", "syntax_ok", "test_request"
    )


@query
def last_answers(spark, sf):
    rows = V.logged_answers(spark, sf).withColumn("l_shipdate", F.to_date("l_shipdate"))
    return last_per_key(rows, ["prompt_id", "model_pos"], V.ANSWER_ORDER).select(
        "prompt_id", "model_pos", "l_partkey", "l_suppkey", "l_returnflag"
    )


@query
def winner_disagreement(spark, sf):
    judged = VD.parse_code_verdicts(V.code_verdicts(spark, sf))
    return W.winner_disagreement(W.code_winner(V.scored_runs(spark, sf)), judged)


@query
def verdict_score_rows(spark, sf):
    """Score rows of the models a code verdict names; missing ones stay."""
    judged = VD.parse_code_verdicts(V.code_verdicts(spark, sf))
    named = VD.verdict_marks(judged).select("prompt_id", "model")
    return _with_default_scores(named, V.scored_runs(spark, sf))


@query
def response_score_rows(spark, sf):
    """Score rows of all prompts times three models; missing ones stay."""
    asked = P.fan_out(_code_prompts(spark, sf), ["model-1", "model-3", "gpt-4"])
    return _with_default_scores(asked.select("prompt_id", "model"), V.scored_runs(spark, sf))


def _with_default_scores(rows: DataFrame, scored: DataFrame) -> DataFrame:
    return with_scores(rows, scored, ["status", "score"]).select(
        "prompt_id", "model",
        F.coalesce("status", F.lit("unknown")).alias("status"),
        F.coalesce("score", F.lit(0)).cast("decimal(6,3)").alias("score"),
    )


# ---- costs -------------------------------------------------------------------

def _priced(spark, sf, prices=PriceBook()):
    return C.price_calls(V.call_log(spark, sf), prices)


@query
def call_costs(spark, sf):
    return _priced(spark, sf).select("call_seq", "session_id", "model", "book", "cost")


@query
def call_costs_custom_prices(spark, sf):
    """Prices from a table: one per supplier-nation model, checked before broadcast."""
    nations = V.table(spark, sf, "nation").select(
        F.concat(F.lit("nation-"), F.col("n_nationkey").cast("string")).alias("model"),
        (F.col("n_nationkey") * F.lit("0.001").cast("decimal(4,3)")).cast("decimal(10,6)")
        .alias("input_per_1k"),
        (F.col("n_regionkey") * F.lit("0.002").cast("decimal(4,3)")).cast("decimal(10,6)")
        .alias("output_per_1k"),
    )
    calls = V.call_log(spark, sf).withColumn(
        "model", F.concat(F.lit("nation-"), (F.col("session_id") % 30).cast("string"))
    )
    return C.price_calls(calls, nations).select("call_seq", "model", "cost")


@query
def cost_rollup(spark, sf):
    return C.cost_rollup(_priced(spark, sf))


@query
def cost_total(spark, sf):
    return C.cost_total(_priced(spark, sf))


@query
def cost_rollup_and_total(spark, sf):
    return C.cost_rollup_and_total(_priced(spark, sf))


@query
def cost_running(spark, sf):
    return C.running_cost(_priced(spark, sf)).select("session_id", "call_seq", "running_cost")


@query
def cost_running_many_buckets(spark, sf):
    """The same over far more ranges than a session would need."""
    return C.running_cost(_priced(spark, sf), ranges=64).select(
        "session_id", "call_seq", "running_cost"
    )


@query
def cost_running_by_model(spark, sf):
    return C.running_cost_by_model(_priced(spark, sf)).select(
        "session_id", "book", "model", "call_seq", "running_calls", "running_cost"
    )


@query
def cost_reset_sessions(spark, sf):
    numbered = C.number_sessions(
        _priced_log(spark, sf), F.col("is_reset"), ["session_id"]
    )
    return C.cost_total(numbered, ["session_id", "session_no"])


@query
def cost_reset_sessions_one_log(spark, sf):
    """The whole log as one tracker's."""
    numbered = C.number_sessions(_priced_log(spark, sf), F.col("is_reset"))
    return C.cost_total(numbered, ["session_no"])


def _priced_log(spark, sf):
    return _priced(spark, sf).select("session_id", "call_seq", "is_reset", "cost")


@query
def cost_breakdown_doc(spark, sf):
    return C.breakdown_rows(C.cost_breakdown(C.cost_rollup(_priced(spark, sf))))


@query
def cost_summary_lines(spark, sf):
    return C.cost_summary_lines(C.cost_breakdown(C.cost_rollup(_priced(spark, sf))))


def _snapshots(spark, sf):
    running = C.running_cost(_priced(spark, sf)).withColumn(
        "prompt_no", F.floor(F.col("call_seq") / 100)
    )
    return C.cost_snapshots(running, ["session_id", "prompt_no"])


@query
def cost_snapshots(spark, sf):
    return _snapshots(spark, sf)


@query
def running_breakdown_docs(spark, sf):
    """Documents with what their session's tracker shows at that prompt, opened again."""
    calls = V.call_log(spark, sf).withColumn("prompt_id", F.floor(F.col("call_seq") / 100))
    documents = calls.select("session_id", "prompt_id").distinct()
    shown = priced_documents(documents, calls, session=["session_id"])
    return C.breakdown_rows(shown, ["session_id", "prompt_id"])


@query
def cost_sum_own_vs_compat(spark, sf):
    return C.cost_over_documents(_snapshots(spark, sf))


# ---- verdicts ----------------------------------------------------------------

def _judged(spark, sf):
    return VD.parse_text_verdicts(V.verdicts(spark, sf))


@query
def verdict_status(spark, sf):
    return _judged(spark, sf).select("prompt_id", "status", "error")


@query
def verdict_winner(spark, sf):
    return _judged(spark, sf).select(
        "prompt_id", "winner", "winner_reasoning", "loser_reasoning"
    )


@query
def verdict_marks(spark, sf):
    return VD.verdict_marks(_judged(spark, sf))


@query
def verdict_mark_stats(spark, sf):
    return VD.mark_stats(VD.verdict_marks(_judged(spark, sf)))


@query
def text_win_tally(spark, sf):
    return W.win_tally(_judged(spark, sf))


@query
def text_runner_up(spark, sf):
    responses = responses_from_map(V.text_answers(spark, sf))
    held = _judged(spark, sf).filter("status = 'evaluated'").select("prompt_id", "winner")
    return W.runner_up(responses, held)


@query
def verdict_report(spark, sf):
    return R.text_report(_judged(spark, sf))


@query
def verdict_report_as_written(spark, sf):
    """Reports of marks that are floats, lists and objects, as Python prints them."""
    return R.text_report(VD.parse_text_verdicts(V.written_verdicts(spark, sf)))


@query
def code_verdict_report(spark, sf):
    results = D.code_documents(_code_prompts(spark, sf), V.scored_runs(spark, sf)).select(
        "prompt_id", "results"
    )
    judged = VD.parse_code_verdicts(V.code_verdicts(spark, sf))
    return R.code_report(judged.join(results, "prompt_id"))


# ---- text functions ----------------------------------------------------------

@query
def extract_code(spark, sf):
    return V.answers(spark, sf).select(
        "prompt_id", X.extract_code(F.col("response")).alias("code")
    )


@query
def stripped_responses(spark, sf):
    documents = V.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.lit(" \n 　"), "text", F.lit(" \t ")).alias("response")
    )
    return stripped(documents)


@query
def clean_tests(spark, sf):
    return V.tool_outputs(spark, sf).select(
        "snippet_id", X.clean_tests(F.col("text")).alias("tests")
    )


@query
def test_name(spark, sf):
    return V.tool_outputs(spark, sf).select(
        "snippet_id", X.first_test_name(F.col("text")).alias("test_name")
    )


@query
def assert_count(spark, sf):
    return V.tool_outputs(spark, sf).select(
        "snippet_id", X.assert_count(F.col("text")).alias("asserts")
    )


@query
def run_output_counts(spark, sf):
    counts = X.run_output_counts(F.col("stdout"))
    return V.tool_outputs(spark, sf).select("snippet_id", counts.alias("c")).select(
        "snippet_id", F.col("c.passed").alias("passed"), F.col("c.failed").alias("failed")
    )


@query
def lint_rating(spark, sf):
    return V.tool_outputs(spark, sf).select(
        "snippet_id", X.lint_rating(F.col("lint_stdout")).alias("rating")
    )


@query
def security_count(spark, sf):
    allow_duplicate_keys(spark)
    return V.tool_outputs(spark, sf).select(
        "snippet_id", security_issue_count(F.col("report_json")).alias("security_issues")
    )


@query
def finding_counts(spark, sf):
    snippets = V.tool_outputs(spark, sf).select("snippet_id")
    return finding_count(snippets, V.blocks(spark, sf))


@query
def avg_complexity(spark, sf):
    snippets = V.tool_outputs(spark, sf).select("snippet_id")
    return mean_complexity(snippets, V.blocks(spark, sf))


@query
def style_reports(spark, sf):
    """Linter output and block table to style reports."""
    rated = V.tool_outputs(spark, sf).select(
        "snippet_id", X.lint_rating(F.col("lint_stdout")).alias("rating")
    )
    report = S.style_report(F.col("rating"), F.col("avg_complexity"))
    return mean_complexity(rated, V.blocks(spark, sf)).select(
        "snippet_id", report.alias("r")
    ).select("snippet_id", "r.*")


@query
def syntax_ok(spark, sf):
    return V.tool_outputs(spark, sf).select(
        "snippet_id", compiles(X.extract_code(F.col("text"))).alias("syntax_ok")
    )


@query
def prompt_previews(spark, sf):
    return V.table(spark, sf, "documents").select(
        "doc_id", X.preview(F.col("text")).alias("preview"),
        X.model_label(F.col("lang")).alias("label"),
        X.category_label(F.concat_ws("_", "lang", F.lit("code_quality"))).alias("category"),
    )


# ---- prompts and requests ----------------------------------------------------

def _batches(spark, sf):
    """Benchmark texts as batch files of some 20 MB, read back."""
    path = scratch_path(spark, "prompt_batches")
    prompts = V.table(spark, sf, "benchmark").select(
        F.floor(F.col("item_id") / 50_000).alias("batch"), "item_id", F.col("text").alias("prompt")
    )
    write_prompt_batches(prompts, path, "batch", "item_id")
    return read_prompts(spark, path).select(
        F.col("batch").cast("bigint").alias("batch"), "prompt_idx", "prompt"
    )


@query
def prompt_batch(spark, sf):
    return _batches(spark, sf)


@query
def prompt_arrays(spark, sf):
    """Whole texts as arrays of a megabyte each, every array split and read back."""
    path = scratch_path(spark, "prompt_arrays")
    texts = V.table(spark, sf, "documents").select("doc_id", "text")
    write_prompt_arrays(texts, path, "doc_id", "text", file_bytes=1 << 20)
    return read_prompt_arrays(spark, path).withColumn("batch", F.col("batch").cast("bigint"))


@query
def single_prompt_responses(spark, sf):
    """The answers to one prompt, by its text, out of all recorded conversations."""
    answers = V.answers(spark, sf)
    first = answers.agg(F.min("prompt").alias("prompt")).first()["prompt"]
    return single_prompt(spark, first).join(answers, "prompt").select(
        "prompt_idx", "prompt", "prompt_id", "model", "response"
    )


@query
def prompt_fanout(spark, sf):
    return P.fan_out(_batches(spark, sf), ["model-a", "model-b"])


@query
def enumerated_prompts(spark, sf):
    documents = V.table(spark, sf, "documents").select("doc_id", "lang")
    return enumerate_rows(documents, "doc_id", start=1)


@query
def requests(spark, sf):
    prompts = V.table(spark, sf, "documents").select(
        F.col("doc_id").alias("prompt_id"), F.col("text").alias("prompt"), "lang"
    )
    fanned = P.fan_out(prompts, ["model-a", "model-b"])
    kind = F.when(F.col("lang") == "en", "code").otherwise("text")
    message = F.col("messages")
    return P.request_rows(fanned, kind).select(
        "prompt_id", "model", "model_pos",
        message[0]["content"].alias("system_text"), message[1]["content"].alias("user_text"),
    )


@query
def map_responses(spark, sf):
    return responses_from_map(V.text_answers(spark, sf))


@query
def recorded_responses(spark, sf):
    """Answers saved as a table and read through the declared schema."""
    path = scratch_path(spark, "responses")
    responses_from_map(V.text_answers(spark, sf)).write.parquet(path)
    return read_responses(spark, path)


@query
def recorded_calls(spark, sf):
    """The call log saved as a table, read through the declared schema, and priced."""
    path = scratch_path(spark, "call_log")
    V.call_log(spark, sf).write.parquet(path)
    return C.price_calls(read_call_log(spark, path)).select(
        "call_seq", "session_id", "model", "book", "cost"
    )


@query
def response_listing(spark, sf):
    return R.response_listing(V.answer_pairs(spark, sf)).orderBy("prompt_id", "model_pos")


@query
def judge_prompts_text(spark, sf):
    return P.text_judge_prompts(V.answer_pairs(spark, sf))


@query
def judge_prompts_code(spark, sf):
    return P.code_judge_prompts(V.scored_runs(spark, sf))


@query
def test_requests(spark, sf):
    return V.answers(spark, sf).select(
        "prompt_id",
        P.writer_prompt(F.col("prompt"), X.extract_code(F.col("response"))).alias("test_request"),
    )


@query
def stub_judge(spark, sf):
    """A plug-in function in the judge's place: it counts characters."""

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        sizes = batch["judge_prompt"].str.len()
        return pd.DataFrame({
            "response": '{"winner": "' + batch["prompt_id"].astype(str) + '"}',
            "input_tokens": sizes,
            "output_tokens": sizes % 7,
        })

    return call_models(P.text_judge_prompts(V.answer_pairs(spark, sf)), answer).drop(
        "judge_prompt"
    )


# ---- documents ---------------------------------------------------------------

def _code_prompts(spark, sf):
    key = F.col("o_orderkey")
    return V.table(spark, sf, "orders").select(
        key.alias("prompt_id"),
        F.concat(F.lit("Write function f"), key.cast("string")).alias("prompt"),
        F.col("o_orderdate").alias("run_at"),
    )


@query
def evaluation_docs(spark, sf):
    """Code documents, named, with their results opened again."""
    documents = CodeEvaluator(verdicts=V.code_verdicts(spark, sf)).evaluate(
        _code_prompts(spark, sf), V.code_runs(spark, sf)
    )
    name = X.document_name(X.file_stamp(F.col("run_at")), F.col("prompt_id"))
    return documents.select(
        "prompt_id", "winner", name.alias("file_name"),
        F.try_variant_get("judge_analysis", "$.winner", "string").alias("judge_winner"),
        X.prompt_key(F.col("prompt"), F.col("prompt_id")).alias("prompt_key"),
        F.explode_outer("results").alias("model", "result"),
    ).select(
        "prompt_id", "winner", "file_name", "judge_winner", "prompt_key", "model",
        "result.status", "result.score",
        F.col("result.tests.passed").alias("passed"),
        F.col("result.lint.security_issues").alias("issues"),
        F.col("result.details.security_issues").alias("details_issues"),
        F.col("result.error").alias("error"),
    )


@query
def text_evaluation_docs(spark, sf):
    answers = V.text_answers(spark, sf)
    documents = TextEvaluator(V.verdicts(spark, sf)).evaluate(
        answers.select("prompt_id", "prompt"), responses_from_map(answers)
    )
    return documents.select(
        "prompt_id", "prompt", "winner", "error",
        F.array_join(F.map_keys("responses"), ",").alias("models"),
        F.element_at("responses", F.lit("model-b")).alias("second_response"),
    )


@query
def text_evaluation_docs_sparse(spark, sf):
    """Verdicts for finished orders only; every prompt still gets a document."""
    answers = V.text_answers(spark, sf)
    finished = V.as_verdicts(V.table(spark, sf, "orders").filter("o_orderstatus = 'F'"))
    documents = TextEvaluator(finished).evaluate(
        answers.select("prompt_id", "prompt"), responses_from_map(answers)
    )
    return documents.select("prompt_id", "prompt", "winner", "error", "details")


@query
def evaluation_docs_repeated(spark, sf):
    """Every logged answer goes in; the last of each model counts."""
    documents = CodeEvaluator(order=V.ANSWER_ORDER).evaluate(
        _code_prompts(spark, sf), V.logged_runs(spark, sf)
    )
    return documents.select(
        "prompt_id", "winner", F.explode_outer("results").alias("model", "result")
    ).select("prompt_id", "winner", "model", "result.status", "result.score")


@query
def document_json(spark, sf):
    """Pretty JSON text of each text document, read back field by field."""
    answers = V.text_answers(spark, sf)
    text = SD.as_json(F.struct("prompt", "responses"))
    parsed = answers.select("prompt_id", text.alias("doc")).select(
        "prompt_id",
        F.get_json_object("doc", "$.prompt").alias("prompt"),
        F.get_json_object("doc", "$.responses.model-a").alias("first_response"),
        F.size(F.split("doc", "\n")).alias("lines"),
    )
    return parsed


@query
def document_texts(spark, sf):
    """Text evaluations, failed ones too, as the indented JSON that a saved file holds."""
    answers = V.text_answers(spark, sf)
    documents = TextEvaluator(V.verdicts(spark, sf), written=True).evaluate(
        answers.select("prompt_id", "prompt"), responses_from_map(answers)
    )
    return documents.select("prompt_id", SD.document_text(documents.columns).alias("doc"))


@query
def priced_docs(spark, sf):
    """Documents with the cost of their own calls."""
    documents = V.text_answers(spark, sf).select("prompt_id", "prompt")
    calls = V.call_log(spark, sf).withColumn("prompt_id", F.floor(F.col("call_seq") / 10))
    priced = priced_documents(documents, calls)
    return priced.select(
        "prompt_id", F.col("cost_breakdown.total").alias("total"),
        F.size("cost_breakdown.model_calls").alias("model_kinds"),
    )


@query
def saved_docs_roundtrip(spark, sf):
    """Text documents written as JSON by run and read back."""
    answers = V.text_answers(spark, sf)
    prompts = answers.select(
        "prompt_id", "prompt", F.date_format("run_at", "yyyy").alias("run_ts")
    )
    documents = TextEvaluator(V.verdicts(spark, sf)).evaluate(
        prompts, responses_from_map(answers)
    )
    path = scratch_path(spark, "documents")
    SD.write_documents(
        documents.withColumn("prompt_id", F.col("prompt_id").cast("string")), path
    )
    back = SD.read_documents(spark, path, multi_line=False)
    return back.select(
        F.col("prompt_id").cast("bigint").alias("prompt_id"), "kind", "winner",
        F.try_variant_get("scores", "$.model-a.correctness", "double").alias("first_mark"),
    )


@query
def saved_code_docs_roundtrip(spark, sf):
    """Code documents written as JSON by run, read back and opened."""
    prompts = _code_prompts(spark, sf).withColumn("run_ts", F.date_format("run_at", "yyyy")).drop("run_at")
    documents = CodeEvaluator().evaluate(prompts, V.code_runs(spark, sf))
    path = scratch_path(spark, "code_documents")
    SD.write_documents(documents.withColumn("prompt_id", F.col("prompt_id").cast("string")), path)
    back = SD.read_documents(spark, path, multi_line=False)
    return back.select(
        F.col("prompt_id").cast("bigint").alias("prompt_id"), "winner",
        F.explode_outer("results").alias("model", "result"),
    ).select(
        "prompt_id", "winner", "model", "result.status", "result.score",
        F.col("result.tests.passed").alias("passed"),
        F.col("result.style.style_score").alias("style_score"),
    )


# ---- streams -----------------------------------------------------------------

def _event_stream(spark, sf):
    schema = V.table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


@query
def stream_cost_rollup(spark, sf):
    calls = V.as_call_log(_event_stream(spark, sf))
    return live.run_updates(
        live.live_cost_rollup(calls), scratch_path(spark, "cost_rollup"),
        ["session_id", "book", "model"],
    )


@query
def stream_call_log(spark, sf):
    """The call log delivered twice, file by file, and each call counted once."""
    path = scratch_path(spark, "delivered")
    for _ in range(2):
        V.call_log(spark, sf).write.mode("append").parquet(path)
    calls = read_call_stream(spark, path, horizon="30 days", files_per_batch=1)
    return live.run_call_costs(calls, scratch_path(spark, "call_costs"))


@query
def stream_reset_sessions(spark, sf):
    """Totals between resets of every session, kept as the log arrives."""
    calls = V.as_call_log(_event_stream(spark, sf))
    return run_reset_sessions(
        calls, scratch_path(spark, "reset_sessions"), F.col("is_reset"), block_calls=256
    )


@query
def stream_cost_windows(spark, sf):
    """Hourly costs of every hour, open ones and late calls included."""
    calls = V.as_call_log(_event_stream(spark, sf))
    hours = live.run_window_costs(calls, scratch_path(spark, "cost_windows"), "1 hour")
    return hours.select(
        F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("hour"), "book", "model", "calls", "cost"
    )


@query
def stream_win_tally(spark, sf):
    schema = V.table(spark, sf, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf)
    judged = VD.parse_text_verdicts(V.as_verdicts(orders))
    return live.run_updates(
        live.live_win_tally(judged), scratch_path(spark, "win_tally"), ["winner"]
    )
