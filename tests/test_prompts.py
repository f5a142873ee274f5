import hashlib
import json

import pandas as pd
from pyspark.sql import functions as F

from tallyforge import prompt_texts as T
from tallyforge.operators import prompts as P
from tallyforge.operators import reports as R
from tallyforge.operators.calls import call_models
from tallyforge.operators.candidates import score_candidates
from tallyforge.settings import DEFAULT_MODELS
from tallyforge.sources.prompts import read_prompts, single_prompt, write_prompt_batches
from tallyforge.sources.scratch import scratch_path

PAIRS = [(1, "Why <<prompt>>?", "b", 1, "{x}"), (1, "Why <<prompt>>?", "a", 0, "because")]
PAIR_SCHEMA = "prompt_id INT, prompt STRING, model STRING, model_pos INT, response STRING"

#: First digits of the SHA-256 of each text that must not change.
PINNED = {
    "CODE_JUDGE_ENTRY": "39202f78509cc96f",
    "CODE_JUDGE_HEAD": "fd75db592b17eeae",
    "CODE_JUDGE_SECTION": "5ae59163674f1a6d",
    "CODE_JUDGE_TAIL": "aed9294cd6a713ad",
    "CODE_JUDGE_TASK": "3f63ac616e8b8b24",
    "SYSTEM_TEXT": "f802fbceee7aca2f",
    "TEST_WRITER": "0e2e87bcd4134f20",
    "TEXT_JUDGE_ENTRY": "3f2ef97f2e8f8273",
    "TEXT_JUDGE_HEAD": "ecece53ea8a76cd3",
    "TEXT_JUDGE_SECTION": "fd9cebcafed3441d",
    "TEXT_JUDGE_TAIL": "be67d460d76d2ea5",
    "TEXT_JUDGE_TASK": "e4ec491d29143014",
}


def test_texts_are_the_pinned_ones():
    for name, digest in PINNED.items():
        text = getattr(T, name)
        text = text if isinstance(text, str) else repr(sorted(text.items()))
        assert hashlib.sha256(text.encode()).hexdigest().startswith(digest), name


def test_batch_file_positions(spark, tmp_path):
    texts = ["first", "second \"quoted\"", "", "línea\ntwo"]
    (tmp_path / "batch.json").write_text(json.dumps(texts, indent=4))
    got = read_prompts(spark, str(tmp_path / "batch.json")).orderBy("prompt_idx").collect()
    assert [(r.prompt_idx, r.prompt) for r in got] == list(enumerate(texts))
    assert tuple(single_prompt(spark, "p").first()) == (0, "p")


def test_written_batches_read_back_in_order(spark):
    rows = spark.createDataFrame([(i // 3, i, f"t{i}") for i in reversed(range(8))], "b INT, i INT, prompt STRING")
    path = scratch_path(spark, "batches")
    write_prompt_batches(rows, path, "b", "i")
    got = {(r.b, r.prompt_idx): r.prompt for r in read_prompts(spark, path).collect()}
    assert got == {(i // 3, i % 3): f"t{i}" for i in range(8)}


def test_fan_out_needs_no_join(spark):
    fanned = P.fan_out(spark.createDataFrame([(0, "p")], "prompt_idx INT, prompt STRING"), ["b", "a"])
    assert [(r.model_pos, r.model) for r in fanned.collect()] == [(0, "b"), (1, "a")]
    assert "Join" not in fanned._jdf.queryExecution().executedPlan().toString()
    message = P.request_rows(fanned, "code").first().messages
    assert [(m.role, m.content) for m in message] == [("system", T.SYSTEM_TEXT["code"]), ("user", "p")]


def test_text_judge_prompt(spark):
    row = P.text_judge_prompts(spark.createDataFrame(PAIRS, PAIR_SCHEMA)).first()
    text = row.judge_prompt
    assert text.startswith("You are an expert evaluator. Given the following prompt:\n\n            PROMPT:\n            Why <<prompt>>?\n")
    assert "            a:\nbecause\n\nb:\n{x}\n\n\n            Score each" in text
    assert text.index('"a": { ') < text.index('"b": { ') and '"winner": "a"' in text
    assert text == text.strip()
    fixed = P.text_judge_prompts(spark.createDataFrame(PAIRS, PAIR_SCHEMA), DEFAULT_MODELS).first().judge_prompt
    assert '"gpt-4": { \n                "correctness": 5, ' in fixed and '"winner": "gpt-4"' in fixed


def test_code_judge_prompt_prints_scores_as_the_rows_have_them(spark):
    rows = spark.createDataFrame([
        (1, "p", "m1", 0, "code1", True, 1, 8.5, 2.0, (8, 2)),
        (1, "p", "m2", 1, "code2", False, 3, 1.0, 0.0, None),
        (1, "p", "m3", 2, "code3", True, 3, 1.0, 0.0, None),
    ], PAIR_SCHEMA + ", syntax_ok BOOLEAN, security_issues INT, rating DOUBLE, avg_complexity DOUBLE,"
                     " tests STRUCT<passed: INT, failed: INT>")
    text = P.code_judge_prompts(score_candidates(rows)).first().judge_prompt
    assert ("m1:\nCODE:\ncode1\n\nEVALUATION RESULTS:\n- Status: evaluated\n- Final Score: 0.702\n"
            "- Tests: {'passed': 8, 'failed': 2}\n- Style Score: 0.708\n- Pylint Score: 8.5\n"
            "- Complexity: 2.0\n- Security Issues: 1\n") in text
    assert ("- Status: syntax_error\n- Final Score: 0\n- Tests: {}\n- Style Score: 0.1\n"
            "- Pylint Score: 1.0\n- Complexity: 0.0\n- Security Issues: 0\n") in text
    assert ("- Status: error\n- Final Score: 0\n- Tests: {}\n- Style Score: 0\n"
            "- Pylint Score: 0\n- Complexity: 0\n- Security Issues: 0\n") in text


def test_listing(spark):
    rows = spark.createDataFrame(PAIRS, PAIR_SCHEMA)
    got = R.response_listing(rows).orderBy("model_pos").first().listing
    assert got == "a:\nbecause\n" + "-" * 40


def test_plug_in_model_sees_batches_and_feeds_the_call_log(spark):
    requests = spark.range(100).select(F.col("id").alias("prompt_id"), F.lit("m").alias("model"))

    def answer(batch: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({
            "response": "r" + batch["prompt_id"].astype(str),
            "input_tokens": batch["prompt_id"] * 2, "output_tokens": batch["prompt_id"] % 3,
        })

    got = call_models(requests.repartition(4), answer).collect()
    assert len(got) == 100
    assert all((r.response, r.input_tokens) == (f"r{r.prompt_id}", r.prompt_id * 2) for r in got)
