import json

from pyspark.sql import functions as F

from tallyforge.operators import documents as D
from tallyforge.operators import reports as R
from tallyforge.operators import verdicts as VD
from tallyforge.operators import winners as W
from tallyforge.plans.evaluation import CodeEvaluator, TextEvaluator
from tallyforge.sources import documents as SD
from tallyforge.sources.responses import responses_from_map
from tallyforge.sources.scratch import materialize, scratch_path, scratch_root

CANDIDATE = (
    "prompt_id BIGINT, model STRING, model_pos INT, syntax_ok BOOLEAN, security_issues INT,"
    " bandit_output STRING, rating DOUBLE, avg_complexity DOUBLE, tests STRUCT<passed: INT, failed: INT>"
)


def candidates(spark):
    return spark.createDataFrame([
        (1, "z", 0, True, 1, "{}", 8.5, 2.0, (8, 2)),
        (1, "a", 1, False, 2, "{}", 3.0, 0.0, None),
        (1, "m", 2, True, 0, "{}", 9.0, 1.0, None),
        (2, "z", 0, False, 0, "{}", 1.0, 0.0, (1, 1)),
    ], CANDIDATE)


def prompts(spark):
    return spark.createDataFrame([(1, "p1"), (2, "p2"), (3, "p3")], "prompt_id BIGINT, prompt STRING")


def saved(tmp_path, marks=(5, 4, 5, 5)):
    """Saved documents of the older generation, a newer one and a failure."""
    for i, mark in enumerate(marks):
        doc = {
            "prompt": f"p{i}", "responses": {"gpt-4": "x", "gpt-3.5-turbo": "y"},
            "scores": {"gpt-4": {"correctness": 5, "relevance": 5},
                       "gpt-3.5-turbo": {"correctness": mark, "relevance": 5}, "winner": "gpt-4"},
            "winner": "gpt-4", "prompt_id": f"id{i}",
        }
        if i == 3:
            doc["cost_breakdown"] = {
                "model_calls": {"gpt-4": {"calls": 1, "cost": 0.0165}}, "judge_calls": {}, "total": 0.0165,
            }
        (tmp_path / f"eval_code_{i + 1}_2024-03-05T06-07-08.json").write_text(json.dumps(doc, indent=2))
    (tmp_path / "eval_code_9_x.json").write_text(json.dumps({"error": "e", "details": "d", "prompt_id": "id9"}, indent=2))


def test_saved_documents_of_both_generations(spark, tmp_path):
    saved(tmp_path)
    docs = SD.read_documents(spark, str(tmp_path))
    kinds = {r.prompt_id: (r.kind, r.winner) for r in docs.collect()}
    assert kinds["id0"] == ("text", "gpt-4") and kinds["id9"] == ("failed", None)
    tally = W.win_tally(docs).collect()
    assert [(t.winner, t.wins) for t in tally] == [("gpt-4", 4)]
    marks = VD.verdict_marks(docs.filter("kind = 'text'").withColumnRenamed("scores", "parsed"))
    means = {r.model: r.mean_correctness for r in VD.mark_stats(marks).collect()}
    assert means == {"gpt-4": 5.0, "gpt-3.5-turbo": 4.75}
    costs = docs.filter("cost_breakdown IS NOT NULL").select("cost_breakdown.total").collect()
    assert [float(r.total) for r in costs] == [0.0165]


def test_code_documents_keep_each_status_shape(spark):
    docs = CodeEvaluator().evaluate(prompts(spark), candidates(spark))
    text = SD.as_json(F.struct("prompt", "results", "winner"))
    got = {r.prompt_id: json.loads(r.doc) for r in docs.select("prompt_id", text.alias("doc")).collect()}
    results = got[1]["results"]
    assert list(results) == ["z", "a", "m"] and got[1]["winner"] == "z"
    assert set(results["z"]) == {"status", "score", "tests", "lint", "style"}
    assert set(results["a"]) == {"status", "score", "details", "style"}
    assert set(results["m"]) == {"status", "score", "error"}
    assert results["z"]["score"] == 0.702 and results["z"]["style"]["style_score"] == 0.708
    assert got[2]["winner"] == "z" and got[3] == {"prompt": "p3", "winner": "No valid code found"}


def test_code_report_leaves_unknown_models_without_metrics(spark):
    verdicts = spark.createDataFrame([(1, json.dumps({
        "z": {"weaknesses": "w", "code_quality": "good", "strengths": "", "other": "no"},
        "gpt-4": {"strengths": "s"}, "note": "text", "winner": "m", "winner_reasoning": "", "loser_reasoning": "l",
    })), (2, "no verdict")], "prompt_id BIGINT, judge_text STRING")
    docs = CodeEvaluator(verdicts=verdicts).evaluate(prompts(spark), candidates(spark))
    assert docs.filter("judge_analysis IS NOT NULL").count() == 2
    joined = VD.parse_code_verdicts(verdicts).join(docs.select("prompt_id", "results"), "prompt_id")
    lines = {1: [], 2: []}
    for r in R.code_report(joined).orderBy("prompt_id", "line_no").collect():
        lines[r.prompt_id].append(r.line)
    assert lines[1] == [
        "JUDGE'S DETAILED CODE ANALYSIS", "Z ANALYSIS:", "   Final Score: 0.702",
        "   Tests: 8 passed, 2 failed", "   Style Score: 0.708", "   Pylint: 8.5/10",
        "   Complexity: 2.0", "   Security Issues: 1", "   Weaknesses: w", "   Code Quality: good",
        "GPT-4 ANALYSIS:", "   Strengths: s", "NOTE ANALYSIS:", "RUNNER-UP (z):", "   l",
    ]
    assert lines[2] == ["JUDGE'S DETAILED CODE ANALYSIS"]


def test_text_documents_round_trip(spark):
    answers = spark.sql(
        "SELECT 1L prompt_id, 'p1' prompt, map('b', 'rb', 'a', 'ra') responses, 'r1' run_ts"
        " UNION ALL SELECT 2L, 'p2', map('b', 'rb'), 'r2'"
    )
    verdicts = spark.createDataFrame(
        [(1, '{"b": {"correctness": 4}, "winner": "b"}'), (2, "?")], "prompt_id BIGINT, judge_text STRING")
    docs = TextEvaluator(verdicts).evaluate(
        answers.select("prompt_id", "prompt", "run_ts"), responses_from_map(answers))
    path = scratch_path(spark, "docs")
    SD.write_documents(docs.withColumn("prompt_id", F.col("prompt_id").cast("string")), path)
    back = SD.read_documents(spark, path, multi_line=False).select(
        "*", F.map_keys("responses").alias("models"),
        F.try_variant_get("scores", "$.b.correctness", "int").alias("mark"))
    got = {r.prompt_id: r for r in back.collect()}
    assert (got["1"].kind, got["1"].winner, got["1"].models, got["1"].mark) == ("text", "b", ["b", "a"], 4)
    assert (got["2"].kind, got["2"].prompt, got["2"].error) == ("failed", None, "Failed to evaluate text")


def test_pretty_json_is_indented_by_two(spark):
    row = spark.sql("SELECT 'p' prompt, CAST(NULL AS STRING) winner, map('m', 1) n").select(
        SD.as_json(F.struct("prompt", "winner", "n")).alias("doc")).first()
    assert json.loads(row.doc) == {"prompt": "p", "n": {"m": 1}}
    assert '\n  "prompt"' in row.doc


def test_held_text_verdict_keeps_its_null_winner(spark):
    answers = spark.sql("SELECT 1L prompt_id, 'p1' prompt, map('a', 'ra') responses, 'r1' run_ts")
    verdicts = spark.createDataFrame([(1, '{"a": {"correctness": 4}, "winner": null}')],
                                     "prompt_id BIGINT, judge_text STRING")
    docs = TextEvaluator(verdicts).evaluate(answers.select("prompt_id", "prompt", "run_ts"), responses_from_map(answers))
    path = scratch_path(spark, "docs")
    SD.write_documents(docs, path)
    (line,) = [r.value for r in spark.read.text(path).collect()]
    assert json.loads(line) == {"prompt_id": 1, "prompt": "p1", "responses": {"a": "ra"},
                                "scores": {"a": {"correctness": 4}, "winner": None}, "winner": None}


def test_broken_files_keep_their_row(spark):
    path = scratch_path(spark, "broken")
    spark.createDataFrame([('{"prompt": "p", "error": "e"}',), ("not json {",)], "value STRING").write.text(path)
    got = SD.read_documents(spark, path, multi_line=False).select("kind", "details", "prompt").collect()
    assert sorted(map(tuple, got), key=str) == [("broken", "not json {", None), ("failed", None, "p")]


def test_prompts_without_a_verdict_and_repeated_answers(spark):
    prompts = spark.createDataFrame([(1, "p1"), (2, "p2")], "prompt_id BIGINT, prompt STRING")
    responses = spark.createDataFrame(
        [(1, "a", 0, "old", 1), (1, "a", 0, "new", 2), (1, "b", 1, "x", 1), (2, "a", 0, "y", 1)],
        "prompt_id BIGINT, model STRING, model_pos INT, response STRING, seq INT")
    verdicts = spark.createDataFrame([(1, '{"winner": "a"}', 1), (1, '{"winner": "b"}', 2)],
                                     "prompt_id BIGINT, judge_text STRING, seq INT")
    docs = TextEvaluator(verdicts, order=["seq"]).evaluate(prompts, responses)
    got = {r.prompt_id: r for r in docs.collect()}
    assert (got[1].responses, got[1].winner) == ({"a": "new", "b": "x"}, "b")
    assert (got[2].prompt, got[2].error, got[2].details) == (None, "Failed to evaluate text", "no verdict recorded")
    runs = spark.createDataFrame([
        (1, "z", 0, False, 0, "{}", 1.0, 0.0, (1, 1), 1), (1, "z", 0, True, 0, "{}", 8.5, 2.0, (8, 2), 2),
    ], CANDIDATE + ", seq INT")
    (doc,) = CodeEvaluator(order=["seq"]).evaluate(prompts.limit(1), runs).collect()
    assert list(doc.results) == ["z"] and doc.results["z"].status == "evaluated"


def test_only_truthy_categories_and_reasonings_are_printed(spark):
    verdict = {"z": {"strengths": ["a", "b"], "weaknesses": [], "code_quality": 0, "test_performance": False,
                     "security_analysis": {}, "style_assessment": 4.5},
               "winner": "z", "winner_reasoning": [], "loser_reasoning": 7}
    verdicts = spark.createDataFrame([(1, json.dumps(verdict))], "prompt_id BIGINT, judge_text STRING")
    results = CodeEvaluator().evaluate(prompts(spark), candidates(spark)).select("prompt_id", "results")
    lines = [r.line for r in R.code_report(VD.parse_code_verdicts(verdicts).join(results, "prompt_id"))
             .orderBy("line_no").collect()]
    assert lines[8:] == ["   Strengths: ['a', 'b']", "   Style Assessment: 4.5", "RUNNER-UP (a):", "   7"]


def test_scratch_follows_the_session_setting(spark):
    assert scratch_root(spark) == spark.conf.get("spark.checkpoint.dir")
    path = scratch_path(spark, "t")
    assert path.startswith(scratch_root(spark)) and path != scratch_path(spark, "t")
    assert materialize(spark.range(5), "five").count() == 5


def test_response_maps_keep_model_order(spark):
    rows = spark.createDataFrame([(1, "b", 1, "x"), (1, "a", 2, "y"), (1, "c", 0, "z")],
                                 "prompt_id INT, model STRING, model_pos INT, response STRING")
    keys = D.response_maps(rows).select(F.map_keys("responses").alias("k")).first().k
    assert keys == ["c", "b", "a"]
