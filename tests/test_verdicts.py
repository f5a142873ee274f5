"""Verdict parsing against a restatement in Python."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions.json import allow_duplicate_keys, security_issue_count
from tallyforge.functions.python_text import python_text, raw_field, raw_fields
from tallyforge.operators import reports as R
from tallyforge.operators import verdicts as VD
from tallyforge.operators.winners import winner_disagreement

RESERVED = {"winner", "winner_reasoning", "loser_reasoning"}


def py_parse(text):
    found = re.search(r"{.*}", text, re.DOTALL)
    return json.loads(found.group(0))


def py_text_status(text):
    try:
        parsed = py_parse(text)
        for key, value in parsed.items():
            if key not in RESERVED:
                value.get("correctness")
        return "evaluated", parsed.get("winner")
    except Exception:
        return "error", None


HAND = [
    "no json", "{", "}{", "{}", 'x {"winner": "a"} y', '{"a": 1} {"b": 2}', '{"a": {}}, {"b": {}}',
    '{"a": {}}] and [{"b": {}}', '{"a": {}},"x"] {}', '{"winner": "a", "winner": "b"}', "{'winner': 'a'}",
    '{"winner": "a",}', '{"m": {"correctness": 1}, "notes": "x"}', '{"m": [1], "winner": "q"}',
    '{"m": null}', '{"winner": null, "m": {}}', '{"winner": "\\u00e9\\n"}', '{"winner": "a\nb"}',
    '{"winner": 01}', '{"m": {"winner": "inner"}}', '```json\n{"winner": "a"}\n```', '{"winner": ""}',
    '{"m": {"correctness": NaN, "relevance": -Infinity}, "winner": "NaN \\" Infinity"}', '{"m": {"x": -NaN}}',
    '{"n": NaN}', '{"m": {"correctness": "}"}, "winner": "w"}', "", '{"winner": "a"} // }',
]


def cases():
    rng = random.Random(11)
    parts = ['{', '}', '"winner": "a"', '"m": {"correctness": 4}', ',', ' ', '"n": 1', '[', ']',
             'text', '"winner": null', '\n', 'NaN', '"k": Infinity', '"']
    made = ["".join(rng.choices(parts, k=rng.randint(1, 9))) for _ in range(4000)]
    return HAND + made


def judged(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "prompt_id INT, judge_text STRING")
    return VD.parse_text_verdicts(rows)


def test_text_verdicts_match_python(spark):
    texts = cases()
    got = judged(spark, texts).select("prompt_id", "status", "winner").orderBy("prompt_id").collect()
    for text, row in zip(texts, got):
        assert (row.status, row.winner) == py_text_status(text), repr(text)


def test_failures_say_why(spark):
    got = {r.judge_text: r.details for r in judged(spark, HAND).collect()}
    assert got["no json"] == "No valid JSON in judge output"
    assert got['{"a": 1} {"b": 2}'] == "Invalid JSON in judge output"
    assert got['{"m": null}'] is not None and got["{}"] is None


def test_code_verdicts_tolerate_extras_and_broken_json(spark):
    texts = cases()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "prompt_id INT, judge_text STRING")
    got = VD.parse_code_verdicts(rows).select(
        "prompt_id", "winner", F.col("parsed").isNull().alias("lost")
    ).orderBy("prompt_id").collect()
    for text, row in zip(texts, got):
        try:
            winner = py_parse(text).get("winner")
        except (ValueError, AttributeError):
            winner = None
        assert row.winner == winner and not row.lost, repr(text)


def test_marks_and_their_means(spark):
    docs = [
        '{"gpt-4": {"correctness": 5, "relevance": 5}, "gpt-3.5-turbo": {"correctness": %d, "relevance": 5},'
        ' "winner": "gpt-4"}' % c for c in (5, 4, 5, 5)
    ]
    odd = ['{"gpt-4": {"correctness": "5", "relevance": 4.5, "reasoning": "r"}}', '{"z": {}}']
    marks = VD.verdict_marks(judged(spark, docs + odd)).collect()
    last = {(m.prompt_id, m.model): m for m in marks}
    assert (last[4, "gpt-4"].correctness, last[4, "gpt-4"].relevance) == (5.0, 4.5)
    assert (last[5, "z"].correctness, last[5, "z"].reasoning) == (None, "")
    stats = {r.model: r for r in VD.mark_stats(VD.verdict_marks(judged(spark, docs))).collect()}
    assert (stats["gpt-4"].mean_correctness, stats["gpt-3.5-turbo"].mean_correctness) == (5.0, 4.75)


def test_text_report_lines(spark):
    text = ('{"b": {"correctness": 4.5, "relevance": null, "reasoning": ""}, "a": {"correctness": true},'
            ' "winner": "b", "winner_reasoning": "clear", "loser_reasoning": "thin"}')
    rows = judged(spark, [text, "nothing"]).withColumn("models", F.array(F.lit("b"), F.lit("a")))
    lines = [r.line for r in R.text_report(rows).orderBy("line_no").collect()]
    assert lines == [
        "JUDGE'S DETAILED ANALYSIS",
        "B ANALYSIS:", "   Correctness: 4.5/5", "   Relevance: None/5",
        "A ANALYSIS:", "   Correctness: True/5", "   Relevance: N/A/5",
        "WINNER (b):", "   clear", "RUNNER-UP (a):", "   thin",
    ]


def test_report_of_marks_that_are_no_numbers(spark):
    rows = judged(spark, ['{"b": {"correctness": NaN}, "a": {}}']).withColumn("models", F.array(F.lit("b")))
    lines = [r.line for r in R.text_report(rows).orderBy("line_no").collect()]
    assert lines[1:3] == ["B ANALYSIS:", "   Correctness: None/5"] and lines[4] == "A ANALYSIS:"


def test_security_issue_count(spark):
    allow_duplicate_keys(spark)
    cases = {
        '{"results": []}': 0, '{"results": [{}, {}]}': 2, "": 0, "{bad": 0, "{}": 0, "[1, 2]": 0,
        '{"results": [1]} tail': 0, '{"results": [1], "results": [1, 2, 3]}': 3,
    }
    rows = spark.createDataFrame([(k,) for k in cases], "r STRING")
    got = {r.r: r.n for r in rows.select("r", security_issue_count(F.col("r")).alias("n")).collect()}
    assert got == cases


@pytest.mark.parametrize("value", [
    5, 5.0, 4.5, -0.0, 1e2, 1e7, 123456789.25, 1e15, 1e16, 1.5e300, 1e-4, 1.5e-5, 2.5e-300, 0.001, 12345678901234567890,
    True, False, None, "", "it's", "[1,2]", "true", [1, 2.0, None, True], [], {}, {"z": 1.0, "a": [1, {"b": "x, y: z"}]},
    ["it's", 'say "x"', "both ' and \"", "back\\slash", "line\nbreak\ttab", "é𝄞", "a:b,c"], "1e5", "null",
])
def test_values_print_as_python_prints_them(spark, value):
    text = json.dumps({"v": 0, "w": 1})[:-1] + f', "v": {json.dumps(value, ensure_ascii=False)}}}'
    parsed = F.try_parse_json("t")
    allow_duplicate_keys(spark)
    row = spark.createDataFrame([(text,)], "t string").select(
        python_text(
            F.try_variant_get(parsed, "$.v", "variant"), raw_field(raw_fields(F.col("t")), "v")
        ).alias("p")
    ).first()
    assert row["p"] == str(json.loads(text)["v"])


@pytest.mark.parametrize("parse", [VD.parse_code_verdicts, VD.parse_text_verdicts])
def test_a_join_never_broadcasts_verdicts_by_a_wrong_estimate(spark, parse, capsys):
    """The estimate of a table that drops its VARIANT says nothing about its rows."""
    models = F.array(F.lit("a"))
    answers = spark.range(40).select(
        F.col("id").alias("prompt_id"), F.lit('{"winner": "a"}').alias("judge_text"), models.alias("models")
    )
    winners = spark.range(40).select(F.col("id").alias("prompt_id"), F.lit("b").alias("winner"))
    pairs = winner_disagreement(winners, parse(answers))
    capsys.readouterr()
    pairs.explain()
    assert "Broadcast" not in capsys.readouterr().out
    assert pairs.count() == 40
