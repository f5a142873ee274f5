"""Inputs of the operators, as row-local views of the given tables.

Keyed collapses (`last_per_key`) and equi-joins on fine keys stand where a window
over a coarse key would put a hot key's rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions import scoring as S
from tallyforge.operators.candidates import score_candidates
from tallyforge.operators.keyed import last_per_key
from tallyforge.settings import ScoreWeights


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def as_call_log(events: DataFrame) -> DataFrame:
    """Calls from events; batch or stream."""
    kind = F.col("event_type")
    model = (
        F.when(kind == "view", "gpt-4")
        .when(kind == "click", "gpt-4-turbo")
        .when(kind == "purchase", "gpt-3.5-turbo")
        .when(kind == "signup", "gpt-3.5-turbo-16k")
        .otherwise("unpriced-model")
    )
    return events.select(
        F.col("event_id").alias("call_seq"),
        F.col("user_id").alias("session_id"),
        F.col("ts").cast("timestamp").alias("ts"),
        model.alias("model"),
        F.when(F.col("event_id") % 3 == 0, "judge").otherwise("model").alias("call_type"),
        F.get_json_object("props", "$.k").cast("bigint").alias("input_tokens"),
        F.floor(F.col("value") * 10).cast("bigint").alias("output_tokens"),
        (kind == "signup").alias("is_reset"),
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_call_log(table(spark, sf_dir, "events"))


def logged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logged answer of a model to a prompt, repeats included."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("prompt_id"),
        F.col("l_linenumber").alias("model_pos"),
        "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
        "l_returnflag",
    )


# Columns that order repeated answers; together they decide every value used below.
ANSWER_ORDER = (
    "l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax",
    "l_returnflag",
)


def code_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One candidate per prompt and model; the last logged answer holds."""
    return _as_runs(
        last_per_key(logged_answers(spark, sf_dir), ["prompt_id", "model_pos"], ANSWER_ORDER)
    )


def logged_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every logged answer as a candidate, with the columns that order them."""
    return _as_runs(logged_answers(spark, sf_dir), ANSWER_ORDER)


def _as_runs(answers: DataFrame, kept: tuple[str, ...] = ()) -> DataFrame:
    part = F.col("l_partkey") % 8
    outcome = (
        F.when(part == 0, S.NO_OUTPUT)
        .when(part == 1, S.RUNTIME_ERROR)
        .when(part == 2, S.ASSERT_THEN_PASS)
        .when(part == 3, S.ASSERT_THEN_ERROR)
        .when(part == 4, S.ASSERT_ASSERT)
        .when(part == 5, S.TIMEOUT)
        .otherwise(S.PASS)
    )
    asserts = F.col("l_quantity").cast("int") % 12
    return answers.select(
        *kept, "prompt_id",
        _text("model-", F.col("model_pos")).alias("model"),
        "model_pos",
        (F.col("l_returnflag") != "A").alias("syntax_ok"),
        (F.col("l_suppkey") % 4).cast("int").alias("security_issues"),
        F.round(F.col("l_discount") * 100).cast("double").alias("rating"),
        F.round(F.col("l_tax") * 100).cast("double").alias("avg_complexity"),
        S.outcome_counts(outcome, asserts).alias("tests"),
        _text("Write function f", F.col("prompt_id")).alias("prompt"),
        _text(
            "def f", F.col("prompt_id"), "(x):\n    return x + ", F.col("l_partkey")
        ).alias("response"),
    )


def scored_runs(
    spark: SparkSession, sf_dir: str, weights: ScoreWeights = ScoreWeights()
) -> DataFrame:
    return score_candidates(code_runs(spark, sf_dir), weights)


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_verdicts(table(spark, sf_dir, "orders"))


def as_verdicts(orders: DataFrame) -> DataFrame:
    """Judge answers to text prompts, in eight shapes; batch or stream."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    body = _text(
        '"model-a": {"correctness": ', cust % 5 + 1, ', "relevance": ', key % 5 + 1,
        ', "reasoning": "r1"}, "model-b": {"correctness": ', cust % 4 + 1,
        ', "relevance": ', key % 4 + 1, ', "reasoning": "r2"}, "winner": "',
        F.when(cust % 3 == 0, "model-b").otherwise("model-a"),
        '", "winner_reasoning": "w", "loser_reasoning": "l"',
    )
    shape = key % 9
    text = (
        F.when(shape == 0, "I cannot judge these answers.")
        .when(shape == 1, _text("{", body, ", oops}"))
        .when(shape == 2, _text("{", body, '} and also {"x": 1}'))
        .when(shape == 3, _text("{", body, ', "notes": "close call"}'))
        .when(shape == 4, '{"model-a": {"correctness": 5, "relevance": 5, "reasoning": "fine"},'
                          ' "winner": null}')
        .when(shape == 5, '{"model-a": {"correctness": 2}, "model-b": {"relevance": 4},'
                          ' "winner": "model-z"}')
        .when(shape == 6, _text("Here is my verdict: {", body, "} Thanks."))
        .otherwise(_text("{", body, "}"))
    )
    return orders.select(
        key.alias("prompt_id"),
        text.alias("judge_text"),
        F.array(F.lit("model-a"), F.lit("model-b")).alias("models"),
    )


def written_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts with marks as floats, lists and objects, and a key that is written twice."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    text = _text(
        '{"winner": "model-a", "model-a": {"correctness": ', cust % 5 + 1, '.0, "relevance": ', key % 5 + 1,
        '.50, "reasoning": ["r', cust % 7, '", "it\'s", null, true, 1.50]}, "model-b": {"relevance": 1, '
        '"relevance": 2e', key % 20, ', "correctness": {"z": ', key % 3, '.0, "a": "x:y,\\"q\\""},'
        ' "reasoning": 0.0}, "loser_reasoning": {"why": false}, "winner_reasoning": []}',
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("prompt_id"), text.alias("judge_text"),
        F.array(F.lit("model-a"), F.lit("model-b")).alias("models"),
    )


def code_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge answers to code prompts: one broken, one chatty, one with an extra key."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    body = _text(
        '"model-', key % 7 + 1, '": {"test_performance": "t', cust % 5,
        '", "code_quality": "clear", "weaknesses": "", "mood": "good"}, ',
        '"gpt-4": {"strengths": "short"}, "winner": "model-', cust % 3 + 1,
        '", "winner_reasoning": "w", "loser_reasoning": "l"',
    )
    shape = key % 6
    text = (
        F.when(shape == 0, "No verdict today.")
        .when(shape == 1, _text("Sure: {", body, "}."))
        .when(shape == 2, _text("{", body, ', "notes": "x"}'))
        .otherwise(_text("{", body, "}"))
    )
    return table(spark, sf_dir, "orders").select(
        key.alias("prompt_id"), text.alias("judge_text")
    )


def text_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded answers of two models per prompt, as a map."""
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("prompt_id"),
        _text("Explain order ", key, " of priority ", F.col("o_orderpriority")).alias("prompt"),
        F.create_map(
            F.lit("model-a"), _text("It is order ", key, "."),
            F.lit("model-b"), _text("Customer ", cust, " has status ", F.col("o_orderstatus")),
        ).alias("responses"),
        F.col("o_orderdate").alias("run_at"),
    )


def answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assistant turns with the user turn before them.

    An equi-join on (conversation, turn): every row is shuffled once and one endless
    conversation still spreads over all tasks.
    """
    turns = table(spark, sf_dir, "conversations")
    asked = turns.filter("role = 'user'").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("prompt")
    )
    said = turns.filter("role = 'assistant'").select("conv_id", "turn", "text")
    shape = F.col("conv_id") % 4
    text = F.col("text")
    response = (
        F.when(shape == 0, _text("```python\n", text, "\n```"))
        .when(shape == 1, _text("Answer: ```", text, "``` done ```x```"))
        .when(shape == 2, _text("```py\n", text, "```"))
        .otherwise(_text("  ", text, "\n"))
    )
    return said.join(asked, ["conv_id", "turn"]).select(
        _text(F.col("conv_id"), "-", F.col("turn")).alias("prompt_id"),
        "prompt",
        _text("model-", F.col("conv_id") % 3).alias("model"),
        response.alias("response"),
    )


def answer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long rows of two answers per prompt, whole texts."""
    pairs = F.array(
        F.struct(F.lit(0).alias("model_pos"), F.col("model"), F.col("response")),
        F.struct(
            F.lit(1).alias("model_pos"), F.lit("echo").alias("model"),
            _text("You asked: ", F.col("prompt")).alias("response"),
        ),
    )
    return answers(spark, sf_dir).select("prompt_id", "prompt", F.inline(pairs))


def tool_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Generated tests, run output, linter output and scanner reports."""
    key, name, size = F.col("p_partkey"), F.col("p_name"), F.col("p_size")
    shape = key % 6
    text = (
        F.when(shape == 0, "def f(a):\n    return a\n")
        .when(shape == 1, "def oops(:")
        .when(shape == 2, "import os\ndef test_f():\n    assert f(1) == 1\n    assert f(2) == 2")
        .when(shape == 3, "```python\nfrom a import b\nimportant = 1\ndef test_g(x):\n"
                          "    assert g(x)\n```")
        .when(shape == 4, _text("Sure:\n```\n", name, "\n``` and ```z```"))
        .otherwise(_text("  ", name, " \n"))
    )
    run = key % 5
    stdout = (
        F.when(run == 0, "Running 4 test cases...\nPASSED: 4\nFAILED: 0")
        .when(run == 1, "PASSED: 9\nFAILED: 1")
        .when(run == 2, "Traceback")
        .when(run == 3, _text("PASSED: 1\nPASSED: ", size, "\nFAILED: 2"))
        .otherwise("FAILED: 3")
    )
    report = key % 4
    lint = (
        F.when(report == 0, "Your code has been rated at 8.50/10")
        .when(report == 1, "Your code has been rated at -2.50/10")
        .when(report == 2, "")
        .otherwise(_text("Your code has been rated at ", size % 10,
                         ".00/10 (previous run: 1.00/10)"))
    )
    scan = (
        F.when(report == 0, '{"results": []}')
        .when(report == 1, '{"results": [{"id": "B101"}, {"id": "B602"}]}')
        .when(report == 2, "")
        .otherwise("{bad")
    )
    return table(spark, sf_dir, "part").select(
        key.alias("snippet_id"), text.alias("text"), stdout.alias("stdout"),
        lint.alias("lint_stdout"), scan.alias("report_json"),
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complexity of each block of a snippet."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("snippet_id"),
        F.col("l_linenumber").alias("block"),
        (F.col("l_quantity").cast("int") % 12 + 1).alias("complexity"),
    )
