import random
from decimal import Decimal

from pyspark.sql import functions as F

from tallyforge.operators import winners as W
from tallyforge.operators.keyed import last_per_key

SCORED = "prompt_id INT, model STRING, model_pos INT, status STRING, score DECIMAL(6,3)"


def scored(spark, rows):
    return spark.createDataFrame([(*r[:4], Decimal(r[4])) for r in rows], SCORED)


def test_winner_is_the_first_maximum(spark):
    rng = random.Random(3)
    rows, expected, order = [], {}, {}
    for p in range(400):
        answers = []
        for pos in range(rng.randint(1, 5)):
            status = rng.choice(["evaluated", "error", "syntax_error"])
            score = rng.choice(["0.000", "0.500", "0.900"]) if status == "evaluated" else "0.000"
            answers.append((f"m{pos}", status, float(score)))
            rows.append((p, f"m{pos}", pos, status, score))
        best = max(answers, key=lambda a: a[2] if a[1] == "evaluated" else -1)
        expected[p] = best[0]
        order[p] = next((a[0] for a in answers if a[0] != best[0]), None)
    rng.shuffle(rows)
    table = scored(spark, rows)
    assert {r.prompt_id: r.winner for r in W.code_winner(table).collect()} == expected
    ranked = W.code_ranking(table).filter("place = 1").collect()
    assert {r.prompt_id: r.model for r in ranked} == expected
    ups = W.runner_up(table, W.code_winner(table)).collect()
    assert {r.prompt_id: r.runner_up for r in ups} == order


def test_zero_beats_error_and_all_failed_still_wins(spark):
    table = scored(spark, [
        (1, "a", 0, "error", "0"), (1, "b", 1, "evaluated", "0"),
        (2, "a", 0, "error", "0"), (2, "b", 1, "syntax_error", "0"),
        (3, "", 0, "evaluated", "1"),
    ])
    prompts = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "prompt_id INT")
    got = {r.prompt_id: r.winner for r in W.code_winner_of_prompts(prompts, table).collect()}
    assert got == {1: "b", 2: "a", 3: "No valid code found", 4: "No valid code found"}


def test_runner_up_of_a_winner_nobody_ran(spark):
    table = scored(spark, [(1, "a", 0, "error", "0"), (1, "b", 1, "error", "0"), (2, "a", 0, "error", "0")])
    winners = spark.createDataFrame([(1, None), (2, "a")], "prompt_id INT, winner STRING")
    got = {r.prompt_id: r.runner_up for r in W.runner_up(table, winners).collect()}
    assert got == {1: "a", 2: None}


def test_tally_skips_nameless_winners_and_keeps_first_win_order(spark):
    rows = [(0, "b"), (1, None), (2, ""), (3, "a"), (4, "b"), (5, "No valid code found")]
    tally = W.win_tally(spark.createDataFrame(rows, "prompt_id INT, winner STRING")).collect()
    assert [(t.winner, t.wins) for t in tally] == [("b", 2), ("a", 1), ("No valid code found", 1)]


def test_disagreement_is_null_safe(spark):
    score = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a")], "prompt_id INT, winner STRING")
    judge = spark.createDataFrame([(1, "a"), (2, None), (3, "b")], "prompt_id INT, winner STRING")
    got = {r.prompt_id for r in W.winner_disagreement(score, judge).collect()}
    assert got == {2, 3}


def test_last_answer_wins_with_and_without_orderable_payload(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1, "old"), (1, "a", 2, "new"), (1, "b", 1, "only"), (None, "a", 1, "x")],
        "prompt_id INT, model STRING, seq INT, response STRING",
    )
    for table in (rows, rows.withColumn("m", F.create_map(F.lit("k"), "seq"))):
        got = {(r.prompt_id, r.model): r.response
               for r in last_per_key(table, ["prompt_id", "model"], ["seq"]).collect()}
        assert got == {(1, "a"): "new", (1, "b"): "only", (None, "a"): "x"}


def test_first_two_models_are_cut_before_the_shuffle(spark):
    table = scored(spark, [(1, "a", 0, "error", "0")])
    plan = W.first_two_models(table)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
