import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from tallyforge.functions import scoring as S
from tallyforge.operators.candidates import only_where_valid, score_candidates
from tallyforge.settings import ScoreWeights
from workload.views import scored_runs

CANDIDATE = (
    "prompt_id BIGINT, model STRING, model_pos INT, syntax_ok BOOLEAN, security_issues INT,"
    " rating DOUBLE, avg_complexity DOUBLE, tests STRUCT<passed: INT, failed: INT>"
)


def test_round_binary_is_pythons_round(spark):
    rng = random.Random(5)
    values = [
        0.7 * max(p / t - i * 0.1, 0) + 0.3 * (s / 1000)
        for p, t, i, s in itertools.product(range(11), (1, 3, 7, 10, 12), range(3), range(0, 1001, 13))
    ]
    values += [k / 1000 + 0.0005 for k in range(2000)] + [k / 16 for k in range(200)]
    values += [0.0, 0.005, 0.015, 0.0015, 0.0004999999999999999, 0.0009999999999999999]
    values += [rng.random() * 10 ** rng.randint(-3, 3) for _ in range(5000)]
    rows = spark.createDataFrame([(v,) for v in values], "x DOUBLE")
    for digits in (2, 3):
        got = rows.select("x", S.round_binary(F.col("x"), digits).alias("r")).collect()
        assert [r.r for r in got] == [round(r.x, digits) for r in got]


@pytest.mark.parametrize("outcome, expected", [
    (S.PASS, (4, 0)), (S.ASSERT_THEN_PASS, (10, 0)), (S.ASSERT_ASSERT, (9, 1)),
    (S.ASSERT_THEN_ERROR, (0, 10)), (S.RUNTIME_ERROR, (0, 4)), (S.NO_OUTPUT, (0, 0)),
    (S.TIMEOUT, None),
])
def test_outcome_counts(spark, outcome, expected):
    counts = S.outcome_counts(F.lit(outcome), F.lit(4))
    row = spark.range(1).select(counts.alias("c")).first().c
    assert (tuple(row) if row else None) == expected


def test_scores_match_the_formula(spark):
    rng = random.Random(9)
    rows = []
    for i in range(3000):
        ok, issues = rng.random() < 0.8, rng.randint(0, 12)
        rating, cc = round(rng.random() * 10, 2), rng.randint(0, 60) / rng.randint(1, 7)
        tests = None if rng.random() < 0.1 else (rng.randint(0, 10), rng.randint(0, 5))
        rows.append((i, "m", 0, ok, issues, rating, cc, tests))
    scored = score_candidates(spark.createDataFrame(rows, CANDIDATE)).orderBy("prompt_id").collect()
    for (_, _, _, ok, issues, rating, cc, tests), got in zip(rows, scored):
        style = round((rating / 10) * (1 / (1 + cc / 10)), 3)
        if not ok:
            expected = ("syntax_error", 0.0)
        elif tests is None:
            expected = ("error", 0.0)
        else:
            total = sum(tests)
            rate = tests[0] / total if total else 0
            expected = ("evaluated", round(0.7 * max(rate - issues * 0.1, 0) + 0.3 * style, 3))
        assert (got.status, float(got.score)) == expected
        assert got.style.style_score == style
        assert (got.style.pylint_score, got.style.average_complexity) == (round(rating, 2), round(cc, 2))
        assert (got.tests is not None) == (got.status == "evaluated")
        assert (got.error is not None) == (got.status == "error")


def test_absent_reports_found_nothing(spark):
    rows = [(1, "m", 0, True, None, 8.5, 2.0, (8, 2)), (2, "m", 0, True, 1, None, None, (8, 2)),
            (3, "m", 0, None, 0, 8.5, 2.0, (8, 2)), (4, "m", 0, True, 0, 0.0, 0.0, (2**33, 0))]
    got = {r.prompt_id: r for r in score_candidates(spark.createDataFrame(rows, CANDIDATE.replace("INT>", "BIGINT>")
                                                    .replace("passed: INT", "passed: BIGINT"))).collect()}
    assert float(got[1].score) == round(0.7 * 0.8 + 0.3 * 0.708, 3) and got[1].lint.security_issues == 0
    assert float(got[2].score) == round(0.7 * 0.7, 3)
    assert (got[3].status, float(got[3].score), got[3].error) == ("error", 0.0, "syntax was not checked")
    assert float(got[4].score) == 0.7 and got[4].tests.passed == 2**33


def test_penalty_hits_only_the_functional_part(spark):
    weights = ScoreWeights(functionality=0.5, style=0.5, penalty_per_issue=1.0)
    row = spark.range(1).select(
        S.final_score(F.lit(1.0), F.lit(3), F.lit(0.8), weights).alias("s"),
        S.pass_rate(F.lit(0), F.lit(0)).alias("r"),
    ).first()
    assert (float(row.s), row.r) == (0.4, 0.0)


def test_costly_step_sees_valid_rows_only(spark):
    rows = spark.createDataFrame([(1, True), (2, False), (3, None)], "id INT, syntax_ok BOOLEAN")

    def costly(valid):
        return valid.withColumn("out", F.when(F.col("syntax_ok"), F.lit("done"))
                                .otherwise(F.raise_error(F.lit("ran on a bad row")).cast("string")))

    got = {r.id: r.out for r in only_where_valid(rows, costly).collect()}
    assert got == {1: "done", 2: None, 3: None}


@pytest.mark.parametrize("digits", [2, 3])
def test_rounds_as_python_near_and_far_from_the_middle(spark, digits):
    rng = random.Random(digits)
    values = [k / 2000 for k in range(0, 9000, 7)] + [rng.random() * 10 ** rng.randrange(-4, 9) for _ in range(1000)]
    values += [(2 * k + 1) / (2 * 10**digits) for k in range(500)] + [999999.995, 1e6, 1000000.125, 2.0**40 + 0.5]
    values += [math.nextafter(v, d) for v in (2.675, 1.005, 0.0625, 0.125, 0.005, 0.0005) for d in (0, 9)]
    rows = spark.createDataFrame([(v,) for v in values], "x double")
    found = [tuple(r) for r in rows.select("x", S.round_binary(F.col("x"), digits)).collect()]
    assert found == [(v, round(v, digits)) for v in values]
    odd = spark.createDataFrame([(None,), (-1.0,), (float("nan"),)], "x double")
    null, below, nan = [r[0] for r in odd.select(S.round_binary(F.col("x"), digits)).collect()]
    assert null == below == 0.0 and math.isnan(nan)


def test_scores_make_no_method_too_large_to_compile(spark, tmp_path, capsys):
    spark.range(9).select(
        F.col("id").alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.current_date().alias("l_shipdate"),
        F.col("id").alias("l_partkey"), F.col("id").alias("l_suppkey"), F.rand(1).alias("l_quantity"),
        F.rand(2).alias("l_discount"), F.rand(3).alias("l_tax"), F.lit("N").alias("l_returnflag"),
    ).write.parquet(str(tmp_path / "lineitem.parquet"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # it shows no code before it runs
    try:
        capsys.readouterr()
        scored_runs(spark, str(tmp_path)).explain("codegen")
        sizes = [int(n) for n in re.findall(r"maxMethodCodeSize:(\d+)", capsys.readouterr().out)]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    # The JVM compiles none of more than 8,000 bytes.
    assert sizes and max(sizes) <= 8000
