"""Declared schemas; nothing is inferred at read time."""

PROMPTS = "prompt_idx INT, prompt STRING"
RESPONSES = "prompt_id BIGINT, model STRING, model_pos INT, response STRING"
PRICES = "model STRING, input_per_1k DECIMAL(10,6), output_per_1k DECIMAL(10,6)"
CALL_LOG = (
    "session_id BIGINT, call_seq BIGINT, ts TIMESTAMP, model STRING, call_type STRING,"
    " input_tokens BIGINT, output_tokens BIGINT"
)

COST = "DECIMAL(18,9)"
TOTAL_COST = "DECIMAL(28,9)"
SCORE = "DECIMAL(6,3)"

_CALLS = f"MAP<STRING, STRUCT<calls: BIGINT, cost: {TOTAL_COST}>>"
COST_BREAKDOWN = (
    f"STRUCT<model_calls: {_CALLS}, judge_calls: {_CALLS}, total: {TOTAL_COST}>"
)
LINT = "STRUCT<syntax_ok: BOOLEAN, security_issues: INT, bandit_output: STRING>"
STYLE = "STRUCT<pylint_score: DOUBLE, average_complexity: DOUBLE, style_score: DOUBLE>"
TESTS = "STRUCT<passed: BIGINT, failed: BIGINT>"
CODE_RESULT = (
    f"STRUCT<status: STRING, score: {SCORE}, tests: {TESTS}, lint: {LINT},"
    f" details: {LINT}, style: {STYLE}, error: STRING>"
)

# One schema for every generation of saved document: what a document lacks reads
# as NULL.  `scores` and `judge_analysis` mix objects with strings, hence VARIANT.
EVALUATION_DOC = (
    "prompt STRING, responses MAP<STRING, STRING>, scores VARIANT,"
    f" results MAP<STRING, {CODE_RESULT}>, winner STRING, judge_analysis VARIANT,"
    f" cost_breakdown {COST_BREAKDOWN}, error STRING, details STRING, prompt_id STRING"
)
