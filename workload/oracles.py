"""The same results in plain SQL, for comparison on small data.

The SQL is written from the rules, not from the Spark code: windows where Spark
aggregates, integer arithmetic where Spark formats numbers.
"""

from __future__ import annotations

import re

from tallyforge import prompt_texts as P

VIEWS = {
    "call_log": """
select event_id as call_seq, user_id as session_id, ts,
  case event_type when 'view' then 'gpt-4' when 'click' then 'gpt-4-turbo'
    when 'purchase' then 'gpt-3.5-turbo' when 'signup' then 'gpt-3.5-turbo-16k'
    else 'unpriced-model' end as model,
  case when event_id % 3 = 0 then 'judge' else 'model' end as call_type,
  cast(json_extract_string(props, '$.k') as bigint) as input_tokens,
  cast(floor(value * 10) as bigint) as output_tokens,
  event_type = 'signup' as is_reset
from events""",
    "priced": """
select c.*, case when call_type = 'judge' then 'judge_calls' else 'model_calls' end as book,
  cast((input_tokens * coalesce(pin, 0.0015) + output_tokens * coalesce(pout, 0.002)) / 1000
    as decimal(18,9)) as cost
from (select *, cast(input_tokens as decimal(12,0)) as input_tokens_d from call_log) c
left join (values ('gpt-4', 0.0300, 0.060), ('gpt-4-turbo', 0.0100, 0.030),
  ('gpt-3.5-turbo', 0.0015, 0.002), ('gpt-3.5-turbo-16k', 0.0030, 0.004)) p(m, pin, pout)
  on c.model = p.m""",
    "rollup": """
select session_id, book, model, count(*) as calls, cast(sum(cost) as decimal(28,9)) as cost,
  min(call_seq) as first_seq
from priced group by session_id, book, model""",
    "running": """
select *, cast(sum(cost) over (partition by session_id order by call_seq
  rows unbounded preceding) as decimal(28,9)) as running_cost from priced""",
    "snapshots": """
select session_id, call_seq // 100 as prompt_no, cast(sum(cost) as decimal(28,9)) as cost_own,
  max_by(running_cost, call_seq) as cost_running
from running group by session_id, call_seq // 100""",
    "logged": """
select l_orderkey as prompt_id, l_linenumber as model_pos, l_shipdate, l_partkey, l_suppkey,
  l_quantity, l_discount, l_tax, l_returnflag,
  row_number() over (partition by l_orderkey, l_linenumber order by l_shipdate desc,
    l_partkey desc, l_suppkey desc, l_quantity desc, l_discount desc, l_tax desc,
    l_returnflag desc) as age
from lineitem""",
    "runs": """
select prompt_id, concat('model-', model_pos) as model, model_pos,
  l_returnflag <> 'A' as syntax_ok, cast(l_suppkey % 4 as integer) as issues,
  round(l_discount * 100)::double as rating, round(l_tax * 100)::double as cc,
  cast(l_quantity as int) % 12 as asserts,
  case l_partkey % 8 when 0 then 'no_output' when 1 then 'runtime_error'
    when 2 then 'assert_then_pass' when 3 then 'assert_then_error'
    when 4 then 'assert_assert' when 5 then 'timeout' else 'pass' end as outcome,
  concat('Write function f', prompt_id) as prompt,
  concat('def f', prompt_id, '(x):', chr(10), '    return x + ', l_partkey) as response
from logged where age = 1""",
    # Tie-exact rounding on 128-bit integers: x is a multiple of 2**-70 here.
    "styled": """
select *, (rating / 10) * (1::double / (1::double + cc / 10)) as raw_style,
  case outcome when 'pass' then asserts when 'assert_then_pass' then 10
    when 'assert_assert' then 9 when 'timeout' then null else 0 end as passed_n,
  case outcome when 'assert_assert' then 1 when 'assert_then_error' then 10
    when 'runtime_error' then asserts when 'timeout' then null else 0 end as failed_n
from runs""",
    "styled_rounded": """
select *, {round_style} as style_score,
  case when not syntax_ok then 'syntax_error' when passed_n is null then 'error'
    else 'evaluated' end as status
from {styled}""",
    "reported": """
select t.snippet_id as prompt_id, 'model-0' as model, 0 as model_pos,
  t.snippet_id % 6 in (0, 2, 3) as syntax_ok,
  case when t.snippet_id % 4 = 1 then 2 else 0 end as issues, rating, avg_complexity as cc,
  (rating / 10) * (1::double / (1::double + avg_complexity / 10)) as raw_style,
  case t.snippet_id % 5 when 0 then 4 when 1 then 9 when 3 then p_size else 0 end as passed_n,
  case t.snippet_id % 5 when 0 then 0 when 1 then 1 when 3 then 2 else 0 end as failed_n
from tool_outputs t join ratings r on t.snippet_id = r.snippet_id
join complexities c on t.snippet_id = c.snippet_id""",
    "sparse_reported": """
select t.snippet_id as prompt_id, 'model-0' as model, 0 as model_pos, true as syntax_ok,
  case when lint_stdout <> '' and t.snippet_id % 4 = 1 then 2 else 0 end as issues,
  rating, 0 as cc, rating / 10 as raw_style,
  case t.snippet_id % 5 when 0 then null when 1 then 9 when 3 then p_size else 0 end as passed_n,
  case t.snippet_id % 5 when 0 then null when 1 then 1 when 3 then 2 else 0 end as failed_n
from tool_outputs t join ratings r on t.snippet_id = r.snippet_id""",
    "mixed": """
select *, {weight_f}::double * greatest(
    (case when passed_n + failed_n > 0 then passed_n::double / (passed_n + failed_n) else 0 end)
      - issues * {penalty}::double, 0::double) + {weight_s}::double * style_score as raw_score
from styled_rounded""",
    "scored": """
select *, case when status = 'evaluated' then passed_n end as passed,
  case when status = 'evaluated' then failed_n end as failed,
  cast(case when status = 'evaluated' then {round_score} else 0 end as decimal(6,3)) as score
from mixed""",
    "ranked": """
select prompt_id, model, model_pos, score, cast(row_number() over (partition by prompt_id order by
  case when status = 'evaluated' then score else -1 end desc, model_pos) as integer) as place
from scored""",
    "code_won": "select prompt_id, model as winner from ranked where place = 1",
    "verdicts": """
select prompt_id, case prompt_id % 9
  when 0 then 'I cannot judge these answers.'
  when 1 then concat('{', body, ', oops}')
  when 2 then concat('{', body, '} and also {"x": 1}')
  when 3 then concat('{', body, ', "notes": "close call"}')
  when 4 then '{"model-a": {"correctness": 5, "relevance": 5, "reasoning": "fine"}, "winner": null}'
  when 5 then '{"model-a": {"correctness": 2}, "model-b": {"relevance": 4}, "winner": "model-z"}'
  when 6 then concat('Here is my verdict: {', body, '} Thanks.')
  else concat('{', body, '}') end as judge_text
from (select o_orderkey as prompt_id, concat('"model-a": {"correctness": ', o_custkey % 5 + 1,
    ', "relevance": ', o_orderkey % 5 + 1, ', "reasoning": "r1"}, "model-b": {"correctness": ',
    o_custkey % 4 + 1, ', "relevance": ', o_orderkey % 4 + 1,
    ', "reasoning": "r2"}, "winner": "', case when o_custkey % 3 = 0 then 'model-b' else 'model-a' end,
    '", "winner_reasoning": "w", "loser_reasoning": "l"') as body from orders) t""",
    "spans": r"""
select prompt_id, judge_text, regexp_extract(judge_text, '(?s)\{.*\}') as js from verdicts""",
    "judged": """
select prompt_id, js, ok,
  case when ok then 'evaluated' else 'error' end as status,
  case when not ok then 'Failed to evaluate text' end as error,
  case when ok then json_extract_string(js, '$.winner') end as winner,
  case when ok then json_extract_string(js, '$.winner_reasoning') end as winner_reasoning,
  case when ok then json_extract_string(js, '$.loser_reasoning') end as loser_reasoning
from (select *, js <> '' and json_valid(js) and len(list_filter(
    json_keys(case when json_valid(js) then js else '{}' end),
    lambda k: k not in ('winner', 'winner_reasoning', 'loser_reasoning')
      and json_type(js, concat('$."', k, '"')) <> 'OBJECT')) = 0 as ok from spans) t""",
    "marks": """
select prompt_id, m.model,
  cast(json_extract_string(js, concat('$."', m.model, '".correctness')) as double) as correctness,
  cast(json_extract_string(js, concat('$."', m.model, '".relevance')) as double) as relevance,
  coalesce(json_extract_string(js, concat('$."', m.model, '".reasoning')), '') as reasoning
from judged, (values ('model-a'), ('model-b')) m(model)
where ok and json_exists(js, concat('$."', m.model, '"'))""",
    "code_verdicts": """
select prompt_id, case prompt_id % 6
  when 0 then 'No verdict today.'
  when 1 then concat('Sure: {', body, '}.')
  when 2 then concat('{', body, ', "notes": "x"}')
  else concat('{', body, '}') end as judge_text,
  case when prompt_id % 6 <> 0 then concat('model-', o_custkey % 3 + 1) end as winner,
  case when prompt_id % 6 <> 0 then concat('model-', prompt_id % 7 + 1) end as first_model,
  concat('t', o_custkey % 5) as told
from (select o_orderkey as prompt_id, o_custkey, concat('"model-', o_orderkey % 7 + 1,
    '": {"test_performance": "t', o_custkey % 5,
    '", "code_quality": "clear", "weaknesses": "", "mood": "good"}, ',
    '"gpt-4": {"strengths": "short"}, "winner": "model-', o_custkey % 3 + 1,
    '", "winner_reasoning": "w", "loser_reasoning": "l"') as body from orders) t""",
    "text_answers": """
select o_orderkey as prompt_id,
  concat('Explain order ', o_orderkey, ' of priority ', o_orderpriority) as prompt,
  concat('It is order ', o_orderkey, '.') as response_a,
  concat('Customer ', o_custkey, ' has status ', o_orderstatus) as response_b,
  o_orderdate as run_at
from orders""",
    "answers": """
select concat(conv_id, '-', turn) as prompt_id, conv_id, prompt,
  concat('model-', conv_id % 3) as model, text as said,
  case conv_id % 4 when 0 then concat('```python', chr(10), text, chr(10), '```')
    when 1 then concat('Answer: ```', text, '``` done ```x```')
    when 2 then concat('```py', chr(10), text, '```')
    else concat('  ', text, chr(10)) end as response
from (select *, lag(text) over (partition by conv_id order by turn) as prompt,
        lag(role) over (partition by conv_id order by turn) as prev_role from conversations) t
where role = 'assistant' and prev_role = 'user'""",
    "extracted": r"""
select *, regexp_replace(case when regexp_matches(response, '(?s)```(?:python)?(.*?)```')
    then regexp_extract(response, '(?s)```(?:python)?(.*?)```', 1) else response end,
  '^\s+|\s+$', '', 'g') as code
from answers""",
    "tool_outputs": """
select p_partkey as snippet_id, p_size, p_name, case p_partkey % 6
  when 0 then concat('def f(a):', chr(10), '    return a', chr(10))
  when 1 then 'def oops(:'
  when 2 then concat('import os', chr(10), 'def test_f():', chr(10), '    assert f(1) == 1', chr(10), '    assert f(2) == 2')
  when 3 then concat('```python', chr(10), 'from a import b', chr(10), 'important = 1', chr(10), 'def test_g(x):', chr(10), '    assert g(x)', chr(10), '```')
  when 4 then concat('Sure:', chr(10), '```', chr(10), p_name, chr(10), '``` and ```z```')
  else concat('  ', p_name, ' ', chr(10)) end as text,
  case p_partkey % 5 when 0 then concat('Running 4 test cases...', chr(10), 'PASSED: 4', chr(10), 'FAILED: 0')
    when 1 then concat('PASSED: 9', chr(10), 'FAILED: 1') when 2 then 'Traceback'
    when 3 then concat('PASSED: 1', chr(10), 'PASSED: ', p_size, chr(10), 'FAILED: 2')
    else 'FAILED: 3' end as stdout,
  case p_partkey % 4 when 0 then 'Your code has been rated at 8.50/10'
    when 1 then 'Your code has been rated at -2.50/10' when 2 then ''
    else concat('Your code has been rated at ', p_size % 10, '.00/10 (previous run: 1.00/10)') end as lint_stdout,
  case p_partkey % 4 when 0 then '{"results": []}' when 1 then '{"results": [{"id": "B101"}, {"id": "B602"}]}'
    when 2 then '' else '{bad' end as report_json
from part""",
    "test_code": r"""
select snippet_id, text, regexp_replace(case when regexp_matches(text, '(?s)```(?:python)?(.*?)```')
    then regexp_extract(text, '(?s)```(?:python)?(.*?)```', 1) else text end,
  '^\s+|\s+$', '', 'g') as code
from tool_outputs""",
    "blocks": """
select l_partkey as snippet_id, l_linenumber as block, cast(l_quantity as int) % 12 + 1 as complexity
from lineitem""",
    "ratings": r"""
select snippet_id, coalesce(try_cast(nullif(regexp_extract(lint_stdout,
  'rated at ([0-9\.]+)/10', 1), '') as double), 0) as rating
from tool_outputs""",
    "complexities": """
select t.snippet_id, coalesce(avg(complexity), 0)::double as avg_complexity
from tool_outputs t left join blocks b on t.snippet_id = b.snippet_id group by t.snippet_id""",
}


def _round(x: str, digits: int) -> str:
    """Half-even rounding by the exact binary value, on 128-bit integers."""
    scaled = f"(cast({x} * 1180591620717411303424::double as hugeint) * {2 * 10**digits}" \
             " + 1180591620717411303424)"
    unit = "2361183241434822606848"
    tied = f"({scaled} % {unit} = 0 and ({scaled} // {unit}) % 2 = 1)"
    return f"(({scaled} // {unit}) - case when {tied} then 1 else 0 end)::double / {10**digits}::double"


DEPENDS = {
    "priced": ["call_log"], "rollup": ["priced"], "running": ["priced"],
    "snapshots": ["running"], "runs": ["logged"], "styled": ["runs"],
    "styled_rounded": ["styled"], "mixed": ["styled_rounded"], "scored": ["mixed"],
    "ranked": ["scored"], "code_won": ["ranked"], "spans": ["verdicts"],
    "judged": ["spans"], "marks": ["judged"], "extracted": ["answers"],
    "test_code": ["tool_outputs"], "ratings": ["tool_outputs"],
    "complexities": ["tool_outputs", "blocks"],
    "reported": ["tool_outputs", "ratings", "complexities"],
    "sparse_reported": ["tool_outputs", "ratings"],
}

DEFAULTS = {"weight_f": "0.7", "weight_s": "0.3", "penalty": "0.1", "styled": "styled"}


def sql(body: str, *views: str, **marks: str) -> str:
    """`body` over the named views and all they rest on."""
    needed: list[str] = []

    def add(name: str) -> None:
        for below in DEPENDS.get(name, []):
            add(below)
        if name not in needed:
            needed.append(name)

    for v in views:
        add(v)
    marks = {
        **DEFAULTS, **marks,
        "round_style": _round("raw_style", 3), "round_score": _round("raw_score", 3),
    }

    def text(name: str) -> str:
        out = VIEWS[name]
        for mark, value in marks.items():
            out = out.replace("{" + mark + "}", value)
        return out

    ctes = ",\n".join(f"{n} as ({text(n)}\n)" for n in needed)
    return f"with {ctes}\n{body}" if needed else body


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _filled(template: str, **values: str) -> str:
    """A prompt template as a SQL concatenation."""
    parts = re.split(r"<<(\w+)>>", template)
    return "concat(" + ", ".join(
        values[p] if i % 2 else _quoted(p) for i, p in enumerate(parts) if i % 2 or p
    ) + ")"


SCORE_COLUMNS = "select prompt_id, model, model_pos, status, passed, failed, style_score, score from scored"
LISTED = ("select cast(row_number() over (partition by {k} order by {o}) - 1 as integer) as line_no,"
          " {k}, line from lines")

ORACLES = {
    "code_scores": sql(SCORE_COLUMNS, "scored"),
    "code_scores_custom_weights": sql(
        SCORE_COLUMNS, "scored", weight_f="0.5", weight_s="0.5", penalty="0.05"),
    "scores_from_sparse_reports": sql(
        "select prompt_id, status, score,"
        " case when status = 'error' then 'syntax was not checked' end as error from scored",
        "sparse_reported", "scored", styled="sparse_reported"),
    "scores_from_reports": sql(SCORE_COLUMNS, "reported", "scored", styled="reported"),
    "code_winner": sql("select * from code_won", "code_won"),
    "code_winner_of_prompts": sql("""
select o_orderkey as prompt_id, coalesce(winner, 'No valid code found') as winner
from orders left join code_won on o_orderkey = prompt_id""", "code_won"),
    "code_ranking": sql("select * from ranked", "ranked"),
    "code_win_tally": sql("""
select winner, count(*) as wins, min(prompt_id) as first_win from code_won group by winner""",
        "code_won"),
    "code_win_lines": sql("""
select min(prompt_id) as first_win, concat(winner, ': ', count(*), ' wins') as line
from code_won group by winner""", "code_won"),
    "code_runner_up": sql("""
select w.prompt_id, w.winner, (select min_by(s.model, s.model_pos) from scored s
  where s.prompt_id = w.prompt_id and s.model <> w.winner) as runner_up from code_won w""",
        "code_won", "scored"),
    "syntax_short_circuit": sql(
        "select prompt_id, model, syntax_ok, case when syntax_ok then "
        + _filled(P.TEST_WRITER, prompt="prompt", code="response")
        + " end as test_request from runs", "runs"),
    "last_answers": sql("""
select prompt_id, model_pos, l_partkey, l_suppkey, l_returnflag from (
  select *, row_number() over (partition by prompt_id, model_pos order by
    cast(l_shipdate as date) desc, l_partkey desc, l_suppkey desc, l_quantity desc,
    l_discount desc, l_tax desc, l_returnflag desc) as n from logged) t where n = 1""", "logged"),
    "winner_disagreement": sql("""
select w.prompt_id, w.winner as score_winner, v.winner as judge_winner
from code_won w join code_verdicts v on w.prompt_id = v.prompt_id
where w.winner is distinct from v.winner""", "code_won", "code_verdicts"),
    "verdict_score_rows": sql("""
select n.prompt_id, n.model, coalesce(s.status, 'unknown') as status,
  coalesce(s.score, 0)::decimal(6,3) as score
from (select prompt_id, first_model as model from code_verdicts where first_model is not null
  union all select prompt_id, 'gpt-4' from code_verdicts where first_model is not null
  union all select prompt_id, 'notes' from code_verdicts where prompt_id % 6 = 2) n
left join scored s on n.prompt_id = s.prompt_id and n.model = s.model""",
        "code_verdicts", "scored"),
    "response_score_rows": sql("""
select o_orderkey as prompt_id, m.model, coalesce(s.status, 'unknown') as status,
  coalesce(s.score, 0)::decimal(6,3) as score
from orders cross join (values ('model-1'), ('model-3'), ('gpt-4')) m(model)
left join scored s on o_orderkey = s.prompt_id and m.model = s.model""", "scored"),
    "recorded_calls": sql("select call_seq, session_id, model, book, cost from priced", "priced"),
    "running_breakdown_docs": sql("""
select session_id, prompt_id, book, model, calls, cost,
  cast(sum(cost) over (partition by session_id, prompt_id) as decimal(28,9)) as total
from (select p.session_id, p.prompt_id, c.book, c.model, count(*) as calls,
    cast(sum(c.cost) as decimal(28,9)) as cost
  from (select distinct session_id, call_seq // 100 as prompt_id from priced) p
  join priced c on c.session_id = p.session_id and c.call_seq // 100 <= p.prompt_id
  group by p.session_id, p.prompt_id, c.book, c.model) t""", "priced"),
    "call_costs": sql("select call_seq, session_id, model, book, cost from priced", "priced"),
    "call_costs_custom_prices": sql("""
select call_seq, concat('nation-', session_id % 30) as model,
  cast((input_tokens * coalesce(n_nationkey * 0.001, 0.0015)
    + output_tokens * coalesce(n_regionkey * 0.002, 0.002)) / 1000 as decimal(18,9)) as cost
from call_log left join nation on session_id % 30 = n_nationkey""", "call_log"),
    "cost_rollup": sql("select * from rollup", "rollup"),
    "cost_total": sql("""
select session_id, count(*) as calls, cast(sum(cost) as decimal(28,9)) as total
from priced group by session_id""", "priced"),
    "cost_running": sql("select session_id, call_seq, running_cost from running", "running"),
    "cost_running_many_buckets": sql("select session_id, call_seq, running_cost from running", "running"),
    "cost_running_by_model": sql("""
select session_id, book, model, call_seq, row_number() over w as running_calls,
  cast(sum(cost) over w as decimal(28,9)) as running_cost
from priced window w as (partition by session_id, book, model order by call_seq
  rows unbounded preceding)""", "priced"),
    "cost_reset_sessions": sql("""
select session_id, session_no, count(*) as calls, cast(sum(cost) as decimal(28,9)) as total
from (select *, cast(sum(case when is_reset then 1 else 0 end) over (partition by session_id
  order by call_seq rows unbounded preceding) as bigint) as session_no from priced) t
group by session_id, session_no""", "priced"),
    "cost_reset_sessions_one_log": sql("""
select session_no, count(*) as calls, cast(sum(cost) as decimal(28,9)) as total
from (select *, cast(sum(case when is_reset then 1 else 0 end) over (order by call_seq
  rows unbounded preceding) as bigint) as session_no from priced) t group by session_no""",
        "priced"),
    "cost_rollup_and_total": sql("""
select session_id, book, model, false as is_total, calls, cost, first_seq from rollup
union all select session_id, null, null, true, cast(sum(calls) as bigint), cast(sum(cost) as decimal(28,9)),
  min(first_seq) from rollup group by session_id""", "rollup"),
    "cost_breakdown_doc": sql("""
select r.session_id, t.total, book, model, calls, r.cost from rollup r
join (select session_id, cast(sum(cost) as decimal(28,9)) as total from rollup group by session_id) t
  on r.session_id = t.session_id""", "rollup"),
    "cost_summary_lines": sql(", lines as (" + """
select session_id, 0 as part, 0 as pos, 'COST SUMMARY' as line from rollup group by session_id
union all select session_id, 1, 0, 'MODEL CALLS:' from rollup group by session_id
union all select session_id, case when book = 'model_calls' then 2 else 4 end, first_seq,
  concat('   ', model, ': ', calls, ' calls, $', cast(cost as decimal(28,4))) from rollup
union all select session_id, 3, 0, 'JUDGE CALLS:' from rollup group by session_id
union all select session_id, 5, 0, concat('TOTAL COST: $', cast(cast(sum(cost) as decimal(28,9))
  as decimal(28,4))) from rollup group by session_id""" + ")\n"
        + LISTED.format(k="session_id", o="part, pos"), "rollup"),
    "cost_snapshots": sql("select * from snapshots", "snapshots"),
    "cost_sum_own_vs_compat": sql("""
select cast(sum(cost_own) as decimal(28,9)) as total_own,
  cast(sum(cost_running) as decimal(38,9)) as total_of_running from snapshots""", "snapshots"),
    "verdict_status": sql("select prompt_id, status, error from judged", "judged"),
    "verdict_winner": sql(
        "select prompt_id, winner, winner_reasoning, loser_reasoning from judged", "judged"),
    "verdict_marks": sql("select * from marks", "marks"),
    "verdict_mark_stats": sql("""
select model, count(*) as verdicts, avg(correctness) as mean_correctness,
  avg(relevance) as mean_relevance from marks group by model""", "marks"),
    "text_win_tally": sql("""
select winner, count(*) as wins, min(prompt_id) as first_win from judged
where winner is not null and winner <> '' group by winner""", "judged"),
    "text_runner_up": sql("""
select prompt_id, winner, case when winner is distinct from 'model-a' then 'model-a'
  else 'model-b' end as runner_up from judged where ok""", "judged"),
    "verdict_report": sql(", lines as (" + """
select prompt_id, 0 as part, 0 as pos, 'JUDGE''S DETAILED ANALYSIS' as line from judged where ok
union all select prompt_id, 1, m * 10 + 1, concat(upper(model), ' ANALYSIS:') from shown
union all select prompt_id, 1, m * 10 + 2, concat('   Correctness: ', c, '/5') from shown
union all select prompt_id, 1, m * 10 + 3, concat('   Relevance: ', r, '/5') from shown
union all select prompt_id, 1, m * 10 + 4, concat('   Reasoning: ', reasoning) from shown where reasoning <> ''
union all select prompt_id, 2, 0, concat('WINNER (', winner, '):') from judged
  where ok and winner <> '' and winner_reasoning <> ''
union all select prompt_id, 2, 1, concat('   ', winner_reasoning) from judged
  where ok and winner <> '' and winner_reasoning <> ''
union all select prompt_id, 3, 0, concat('RUNNER-UP (', case when winner is distinct from 'model-a'
  then 'model-a' else 'model-b' end, '):') from judged where ok and loser_reasoning <> ''
union all select prompt_id, 3, 1, concat('   ', loser_reasoning) from judged
  where ok and loser_reasoning <> ''""" + ")\n" + LISTED.format(k="prompt_id", o="part, pos"),
        "marks").replace("\n, lines as", """,
shown as (select prompt_id, model, case model when 'model-a' then 1 else 2 end as m, reasoning,
  coalesce(cast(cast(correctness as bigint) as varchar), 'N/A') as c,
  coalesce(cast(cast(relevance as bigint) as varchar), 'N/A') as r from marks),
lines as""", 1),
    "code_verdict_report": sql(", lines as (" + """
select prompt_id, 0 as part, 0 as pos, 'JUDGE''S DETAILED CODE ANALYSIS' as line from code_verdicts
union all select prompt_id, 1, 0, concat(upper(first_model), ' ANALYSIS:') from told
union all select prompt_id, 1, 1, concat('   Final Score: ', case when status = 'evaluated'
  then cast(score::double as varchar) else '0' end) from met
union all select prompt_id, 1, 2, concat('   Tests: ', coalesce(passed, 0), ' passed, ',
  coalesce(failed, 0), ' failed') from met
union all select prompt_id, 1, 3, concat('   Style Score: ', case when status = 'error' then 'N/A'
  else cast(style_score as varchar) end) from met
union all select prompt_id, 1, 4, concat('   Pylint: ', case when status = 'error' then 'N/A'
  else cast(rating as varchar) end, '/10') from met
union all select prompt_id, 1, 5, concat('   Complexity: ', case when status = 'error' then 'N/A'
  else cast(cc as varchar) end) from met
union all select prompt_id, 1, 6, concat('   Security Issues: ', case when status = 'evaluated'
  then cast(issues as varchar) else 'N/A' end) from met
union all select prompt_id, 1, 7, concat('   Test Performance: ', told) from told
union all select prompt_id, 1, 8, '   Code Quality: clear' from told
union all select prompt_id, 2, 0, 'GPT-4 ANALYSIS:' from told
union all select prompt_id, 2, 1, '   Strengths: short' from told
union all select prompt_id, 3, 0, 'NOTES ANALYSIS:' from told where prompt_id % 6 = 2
union all select prompt_id, 4, 0, concat('WINNER (', winner, '):') from told
union all select prompt_id, 4, 1, '   w' from told
union all select prompt_id, 5, 0, concat('RUNNER-UP (', loser, '):') from losers
union all select prompt_id, 5, 1, '   l' from losers""" + ")\n"
        + LISTED.format(k="prompt_id", o="part, pos"), "code_verdicts", "scored").replace(
        "\n, lines as", """,
told as (select * from code_verdicts where first_model is not null),
met as (select s.* from told t join scored s on t.prompt_id = s.prompt_id and t.first_model = s.model),
losers as (select t.prompt_id, min_by(s.model, s.model_pos) as loser from told t
  join scored s on t.prompt_id = s.prompt_id where s.model <> t.winner group by t.prompt_id),
lines as""", 1),
    "extract_code": sql("select prompt_id, code from extracted", "extracted"),
    "stripped_responses": "select doc_id, trim(text, chr(32) || chr(10) || chr(9)) as response from documents",
    "clean_tests": sql(r"""
select snippet_id, regexp_replace(regexp_replace(regexp_replace(code, '(?m)^import.*\n?', '', 'g'),
  '(?m)^from.*import.*\n?', '', 'g'), '(?m)^```.*\n?', '', 'g') as tests from test_code""",
        "test_code"),
    "test_name": sql(r"""
select snippet_id, coalesce(nullif(regexp_extract(code, '(?m)^\s*def (test_[^(\n]*)', 1), ''),
  'test_function') as test_name from test_code""", "test_code"),
    "assert_count": sql(r"""
select snippet_id, cast(len(list_filter(string_split(code, chr(10)),
  lambda l: starts_with(trim(l), 'assert '))) as integer) as asserts from test_code""",
        "test_code"),
    "run_output_counts": sql(r"""
select snippet_id,
  case snippet_id % 5 when 0 then 4 when 1 then 9 when 3 then p_size else 0 end as passed,
  case snippet_id % 5 when 0 then 0 when 1 then 1 when 3 then 2 else 0 end as failed
from tool_outputs""", "tool_outputs"),
    "lint_rating": sql("select * from ratings", "ratings"),
    "security_count": sql("""
select snippet_id, cast(case when json_valid(report_json)
  then coalesce(json_array_length(report_json, '$.results'), 0) else 0 end as integer)
  as security_issues from tool_outputs""", "tool_outputs"),
    "finding_counts": sql("""
select t.snippet_id, cast(count(b.block) as integer) as security_issues from tool_outputs t
left join blocks b on t.snippet_id = b.snippet_id group by t.snippet_id""",
        "tool_outputs", "blocks"),
    "avg_complexity": sql("select * from complexities", "complexities"),
    "style_reports": sql(
        f"select snippet_id, {_round('rating', 2)} as pylint_score, "
        f"{_round('avg_complexity', 2)} as average_complexity, "
        f"{_round('raw_style', 3)} as style_score from (select r.snippet_id, rating, avg_complexity, "
        "(rating / 10) * (1::double / (1::double + avg_complexity / 10)) as raw_style "
        "from ratings r join complexities c on r.snippet_id = c.snippet_id) t",
        "ratings", "complexities"),
    # By construction: shapes 0, 2 and 3 hold valid code; two bare words do not compile.
    "syntax_ok": sql(
        "select snippet_id, snippet_id % 6 in (0, 2, 3) as syntax_ok from tool_outputs",
        "tool_outputs"),
    "prompt_previews": """
select doc_id, text[1:50] as preview, upper(lang) as label,
  concat(upper(lang[1]), lang[2:], ' Code Quality') as category from documents""",
    "prompt_batch": """
select item_id // 50000 as batch, cast(row_number() over (partition by item_id // 50000
  order by item_id) - 1 as integer) as prompt_idx, text as prompt from benchmark""",
    "prompt_arrays": """
select batch, cast(row_number() over (partition by batch order by doc_id) - 1 as integer) as prompt_idx,
  prompt from (
  select doc_id, text as prompt, (sum(strlen(coalesce(text, '')) + 4) over (order by doc_id)
    - strlen(coalesce(text, '')) - 4)::bigint // 1048576 as batch from documents) t""",
    "single_prompt_responses": sql("""
select 0 as prompt_idx, prompt, prompt_id, model, response from answers
where prompt = (select min(prompt) from answers)""", "answers"),
    "prompt_fanout": """
select batch, prompt_idx, prompt, model_pos, model from (
  select item_id // 50000 as batch, cast(row_number() over (partition by item_id // 50000
    order by item_id) - 1 as integer) as prompt_idx, text as prompt from benchmark) t,
  (values ('model-a', 0), ('model-b', 1)) m(model, model_pos)""",
    "enumerated_prompts": """
select doc_id, lang, row_number() over (order by doc_id) as prompt_idx from documents""",
    "requests": f"""
select doc_id as prompt_id, model, model_pos, case when lang = 'en'
  then {_quoted(P.SYSTEM_TEXT['code'])} else {_quoted(P.SYSTEM_TEXT['text'])} end as system_text,
  text as user_text
from documents, (values ('model-a', 0), ('model-b', 1)) m(model, model_pos)""",
    "map_responses": sql("""
select prompt_id, 'model-a' as model, 0 as model_pos, response_a as response from text_answers
union all select prompt_id, 'model-b', 1, response_b from text_answers""", "text_answers"),
    "recorded_responses": sql("""
select prompt_id, 'model-a' as model, 0 as model_pos, response_a as response from text_answers
union all select prompt_id, 'model-b', 1, response_b from text_answers""", "text_answers"),
    "response_listing": sql("""
select prompt_id, 0 as model_pos, concat(model, ':', chr(10), response, chr(10), repeat('-', 40))
  as listing from answers
union all select prompt_id, 1, concat('echo:', chr(10), 'You asked: ', prompt, chr(10),
  repeat('-', 40)) from answers""", "answers"),
    "judge_prompts_text": sql(
        "select prompt_id, concat(" + ", ".join([
            _filled(P.TEXT_JUDGE_HEAD, prompt="prompt"),
            _filled(P.TEXT_JUDGE_SECTION, model="model", response="response"),
            _filled(P.TEXT_JUDGE_SECTION, model="'echo'", response="concat('You asked: ', prompt)"),
            _quoted(P.TEXT_JUDGE_TASK),
            _filled(P.TEXT_JUDGE_ENTRY, model="model", correctness="'5'", relevance="'5'"),
            _filled(P.TEXT_JUDGE_ENTRY, model="'echo'", correctness="'3'", relevance="'4'"),
            _filled(P.TEXT_JUDGE_TAIL, winner="model"),
        ]) + ") as judge_prompt from answers", "answers"),
    "judge_prompts_code": sql(
        "select prompt_id, concat("
        + _filled(P.CODE_JUDGE_HEAD, prompt="min(prompt)") + ", string_agg("
        + _filled(
            P.CODE_JUDGE_SECTION, model="model", response="response", status="status",
            score="case when status = 'evaluated' then cast(score::double as varchar) else '0' end",
            tests="case when status = 'evaluated' then concat('{''passed'': ', passed,"
                  " ', ''failed'': ', failed, '}') else '{}' end",
            style_score="case when status <> 'error' then cast(style_score as varchar) else '0' end",
            pylint_score="case when status <> 'error' then cast(rating as varchar) else '0' end",
            complexity="case when status <> 'error' then cast(cc as varchar) else '0' end",
            issues="case when status = 'evaluated' then cast(issues as varchar) else '0' end",
        ) + ", '' order by model_pos), " + _quoted(P.CODE_JUDGE_TASK) + ", string_agg("
        + _filled(P.CODE_JUDGE_ENTRY, model="model") + ", '' order by model_pos), "
        + _quoted(P.CODE_JUDGE_TAIL) + ") as judge_prompt from scored group by prompt_id",
        "scored"),
    "test_requests": sql(
        "select prompt_id, " + _filled(P.TEST_WRITER, prompt="prompt", code="code")
        + " as test_request from extracted", "extracted"),
    "evaluation_docs": sql("""
select o_orderkey as prompt_id, coalesce(w.winner, 'No valid code found') as winner,
  concat('eval_code_', o_orderkey + 1, '_', strftime(o_orderdate, '%Y-%m-%dT%H-%M-%S')) as file_name,
  v.winner as judge_winner,
  sha256(concat(o_orderkey, chr(31), 'Write function f', o_orderkey)) as prompt_key,
  s.model, s.status, s.score, s.passed, case when s.status = 'evaluated' then s.issues end as issues,
  case when s.status = 'syntax_error' then s.issues end as details_issues,
  case when s.status = 'error' then 'test run timed out or reported no integer count' end as error
from orders left join code_won w on o_orderkey = w.prompt_id
left join scored s on o_orderkey = s.prompt_id
left join code_verdicts v on o_orderkey = v.prompt_id""", "code_won", "scored", "code_verdicts"),
    "text_evaluation_docs": sql("""
select a.prompt_id, case when ok then prompt end as prompt, winner, error,
  case when ok then 'model-a,model-b' end as models, case when ok then response_b end as second_response
from text_answers a join judged j on a.prompt_id = j.prompt_id""", "text_answers", "judged"),
    "text_evaluation_docs_sparse": sql("""
select a.prompt_id, case when ok and o_orderstatus = 'F' then prompt end as prompt,
  case when o_orderstatus = 'F' then winner end as winner,
  case when not ok or o_orderstatus <> 'F' then 'Failed to evaluate text' end as error,
  case when o_orderstatus <> 'F' then 'no verdict recorded'
    when js = '' then 'No valid JSON in judge output'
    when not json_valid(js) then 'Invalid JSON in judge output'
    when not ok then 'A model entry is not an object' end as details
from text_answers a join judged j on a.prompt_id = j.prompt_id
join orders on o_orderkey = a.prompt_id""", "text_answers", "judged"),
    "evaluation_docs_repeated": sql("""
select o_orderkey as prompt_id, coalesce(w.winner, 'No valid code found') as winner,
  s.model, s.status, s.score
from orders left join code_won w on o_orderkey = w.prompt_id
left join scored s on o_orderkey = s.prompt_id""", "code_won", "scored"),
    "document_json": sql("""
select prompt_id, prompt, response_a as first_response, 7 as lines from text_answers""",
        "text_answers"),
    "priced_docs": sql("""
select prompt_id, total, cast(model_kinds as integer) as model_kinds from text_answers a
left join (select call_seq // 10 as prompt_id, cast(sum(cost) as decimal(28,9)) as total,
  count(distinct case when book = 'model_calls' then model end) as model_kinds
  from priced group by call_seq // 10) c using (prompt_id)""", "text_answers", "priced"),
    "saved_code_docs_roundtrip": sql("""
select o_orderkey as prompt_id, coalesce(w.winner, 'No valid code found') as winner,
  s.model, s.status, s.score, s.passed, case when s.status <> 'error' then s.style_score end as style_score
from orders left join code_won w on o_orderkey = w.prompt_id
left join scored s on o_orderkey = s.prompt_id""", "code_won", "scored"),
    "saved_docs_roundtrip": sql("""
select prompt_id, case when ok then 'text' else 'failed' end as kind, winner,
  case when ok then cast(json_extract_string(js, '$."model-a".correctness') as double) end as first_mark
from judged""", "judged"),
    "stream_cost_rollup": sql("select * from rollup", "rollup"),
    "stream_call_log": sql("select * from rollup", "rollup"),
    "stream_cost_windows": sql("""
select strftime(h, '%Y-%m-%d %H:%M:%S') as hour, book, model, calls, cost from (
  select date_trunc('hour', ts) as h, book, model, count(*) as calls,
    cast(sum(cost) as decimal(28,9)) as cost from priced group by 1, 2, 3) t""", "priced"),
    "stream_win_tally": sql("""
select winner, count(*) as wins, min(prompt_id) as first_win from judged
where winner is not null and winner <> '' group by winner""", "judged"),
}

ORACLES["verdict_report_as_written"] = """
with reports as (select o_orderkey as prompt_id, [
  'JUDGE''S DETAILED ANALYSIS',
  'MODEL-A ANALYSIS:',
  concat('   Correctness: ', o_custkey % 5 + 1, '.0/5'),
  concat('   Relevance: ', o_orderkey % 5 + 1, '.5/5'),
  concat('   Reasoning: [''r', o_custkey % 7, ''', "it''s", None, True, 1.5]'),
  'MODEL-B ANALYSIS:',
  concat('   Correctness: {''z'': ', o_orderkey % 3, '.0, ''a'': ''x:y,"q"''}/5'),
  concat('   Relevance: ', case when o_orderkey % 20 >= 16 then concat('2e+', o_orderkey % 20)
    else concat('2', repeat('0', (o_orderkey % 20)::int), '.0') end, '/5'),
  'RUNNER-UP (model-b):',
  '   {''why'': False}'] as lines from orders)
select prompt_id, cast(generate_subscripts(lines, 1) - 1 as integer) as line_no, unnest(lines) as line from reports
"""
ORACLES["stream_reset_sessions"] = ORACLES["cost_reset_sessions"]
ORACLES["stub_judge"] = f"""
select prompt_id, concat('{{"winner": "', prompt_id, '"}}') as response,
  length(judge_prompt) as input_tokens, length(judge_prompt) % 7 as output_tokens
from ({ORACLES["judge_prompts_text"]}) t"""

ORACLES["document_texts"] = sql(r"""
select prompt_id, case when ok then concat(
  '{', chr(10), '  "prompt": "', prompt, '",', chr(10), '  "responses": {', chr(10),
  '    "model-a": "', response_a, '",', chr(10), '    "model-b": "', response_b, '"', chr(10), '  },', chr(10),
  '  "scores": ', inner_objects, ',', chr(10),
  '  "winner": ', case when winner is null then 'null' else concat('"', winner, '"') end, ',', chr(10),
  '  "prompt_id": "', prompt_id, '"', chr(10), '}')
  else concat('{', chr(10), '  "error": "', error, '",', chr(10), '  "details": "', details, '",', chr(10),
  '  "prompt_id": "', prompt_id, '"', chr(10), '}') end as doc
from (select *, case when js = '' then 'No valid JSON in judge output'
        when not json_valid(js) then 'Invalid JSON in judge output'
        else 'A model entry is not an object' end as details,
    regexp_replace(regexp_replace(
      replace(regexp_replace(replace(regexp_replace(js,
        ', "(relevance|reasoning)"', concat(',', chr(10), '      "\1"'), 'g'),
        ': {"', concat(': {', chr(10), '      "')),
        ', "(winner_reasoning|loser_reasoning|notes)"', concat(',', chr(10), '    "\1"'), 'g'),
        '}, "', concat(chr(10), '    },', chr(10), '    "')),
      '^\{', concat('{', chr(10), '    ')), '\}$', concat(chr(10), '  }')) as inner_objects
  from judged join text_answers using (prompt_id)) t""", "judged", "text_answers")
