import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyforge.functions.json_text import indented_json, json_string
from tallyforge.plans.evaluation import CodeEvaluator, TextEvaluator
from tallyforge.sources import documents as SD
from tests.compare import connect, difference
from tests.test_documents import candidates, prompts

SF = "/root/testdata/sf0.001"
STRINGS = [
    "", "plain", 'a "quote"', "back\\slash", "tab\tline\nend\r\b\f", "é ü 語 😀", "\x00\x01\x1f\x7f\x80",
    "{not, json: [}", "a\\u00E9 stays", "/slash/ </script>", "x" * 30000 + "é",
]


def test_strings(spark):
    rows = spark.createDataFrame([(i, s) for i, s in enumerate([*STRINGS, None])], "i int, s string")
    got = [r[0] for r in rows.orderBy("i").select(json_string(F.col("s"))).collect()]
    assert got == [json.dumps(s) for s in STRINGS] + [None]


VALUES = [
    {}, [], [[], {}, [{}]], {"b": 1, "a": {"z": [1, 2.5, -3, True, None, "é{,"], "y": {}}}, "text", 5, 5.0, None,
    [1e16, 1e-7, 123456789.125, -0.5, 0.0, 10**20], {"é": "\n", "k:": ",", "": [""]}, [[[[[1], 2], 3], 4], 5],
]


def test_values(spark):
    rows = [(i, json.dumps(v, ensure_ascii=bool(i % 2), separators=((",", ":") if i % 3 else None)))
            for i, v in enumerate(VALUES)]
    got = spark.createDataFrame([*rows, (99, None)], "i int, s string").orderBy("i")
    got = [r[0] for r in got.select(indented_json(F.col("s"))).collect()]
    assert got == [json.dumps(v, indent=2) for v in VALUES] + [None]


def test_text_documents_as_saved(spark):
    scores = {"z": {"relevance": 5.0, "correctness": 4, "why": ["é", {"b": 1, "a": None}]}, "a": {}, "winner": None}
    verdicts = spark.createDataFrame(
        [(1, f"Well: {json.dumps(scores, ensure_ascii=False)} ok"), (2, "none")], "prompt_id BIGINT, judge_text STRING")
    answers = spark.createDataFrame(
        [(i, m, k, f"answer\nof \"{m}\" é") for i in (1, 2, 3) for k, m in enumerate(("z", "a"))],
        "prompt_id BIGINT, model STRING, model_pos INT, response STRING")
    docs = TextEvaluator(verdicts, written=True).evaluate(prompts(spark), answers)
    got = {r[0]: r[1] for r in docs.select("prompt_id", SD.document_text(docs.columns)).collect()}
    responses = {m: f"answer\nof \"{m}\" é" for m in ("z", "a")}
    want = {"prompt": "p1", "responses": responses, "scores": scores, "winner": None, "prompt_id": "1"}
    assert got[1] == json.dumps(want, indent=2)
    assert json.loads(got[2]).keys() == {"error", "details", "prompt_id"}
    assert json.loads(got[3])["details"] == "no verdict recorded"
    # Without the judge's own text, keys are sorted and the rest is equal.
    plain = docs.drop("scores_text")
    other = plain.filter("prompt_id = 1").select(SD.document_text(plain.columns)).first()[0]
    assert json.loads(other) == want


def test_code_documents_as_saved(spark):
    analysis = {"z": {"strengths": "s", "code_quality": 4.5}, "winner": "z", "a": {"weaknesses": []}}
    verdicts = spark.createDataFrame([(1, json.dumps(analysis)), (2, "none")], "prompt_id BIGINT, judge_text STRING")
    docs = CodeEvaluator(verdicts=verdicts, written=True).evaluate(prompts(spark), candidates(spark))
    got = {r[0]: r[1] for r in docs.select("prompt_id", SD.document_text(docs.columns)).collect()}
    doc = json.loads(got[1])
    assert list(doc) == ["prompt", "results", "winner", "judge_analysis", "prompt_id"]
    assert got[1] == json.dumps(doc, indent=2) and list(doc["results"]) == ["z", "a", "m"]
    assert doc["judge_analysis"] == analysis and list(doc["judge_analysis"]) == list(analysis)
    assert doc["results"]["z"]["style"]["style_score"] == 0.708
    assert json.loads(got[2])["judge_analysis"] == {}
    assert "judge_analysis" not in json.loads(got[3])


def test_written_text_reads_back(spark, tmp_path):
    docs = entry.queries()["document_texts"](spark, SF)
    rows = docs.limit(40).collect()
    for r in rows:
        (tmp_path / f"{r.prompt_id}.json").write_text(r.doc)
        assert json.dumps(json.loads(r.doc), indent=2) == r.doc
    back = {r.prompt_id: r.kind for r in SD.read_documents(spark, str(tmp_path)).collect()}
    assert {int(i): k for i, k in back.items()} == {
        r.prompt_id: "failed" if "error" in json.loads(r.doc) else "text" for r in rows}


@pytest.mark.parametrize("name", ["document_texts"])
def test_query_equals_its_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None
