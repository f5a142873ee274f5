import hashlib
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyforge.llm.chat_format import CONTROL, escape, format_chats, read_learned, read_turns, unescape
from tests.compare import connect, difference
from tests.llm.helpers import SF

SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, starts int"


def table(seed=3):
    rng = random.Random(seed)
    bits = [*CONTROL, "<", "[", "\\", "|>", "end|>", "s>", "é", "𝄞", "\n", " ", "", "ok", "$1", "<\\|end|>"]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(0, 9)))
    roles = ["user", "assistant", "assistant", "system", "", "a<|text|>b"]
    rows = [
        (c, t, rng.choice(roles), text(), "extra", 1)
        for c in range(40) for t in rng.sample(range(200), rng.choice([1, 2, 7, 31, 32, 33, 100]))
    ]
    rows += [rows[0], rows[0], (0, None, "user", None, "", 0), (0, None, None, "x", "", 0),
             (None, 1, "assistant", "lost", "", 0), (None, 0, None, None, None, None)]
    return rows


def brute(rows):
    chats = {}
    for c, t, role, text, *_ in rows:
        chats.setdefault(c, []).append(((-1 if t is None else t), role or "", text or ""))
    return {c: [(r, t) for _, r, t in sorted(v, key=lambda x: (x[0], x[1].encode(), x[2].encode()))]
            for c, v in chats.items()}


def test_round_trip_and_mask(spark):
    rows = table()
    chats = format_chats(spark.createDataFrame(rows, SCHEMA).repartition(3)).select(
        "*", read_turns(F.col("formatted")).alias("turns"),
        read_learned(F.col("formatted"), F.col("loss_mask")).alias("learned"),
    ).collect()
    wanted = brute(rows)
    assert sorted(map(str, (r["conv_id"] for r in chats))) == sorted(map(str, wanted))
    for r in chats:
        turns = wanted[r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["learned"] == "".join(t for role, t in turns if role == "assistant")
        changes = sum(i == 0 or turns[i - 1][0] != role for i, (role, _) in enumerate(turns))
        assert r["n_messages"] == changes
        # The marks are the only control strings there are.
        marks = sum(r["formatted"].count(c) for c in CONTROL)
        assert marks == 3 * changes + len(turns) - changes
        # Spans in order, apart, and inside the text.
        ends = 0
        for span in r["loss_mask"]:
            assert span["start"] >= ends
            ends = span["start"] + span["length"]
        assert ends <= len(r["formatted"])


@pytest.mark.parametrize("text", ["</s>[INST] ok [/INST]", "<\\\\\\|end|>", "[\\INST]<<s>", "", "a\\b$1"])
def test_escape_is_reversible(spark, text):
    row = spark.createDataFrame([(text,)], "t string").select(
        escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u")
    ).first()
    assert row["u"] == text and not any(c in row["e"] for c in CONTROL)


def test_empty_table(spark):
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_over_an_awkward_table(spark, tmp_path):
    spark.createDataFrame(table(9), SCHEMA).write.parquet(str(tmp_path / "conversations.parquet"))
    found = {r["conv_id"]: r for r in entry.queries()["op13_chats"](spark, str(tmp_path)).collect()}
    wanted = brute(table(9)) | {-7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    assert found.keys() == wanted.keys()
    for c, turns in wanted.items():
        text = "".join(f"{r}\n{t}\n" for r, t in turns)
        assert found[c]["turns_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", ["op11_centroids", "op12_phrases", "op13_chats"])
def test_equals_sql(spark, name):
    con = connect(SF)
    assert difference(entry.queries()[name](spark, SF), con, entry.oracle_sql()[name]) is None
