import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import edit_match
from tallyforge.llm.edit_match import Pattern, decontaminate, match_items, normalized
from tallyforge.llm.queries import QUERIES
from tests.llm.helpers import SF, awkward_rows, frame


def brute_distance(item, text):
    """Least edit distance of `item` to any passage of `text`, by dynamic programming."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, d in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return min(row)


@settings(max_examples=200, deadline=None)
@given(st.text("abc ", min_size=1, max_size=40), st.text("abc ", max_size=80))
def test_bit_parallel_distance(item, text):
    assert Pattern(item).best(text)[0] == min(brute_distance(item, text), len(item))


def edited(text, edits, rng):
    for _ in range(edits):
        i = rng.randrange(len(text))
        text = text[:i] + rng.choice(["", "q", "zz"[:1] + text[i : i + 1]]) + text[i + 1 :]
    return text


@pytest.mark.parametrize("block", [4 << 20, 300])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(edit_match, "ITEM_BLOCK_BYTES", block)
    monkeypatch.setattr(edit_match.item_blocks, "__defaults__", (block,))
    rng = random.Random(4)
    words = ["river", "stone", "cloud", "lamp", "green", "seven", "walk"]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, prose(25)) for i in range(8)] + [(8, None), (9, ""), (10, "stone  LAMP"), (11, None)]
    items += [(12, items[0][1])]
    docs = [(i, prose(15) + " " + edited(items[i % 8][1], i, rng) + "\n" + prose(15), "x") for i in range(24)]
    docs += awkward_rows()
    found = match_items(
        frame(spark, docs), spark.createDataFrame(items, "item_id int, text string"), error_rate=0.08
    ).collect()
    want = []
    for doc_id, text, _ in docs:
        for item_id, item in items:
            a, b = normalized(item), normalized(text)
            if a and b and (d := brute_distance(a, b)) <= int(0.08 * len(a)):
                want.append((doc_id, item_id, d))
    mine = [(r["doc_id"], m["item"], m["distance"]) for r in found for m in r["matches"]]
    assert sorted(mine, key=str) == sorted(want, key=str) and len(found) == len(docs)


def test_documents_with_items_go(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    texts = [normalized(r["text"]) for r in items.collect()]
    kept = {r["doc_id"] for r in decontaminate(docs, items).collect()}
    rows = docs.collect()
    holding = {r["doc_id"] for r in rows if any(t in normalized(r["text"]) for t in texts)}
    assert holding and not holding & kept and len(kept) + len(holding) == len(rows)


def test_query_lists_each_item_of_each_document(spark):
    items = {r["item_id"]: normalized(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    exact = {(r["doc_id"], i) for r in docs for i, t in items.items() if t in normalized(r["text"])}
    found = QUERIES["op9_decontamination"](spark, SF).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found if r["distance"] == 0} == exact
    by_id = {r["doc_id"]: normalized(r["text"]) for r in docs}
    for r in found:
        assert r["distance"] == brute_distance(items[r["item_id"]], by_id[r["doc_id"]])


def test_columns_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "some item text")], "item_id int, text string")
    docs = spark.createDataFrame(awkward_rows(), "doc_id bigint, text string, matches string")
    assert decontaminate(frame(spark, []), items).count() == 0
    assert match_items(docs, items.limit(0)).count() == len(awkward_rows())
    clean = decontaminate(docs, items)
    assert clean.columns == ["doc_id", "text", "matches"] and clean.count() == len(awkward_rows())
    assert {r["matches"] for r in clean.collect()} >= {"near", "a"}
