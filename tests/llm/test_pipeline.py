import numpy as np
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyforge.llm.edit_match import normalized
from tests.llm.helpers import SF
from tests.llm.test_jaccard import brute_sets

tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_stages(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality classifier", "line dedup", "n-gram Jaccard join", "benchmark decontamination",
        "BPE encoding and decoding",
    ]
    assert all(s.columns == stages[0].columns for s in stages[:-1])
    counts = [s.count() for s in stages]
    assert counts[0] > counts[1] >= counts[2] > counts[3] > counts[4] == counts[5] > 0


def test_no_result_is_empty(spark, stages):
    had_text = {r["doc_id"] for r in stages[1].collect() if (r["text"] or "").strip()}
    for r in stages[5].collect():
        assert r["n_tokens"] > 0 or r["doc_id"] not in had_text


def test_planted_copies_leave_one(spark):
    text = "\n".join(f"line {i} of a passage with several words in it, number {i * i}" for i in range(12))
    rows = [(1, text, "own", 5), (2, text, "own", 6), (3, text + "\nand an end of its own", "own", 7),
            (4, None, "own", 8), (5, "", "own", 9), (6, "}\n}\nshort", "own", 1), (7, "else\n}\n}", "own", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string, n_chars bigint")
    kept = corpus_pipeline.line_dedup(spark, docs, SF)
    assert kept.columns == docs.columns
    found = {r["doc_id"]: r for r in kept.collect()}
    assert sorted(found) == [1, 3, 4, 5, 6, 7]
    assert found[1]["text"] == text and found[3]["text"] == "and an end of its own"
    assert found[6]["text"] == "}\n}\nshort" and found[7]["text"] == "else\n}\n}"
    assert {r["n_lines"] for r in found.values()} == {"own"}


def test_bad_documents_go_and_good_ones_stay(spark, stages):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in stages[1].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.97 * len(good)
    assert not any(i in kept for i, q in labels.items() if q == 0)


def test_no_near_duplicates_are_left(stages):
    before, after = ({r["doc_id"]: r["text"] for r in s.collect()} for s in (stages[2], stages[3]))
    left = [s for s in brute_sets(after.values(), 5) if s]
    for i, a in enumerate(left):
        for b in left[:i]:
            assert 100 * len(a & b) < 80 * len(a | b)
    # What went has a partner.
    everything = dict(zip(before, brute_sets(before.values(), 5)))
    for i in before.keys() - after.keys():
        assert any(
            j != i and 100 * len(everything[i] & s) >= 80 * len(everything[i] | s)
            for j, s in everything.items()
        )


def test_benchmark_is_gone(spark, stages):
    items = [normalized(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    for r in stages[4].collect():
        assert not any(item in normalized(r["text"]) for item in items)
        gone.pop(r["doc_id"])
    assert all(any(item in normalized(t) for item in items) for t in gone.values())


def test_tokens(stages):
    from tallyforge.llm.queries import tokenizer_path

    theirs = tokenizers.Tokenizer.from_file(tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    for r in stages[5].collect():
        ids = theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert np.frombuffer(r["token_ids"], "<u4").tolist() == ids


def test_registered(spark, stages):
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == {f"op{i}" for i in range(1, 14)}
    rows = entry.queries()["pipeline"](spark, SF).select("doc_id", "n_tokens").collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, stages[5].select("doc_id", "n_tokens").collect()))
