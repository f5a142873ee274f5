import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm.suffix_array import common_prefixes, suffix_array
from tallyforge.llm.suffix_dedup import remove_repeats
from tests.llm.helpers import awkward_rows, frame


def brute_order(strings):
    at, out = 0, []
    for s in strings:
        out += [(s[i:], at + i) for i in range(len(s))]
        at += len(s)
    return [p for _, p in sorted(out)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_order_and_common_prefixes(strings):
    data = np.frombuffer(b"".join(strings), np.uint8)
    sizes = np.array([len(s) for s in strings])
    begins = np.cumsum(sizes) - sizes
    ends = np.repeat(begins + sizes, sizes)
    order, rank = suffix_array(data, ends)
    assert order.tolist() == brute_order(strings)
    assert rank[order].tolist() == list(range(len(data)))
    common = common_prefixes(data, ends, order, rank, begins, sizes)
    for k in range(1, len(order)):
        a, b = (data[p : ends[p]].tolist() for p in (order[k - 1], order[k]))
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[order[k]] == n


def brute_kept(texts, length):
    where = {}
    for d, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            where.setdefault(t[i : i + length], []).append((d, i))
    gone = [set() for _ in texts]
    for places in where.values():
        if len(places) > 1:
            for d, i in places:
                gone[d].update(range(i, i + length))
    return [(bytes(b for i, b in enumerate(t) if i not in g), len(g)) for t, g in zip(texts, gone)]


@pytest.mark.parametrize("length,anchor,shard", [(60, 16, 1000), (60, 16, 3), (400, 64, 1000)])
def test_equals_brute_force(spark, monkeypatch, length, anchor, shard):
    import tallyforge.llm.suffix_dedup as module

    # A small shard spreads an anchor over several shards, which are then merged.
    monkeypatch.setattr(module, "SHARD_PIECES", shard)
    rows = awkward_rows()
    found = remove_repeats(frame(spark, rows), length=length, anchor=anchor).collect()
    want = brute_kept([(r[1] or "").encode() for r in rows], length)
    mine = sorted((str(r["doc_id"]), r["n_bytes"], bytes(r["kept"])) for r in found)
    assert mine == sorted((str(r[0]), len((r[1] or "").encode()), k) for r, (k, _) in zip(rows, want))
    for r in found:
        assert sum(s["last"] - s["first"] for s in r["spans"]) == r["n_bytes"] - len(r["kept"])
        assert all(a["last"] < b["first"] for a, b in zip(r["spans"], r["spans"][1:]))


def test_empty_table(spark):
    assert remove_repeats(frame(spark, [])).count() == 0


def test_clashing_columns(spark):
    rows = [(1, "abc " * 200, 7, "x"), (2, "abc " * 200, 8, "y")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, anchor int, covered string")
    assert [len(r["kept"]) for r in remove_repeats(docs).collect()] == [0, 0]


def test_very_many_repeated_rows(spark):
    text = " ".join(f"word{i * 7919 % 1000}" for i in range(80))
    rows = [(5, text, "")] * 1000 + [(None, text, "")] * 1000 + [(6, "alone " + text[:300], "")]
    found = remove_repeats(frame(spark, rows), length=400).collect()
    assert len(found) == 2001 and len(text) > 400
    assert all((len(r["kept"]) == 0) == (r["doc_id"] != 6) for r in found)
