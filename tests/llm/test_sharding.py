import hashlib
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyforge.llm import sharding
from tallyforge.llm.sharding import cut, fits, shard_documents, smallest_capacity
from tests.llm.helpers import SF, awkward_rows, frame


def brute_capacity(sizes, shards):
    """Least greatest load over all contiguous partitions, by dynamic programming."""
    best = [0] + [float("inf")] * len(sizes)
    for _ in range(shards):
        best = [0] + [
            min(max(best[j], sum(sizes[j:i])) for j in range(i + 1)) for i in range(1, len(sizes) + 1)
        ]
    return best[-1]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=14), st.integers(1, 5))
def test_capacity_and_cuts(sizes, shards):
    capacity = smallest_capacity(sizes, shards, 0)
    assert capacity == brute_capacity(sizes, shards)
    assert not sizes or (fits(sizes, capacity, shards) and not fits(sizes, capacity - 1, shards))
    firsts = [*cut(sizes, shards, capacity), len(sizes)]
    assert firsts == sorted(firsts) and firsts[0] == 0
    assert max((sum(sizes[a:b]) for a, b in zip(firsts, firsts[1:])), default=0) <= capacity


def check(rows, found, shards):
    assert len(found) == len(rows)
    by_text = {}
    loads, slots = {}, {}
    for r in found:
        by_text.setdefault(r["text_sha256"], set()).add(r["shard"])
        loads[r["shard"]] = loads.get(r["shard"], 0) + r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert set(loads) <= set(range(shards))
    sizes = {}
    for text in rows:
        raw = (text or "").encode()
        key = hashlib.sha256(raw).hexdigest()
        sizes[key] = sizes.get(key, 0) + len(raw) + 1
    ordered = [sizes[k] for k in sorted(sizes)]
    assert max(loads.values(), default=0) == smallest_capacity(ordered, shards, 0)
    return loads


@pytest.mark.parametrize("digits", [1, 3])
def test_whole_table_reaches_the_smallest_capacity(spark, monkeypatch, digits):
    # With one digit, blocks have to be opened level by level.
    monkeypatch.setattr(sharding, "FIRST_DIGITS", digits)
    monkeypatch.setattr(sharding, "MORE_DIGITS", 1)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = shard_documents(docs).collect()
    check(list(texts.values()), found, 16)
    for r in found:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)


def test_awkward_rows_and_a_hot_group(spark):
    rows = awkward_rows() + [(1000 + i, "hot text " * 50, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard string")
    check([r[1] for r in rows], shard_documents(docs, shards=4).collect(), 4)


def test_a_heavy_group_does_not_starve_the_rest():
    sizes = [1000, *[10] * 90]
    capacity = smallest_capacity(sizes, 4, 0)
    firsts = [*cut(sizes, 4, capacity), len(sizes)]
    assert capacity == 1000 and min(sum(sizes[a:b]) for a, b in zip(firsts, firsts[1:])) >= 290


def test_empty_table(spark):
    assert shard_documents(frame(spark, [])).count() == 0
