import re

import numpy as np
import pyarrow as pa
import pytest

from tallyforge.llm import jaccard_join
from tallyforge.llm.jaccard_join import jaccard_components, one_per_group, shingle_sets
from tests.llm.helpers import SF, awkward_rows, frame

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def brute_sets(texts, size):
    out = []
    for t in texts:
        w = WORD.findall((t or "").encode().lower())
        grams = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)}
        out.append(grams if w else set())
    return out


def brute_components(keys, sets, percent):
    parent = {k: k for k in keys}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    by_key = dict(zip(keys, sets))
    names = list(by_key)
    for i, a in enumerate(names):
        for b in names[:i]:
            x, y = by_key[a], by_key[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                parent[root(a)] = root(b)
    return {k: root(k) for k in keys}


@pytest.mark.parametrize("size,percent,rounds", [(3, 90, 3), (5, 80, 3), (3, 90, 1), (1, 50, 1)])
def test_equals_brute_force(spark, size, percent, rounds):
    rows = awkward_rows()
    found = jaccard_components(frame(spark, rows), size=size, percent=percent, rounds=rounds).collect()
    keys = [(r[0], r[1]) for r in rows]
    sets = brute_sets([r[1] for r in rows], size)
    groups = brute_components(keys, sets, percent)
    least = {}
    for k, s in zip(keys, sets):
        if s and k[0] is not None:
            least[groups[k]] = min(k[0], least.get(groups[k], k[0]))
    want = sorted(str((k[0], len(s), least.get(groups[k], k[0]) if s else k[0])) for k, s in zip(keys, sets))
    assert sorted(str((r["id"], r["n_shingles"], r["component_id"])) for r in found) == want


def test_whole_documents_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    sets = brute_sets([r["text"] for r in rows], 3)
    groups = brute_components([r["doc_id"] for r in rows], sets, 90)
    found = jaccard_components(docs).collect()
    mine = {r["id"]: r["component_id"] for r in found}
    pairs = {}
    for k, g in groups.items():
        pairs.setdefault(g, []).append(k)
    assert mine == {k: min(m) for m in pairs.values() for k in m}


def test_chain_over_several_pivots(spark):
    """A chain in which only neighbours link is one component."""
    words = [f"w{i}" for i in range(140)]
    rows = [(100 - i, " ".join(words[i : i + 100]), "") for i in range(0, 40, 2)]
    found = jaccard_components(frame(spark, rows), size=1, percent=90).collect()
    assert {r["component_id"] for r in found} == {100 - 38}


def hidden_by_pivots():
    """Two tables: B and C link, and whatever n-gram their prefixes share has a pivot A
    that links with neither.  Fillers make all other words more frequent."""
    def words(letter, n):
        return [f"{letter}{i}" for i in range(n)]

    def table(*texts, common):
        fillers = [common + words(f"f{k}x", 2 * len(common)) for k in range(5)]
        return [(i, " ".join(t), "") for i, t in enumerate([*texts, *fillers])]

    t, s, w = words("t", 31), words("s", 5), words("w", 35)
    # The pivots are too short for any pair: the first round finds none.
    short = table(*[[x] for x in s[:3]], s[:3] + t[:17], s[:3] + t[1:18], common=t)
    # A is compared with B and C in the first round; rarer words keep both behind it later.
    tried = table(s + w, words("b", 4) + s + t, words("c", 4) + s + t, common=t + w)
    return [(short, 90, (3, 4)), (tried, 80, (1, 2))]


@pytest.mark.parametrize("case", [0, 1])
def test_pairs_that_no_pivot_shows(spark, case):
    rows, percent, linked = hidden_by_pivots()[case]
    found = jaccard_components(frame(spark, rows), size=1, percent=percent).collect()
    keys = [(r[0], r[1]) for r in rows]
    groups = brute_components(keys, brute_sets([r[1] for r in rows], 1), percent)
    ids = [r[0] for r in rows]
    assert {(i, j) for i in ids for j in ids if i < j and groups[keys[i]] == groups[keys[j]]} == {linked}
    mine = {r["id"]: r["component_id"] for r in found}
    assert mine == {i: linked[0] if i in linked else i for i in ids}


def test_one_of_each_group_stays(spark):
    rows = awkward_rows()
    kept = one_per_group(frame(spark, rows), size=5, percent=80)
    assert kept.columns == ["doc_id", "text", "extra"]
    out = kept.collect()
    assert sum(r["extra"] == "near" for r in out) == 1 and min(r["doc_id"] for r in out if r["extra"] == "near") == 20
    assert sum(r["text"] == rows[4][1] for r in out) == 1
    assert {1, 2, 9} <= {r["doc_id"] for r in out} and sum(r["doc_id"] is None for r in out) == 2


def test_empty_table(spark):
    assert jaccard_components(frame(spark, [])).count() == 0
    assert one_per_group(frame(spark, [])).count() == 0


def test_long_words_differ_by_their_last_byte():
    a, b = shingle_sets(pa.array(["y" * 999 + "a", "y" * 999 + "b"]), 3)
    assert len(a) == len(b) == 1 and not np.array_equal(a, b)


def test_prefix_length():
    for n in range(1, 200):
        p = jaccard_join.prefix_length(n, 90)
        # Without the prefix, less is left than a link needs.
        assert n - p < 0.9 * n <= n - p + 1
