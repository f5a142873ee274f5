import random

import pytest

from tallyforge.llm import components
from tallyforge.llm.components import connected_components
from tests.llm.helpers import frame

EDGES = "a long, b long"


def brute(edges):
    parent = {}

    def root(k):
        while parent.setdefault(k, k) != k:
            k = parent[k]
        return k

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((k, root(k)) for k in parent)


def random_edges(seed, nodes, n):
    rng = random.Random(seed)
    return [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(n)]


CHAIN = [(i, i + 1) for i in range(40)]
CASES = [random_edges(1, 90, 60), CHAIN + [(7, 7)], [(5, 5)], [], [(9, 2), (9, 1), (2, 9), (9, 2)]]


@pytest.mark.parametrize("edges", CASES)
def test_equals_union_find(spark, edges):
    found = connected_components(frame(spark, edges, EDGES)).collect()
    assert sorted(tuple(r) for r in found) == brute(edges)


@pytest.mark.parametrize("later", CASES)
@pytest.mark.parametrize("earlier", [random_edges(2, 90, 40), CHAIN, []])
def test_later_edges_join_groups(spark, earlier, later):
    groups = connected_components(frame(spark, earlier, EDGES))
    found = connected_components(frame(spark, later, EDGES), groups).collect()
    assert sorted(tuple(r) for r in found) == brute(earlier + later)


def written(monkeypatch):
    names, write = [], components.materialize
    monkeypatch.setattr(components, "materialize", lambda t, name: names.append(name) or write(t, name))
    return names


def test_stars_need_no_round(spark, monkeypatch):
    names = written(monkeypatch)
    connected_components(frame(spark, [(1, 7), (8, 1), (3, 2), (2, 3)], EDGES))
    assert names == ["edges"]


def test_no_round_only_confirms(spark, monkeypatch):
    names = written(monkeypatch)
    connected_components(frame(spark, [(7, 1), (7, 2), (7, 3)], EDGES))
    assert names == ["edges", "large-star", "small-star"]
