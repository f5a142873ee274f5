import hashlib
import math
import random

from tallyforge.llm.centroids import centroid_hash, cluster_vectors, with_inertia

SCHEMA = "vec_id bigint, embedding array<double>, cluster string, distance string, id int"


def brute(rows, k, rounds, dim, scale):
    """Everything anew in each round, in Python's integers."""
    usable = [
        (r[0], [math.floor(x * scale) if abs(x) < 2**53 else int(x) * scale for x in r[1]]) for r in rows
        if r[1] and len(r[1]) == dim and all(x is not None and math.isfinite(x) for x in r[1])
    ]
    hashed = sorted(
        (hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), v) for i, v in usable
    )
    centroids = [v for _, v in hashed[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in usable:
            groups.setdefault(nearest(v)[1], []).append(v)
        for j, vs in groups.items():
            centroids[j] = [sum(col) // len(vs) for col in zip(*vs)]
    found = [(i, *nearest(v)[::-1]) for i, v in usable]

    def as_long(n):
        return n if n < 2**63 else None

    return sorted(
        str((i, j, as_long(d), as_long(sum(e for _, h, e in found if h == j)),
             as_long(sum(e for _, _, e in found)), centroid_hash(centroids[j])))
        for i, j, d in found
    )


def table(seed, n=90, dim=6, spread=1.0):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(i % 4, 0.4) * spread for _ in range(dim)], "a", "b", i) for i in range(n)]
    rows += [rows[3], rows[3], (3, rows[5][1], "", "", 0), (None, rows[7][1], None, None, None)]
    odd = [None, [], [1.0] * (dim - 1), [None] + [1.0] * (dim - 1), [float("nan")] * dim,
           [float("-inf")] + [0.0] * (dim - 1), [0.0] * dim, [-0.0] * dim, [-1e-9] * dim]
    return rows + [(1000 + i, v, "x", "y", 1) for i, v in enumerate(odd)]


def clustered(spark, rows, k, rounds, dim, scale):
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    found = with_inertia(*cluster_vectors(df, k=k, rounds=rounds, dim=dim, scale=scale))
    return sorted(str(tuple(r)) for r in found.collect())


def test_equals_brute_force(spark):
    for seed, k, rounds in ((1, 5, 3), (2, 1, 2), (3, 16, 4), (4, 5, 0)):
        rows = table(seed)
        assert clustered(spark, rows, k, rounds, 6, 64) == brute(rows, k, rounds, 6, 64)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [float(i % 2)] * 6, "", "", 0) for i in range(12)]
    found = clustered(spark, rows, 8, 3, 6, 64)
    assert found == brute(rows, 8, 3, 6, 64)
    assert len({f.split(",")[1] for f in found}) == 2


def test_large_components(spark):
    rows = table(5, n=30) + [(500, [3e7] * 6, "", "", 0), (501, [-1e40, 1e300, 0.0, 0.0, 0.0, 1.5], "", "", 0),
                             (502, [1e308] * 6, "", "", 0)]
    assert clustered(spark, rows, 6, 3, 6, 64) == brute(rows, 6, 3, 6, 64)


def test_few_vectors_and_none(spark):
    rows = table(6)[:3]
    assert clustered(spark, rows, 16, 3, 6, 64) == brute(rows, 16, 3, 6, 64)
    assert clustered(spark, [], 16, 3, 6, 64) == []
    assert clustered(spark, [(1, None, "", "", 0)], 16, 3, 6, 64) == []
