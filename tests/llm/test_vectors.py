import numpy as np
import pytest

from tallyforge.llm.vector_lsh import near_vectors, rotated

SCHEMA = "vec_id bigint, embedding array<float>, label int, component string"


def brute(rows, threshold):
    ok = []
    for i, v, label, _ in rows:
        good = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.array(v, float) / np.linalg.norm(np.array(v, float)) if good else None)
    n = len(rows)
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(i):
            a, b = ok[i], ok[j]
            if a is None or b is None or rows[i][2] != rows[j][2] or len(a) != len(b):
                continue
            if a @ b >= threshold:
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    least = {}
    for i in range(n):
        if rows[i][0] is not None:
            least[root(i)] = min(rows[i][0], least.get(root(i), rows[i][0]))
    return sorted(str((rows[i][0], links[i], least.get(root(i)))) for i in range(n))


def table(seed=2, dim=24, groups=12):
    rng = np.random.default_rng(seed)
    rows, n = [], 0
    for g in range(groups):
        base = rng.standard_normal(dim)
        for k in range(9):
            v = base + rng.standard_normal(dim) * (0.05 + 0.08 * (k % 4))
            rows.append((n, v.astype(np.float32).tolist(), g % 3, "c"))
            n += 1
    rows += [(n + i, rows[0][1], 0, "c") for i in range(5)]
    n += 5
    odd = [None, [], [0.0] * dim, [float("nan")] + [1.0] * (dim - 1), [float("inf")] + [1.0] * (dim - 1),
           [None] + [1.0] * (dim - 1), [1.0, 2.0], [1.0, 2.0], [1e-30] * dim, [1e30] * dim]
    rows += [(n + i, v, 1, "c") for i, v in enumerate(odd)]
    rows += [(n + 50, rows[0][1], None, "c"), (3, rows[3][1], 0, "c"), (None, rows[0][1], 0, "c")]
    return rows


@pytest.mark.parametrize("block", [1500, 4])
def test_equals_brute_force(spark, block):
    # With small blocks, buckets are split and their parts compared crosswise.
    rows = table()
    found = near_vectors(spark.createDataFrame(rows, SCHEMA), block=block).collect()
    assert sorted(str((r["vec_id"], r["n_links"], r["component_id"])) for r in found) == brute(rows, 0.93)
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in found if r["vec_id"] is not None)


def test_recall_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for g in range(300):
        base = rng.standard_normal(64)
        near = base + 0.3 * rng.standard_normal(64)
        rows += [(2 * g, base.tolist(), 0, ""), (2 * g + 1, near.tolist(), 0, "")]
    found = near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    unit = np.array([r[1] for r in rows], np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    true = (unit @ unit.T >= 0.93).sum() - len(rows)
    assert true > 400
    assert 0.98 * true <= sum(r["n_links"] for r in found) <= true


def test_rotation_keeps_angles():
    x = np.random.default_rng(1).standard_normal((5, 48))
    y = rotated(x, 3)
    assert np.allclose(y @ y.T / (y[0] @ y[0]), x @ x.T / (x[0] @ x[0]))


def test_empty_table(spark):
    assert near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
