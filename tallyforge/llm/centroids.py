"""Clusters of vectors on an integer grid, with exact arithmetic throughout.

Each component x becomes floor(scale * x).  Every vector keeps its exact dot product with
every centroid: this is the table that each round reads and writes.  When centroids move,
a vector's products change by the moved components only (product += component * change, for
the components whose change is not zero); no distance is computed anew.  The nearest
centroid is the argmin of |c|^2 - 2 v.c, ties to the smaller number.

What the driver holds: the k centroids, their sums and counts.  A round's sums are added up
in each task, per component, before they are shuffled.

Products and distances of 64 components stay below 2^62 for components up to 2^27; with
larger ones in the table, Python's integers are used and kept as decimal text, which is
slower and gives the same results.  A result beyond 64 bits is null.

Vectors that are null, of another length, or that hold null or non-finite components are
left out.  Repeated rows are vectors of their own.  A null id counts as empty text where ids
are hashed.  With fewer vectors than k there are fewer centroids; an empty table gives an
empty result.  Columns other than the two that are named are dropped.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.scratch import materialize

BLOCK = 1 << 13

Centroids = list[list[int]]


def _grid(values: np.ndarray, scale: int, exact: bool) -> np.ndarray:
    """floor(scale * x) of doubles."""
    if not exact:
        return np.floor(values * scale).astype(np.int64)
    # From 2^53 on every double is an integer, and the product might overflow.
    flat = [
        int(x) * scale if abs(x) >= 2.0**53 else math.floor(x * scale) for x in values.ravel().tolist()
    ]
    return np.array(flat, object).reshape(values.shape)


def _list_column(rows: np.ndarray, exact: bool) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    flat = rows.ravel()
    values = pa.array([str(x) for x in flat], pa.string()) if exact else pa.array(flat, pa.int64())
    return pa.ListArray.from_arrays(pa.array(ends), values)


def _matrix(column: pa.Array, width: int, exact: bool) -> np.ndarray:
    flat = column.flatten()
    if exact:
        flat = np.array([int(x) for x in flat.to_pylist()], object)
    else:
        flat = flat.to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def _number_type(exact: bool) -> str:
    return "string" if exact else "bigint"


def _blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            yield batch.slice(at, BLOCK)


def _first_products(batches, dim: int, scale: int, exact: bool, centroids: Centroids):
    """(id, v, products) of the vectors as they are read."""
    c = np.array(centroids, object if exact else np.int64).T
    for block in _blocks(batches):
        values = block.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        v = _grid(values.reshape(block.num_rows, dim), scale, exact)
        yield pa.RecordBatch.from_arrays(
            [block.column(0), _list_column(v, exact), _list_column(v @ c, exact)],
            ["id", "v", "products"],
        )


def _moved(batches, exact: bool, before: Centroids, after: Centroids):
    """Products after the centroids' moves: only components that changed are read."""
    kind = object if exact else np.int64
    change = np.array(after, kind) - np.array(before, kind)
    k, dim = change.shape
    parts = [np.flatnonzero(row) for row in change]
    for block in _blocks(batches):
        v = _matrix(block.column(1), dim, exact)
        products = _matrix(block.column(2), k, exact).copy()
        for j, part in enumerate(parts):
            if len(part):
                products[:, j] += v[:, part] @ change[j, part]
        yield pa.RecordBatch.from_arrays(
            [block.column(0), block.column(1), _list_column(products, exact)],
            ["id", "v", "products"],
        )


def _nearest(products: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each vector, and |c|^2 - 2 v.c there."""
    score = (centroids * centroids).sum(axis=1)[None, :] - 2 * products
    best = score.argmin(axis=1)
    return best, score[np.arange(len(score)), best]


def _sums(batches, exact: bool, centroids: Centroids):
    """(cluster, component, total) over all rows of a task; component -1 counts them."""
    c = np.array(centroids, object if exact else np.int64)
    k, dim = c.shape
    counts, totals = [0] * k, [[0] * dim for _ in range(k)]
    for block in _blocks(batches):
        v = _matrix(block.column(1), dim, exact)
        best, _ = _nearest(_matrix(block.column(2), k, exact), c)
        for j in np.unique(best).tolist():
            mine = v[best == j]
            counts[j] += len(mine)
            totals[j] = [a + int(b) for a, b in zip(totals[j], mine.sum(axis=0).tolist())]
    used = [j for j in range(k) if counts[j]]
    rows = [(j, -1, str(counts[j])) for j in used]
    rows += [(j, i, str(t)) for j in used for i, t in enumerate(totals[j])]
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()),
            pa.array([r[2] for r in rows], pa.string()),
        ],
        ["cluster", "component", "total"],
    )


def _assigned(batches, exact: bool, centroids: Centroids):
    """(id, cluster, distance), the distance as decimal text."""
    c = np.array(centroids, object if exact else np.int64)
    k, dim = c.shape
    for block in _blocks(batches):
        v = _matrix(block.column(1), dim, exact)
        best, score = _nearest(_matrix(block.column(2), k, exact), c)
        distance = (v * v).sum(axis=1) + score
        yield pa.RecordBatch.from_arrays(
            [
                block.column(0), pa.array(best.astype(np.int32)),
                pa.array([str(d) for d in distance.tolist()], pa.string()),
            ],
            ["id", "cluster", "distance"],
        )


def usable_vectors(vectors: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, x) of the vectors of `dim` finite components, as doubles."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall("x", lambda e: F.coalesce(
        (F.abs(e) < float("inf")) & ~F.isnan(e), F.lit(False)
    ))
    return vectors.select(F.col(id_col).alias("id"), x.alias("x")).filter(
        (F.size("x") == dim) & finite
    )


def first_centroids(usable: DataFrame, k: int, scale: int, seed: int) -> Centroids:
    """The vectors whose ids have the smallest hashes, in that order; ties by components."""
    text = F.coalesce(F.col("id").cast("string"), F.lit(""))
    rows = usable.orderBy(F.sha2(F.concat(F.lit(f"{seed}:"), text), 256), "x").limit(k).collect()
    return [[int(g) for g in _grid(np.array(r["x"]), scale, True)] for r in rows]


def _moved_centroids(state: DataFrame, exact: bool, centroids: Centroids) -> Centroids:
    """Componentwise floor(sum / count) of each centroid's vectors; empty ones stay."""
    partial = state.mapInArrow(
        lambda b: _sums(b, exact, centroids), "cluster int, component int, total string"
    )
    if exact:  # beyond any SQL number: at most k * dim short texts from each task
        groups = partial.groupBy("cluster", "component").applyInArrow(
            _add_up, "cluster int, component int, total string"
        )
    else:
        groups = partial.groupBy("cluster", "component").agg(
            F.sum(F.col("total").cast("decimal(38,0)")).cast("string").alias("total")
        )
    total = {(r["cluster"], r["component"]): int(r["total"]) for r in groups.collect()}
    return [
        [total[j, i] // total[j, -1] for i in range(len(c))] if (j, -1) in total else c
        for j, c in enumerate(centroids)
    ]


def _add_up(table: pa.Table) -> pa.Table:
    total = sum(int(t) for t in table.column("total").to_pylist())
    return table.slice(0, 1).set_column(2, "total", pa.array([str(total)], pa.string()))


def cluster_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16,
    rounds: int = 3, dim: int = 64, scale: int = 64, seed: int = 1,
) -> tuple[DataFrame, Centroids]:
    """(`id_col`, cluster, distance) of every usable vector, and the final centroids.

    `distance` is the squared Euclidean distance as decimal text, exact at any size.
    """
    usable = usable_vectors(vectors, id_col, vector_col, dim)
    kind = vectors.schema[id_col].dataType.simpleString()
    centroids = first_centroids(usable, k, scale, seed)
    if not centroids:
        return usable.select(
            F.col("id").alias(id_col), F.lit(0).alias("cluster"), F.lit("").alias("distance")
        ), []
    greatest = usable.agg(F.max(F.array_max(F.transform("x", F.abs)))).first()[0] * scale + 1
    exact = 4.0 * dim * greatest * greatest >= 2.0**62
    n = _number_type(exact)
    schema = f"id {kind}, v array<{n}>, products array<{n}>"
    state = materialize(usable.mapInArrow(
        lambda b, c=centroids: _first_products(b, dim, scale, exact, c), schema
    ), "products")
    for _ in range(rounds):
        after = _moved_centroids(state, exact, centroids)
        if after != centroids:
            state = materialize(state.mapInArrow(
                lambda b, c=centroids, a=after: _moved(b, exact, c, a), schema
            ), "products")
        centroids = after
    found = state.mapInArrow(
        lambda b: _assigned(b, exact, centroids), f"id {kind}, cluster int, distance string"
    )
    return found.withColumnRenamed("id", id_col), centroids


def centroid_hash(centroid: Sequence[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def with_inertia(assigned: DataFrame, centroids: Centroids, id_col: str = "vec_id") -> DataFrame:
    """Add the distances' sums per cluster and over all, and the centroid's hash.

    The sums are one row per cluster, thus k rows, which are broadcast.
    """
    spark = assigned.sparkSession
    amount = F.col("distance").try_cast("decimal(38,0)")
    # A sum is null once a distance does not fit.
    per_cluster = assigned.groupBy("cluster").agg(
        F.when(F.count(amount) == F.count("*"), F.try_sum(amount)).alias("cluster_inertia")
    )
    rows = per_cluster.collect()
    parts = [r["cluster_inertia"] for r in rows]
    whole = None if None in parts else sum(int(p) for p in parts)

    def as_long(number) -> int | None:
        return int(number) if number is not None and number < 2**63 else None

    table = spark.createDataFrame(
        [
            (r["cluster"], as_long(r["cluster_inertia"]), as_long(whole), centroid_hash(centroids[r["cluster"]]))
            for r in rows
        ],
        "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string",
    )
    return assigned.join(F.broadcast(table), "cluster").select(
        id_col, "cluster", F.col("distance").try_cast("bigint").alias("distance"),
        "cluster_inertia", "inertia", "centroid_sha256",
    )
