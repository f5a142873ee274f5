"""Near-duplicate vectors by cross-polytope hashing with multiprobe buckets.

A vector is turned by three rounds of random signs and fast Hadamard transforms; the
coordinate with the largest absolute value and its sign are one hash.  `functions`
hashes make a bucket code, and `tables` independent codes are taken.  A vector stands
in its own bucket of each table and in those next to it that take the second-largest
coordinate of one hash.  Two vectors meet where one stands in the other's own bucket.

Exact copies become one class first.  Buckets are compared in blocks of at most `block`
members against each other, so a hot bucket is spread over many tasks, and no pair ever
becomes a row: a block gives, per class, its number of links and the edges of a
spanning forest.  A pair that meets in several places counts at the first one only,
which either side finds from the codes of both.  Every link rests on the exact cosine
in double precision.

Vectors link only within equal labels and dimensions.  Null labels, null or empty
vectors, zero vectors and such with null or non-finite components link with nothing.
Rows with equal ids are separate vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.arrow import whole_groups
from tallyforge.llm.components import connected_components
from tallyforge.sources.scratch import materialize

THRESHOLD = 0.93
TABLES = 10
FUNCTIONS = 2
BLOCK = 1500
PAIRS_AT_ONCE = 1 << 18
_SIDE = ["label", "dim", "table", "code", "low", "high"]


def rotated(x: np.ndarray, seed: int) -> np.ndarray:
    """Three rounds of random signs and a fast Hadamard transform, padded to a power of 2."""
    n, dim = x.shape
    size = 1 << max(dim - 1, 1).bit_length()
    out = np.zeros((n, size))
    out[:, :dim] = x
    rng = np.random.default_rng(seed)
    for _ in range(3):
        out *= rng.choice([-1.0, 1.0], size)
        half = 1
        while half < size:
            pairs = out.reshape(n, size // (2 * half), 2, half)
            left, right = pairs[:, :, 0].copy(), pairs[:, :, 1]
            pairs[:, :, 0] = left + right
            pairs[:, :, 1] = left - right
            half *= 2
    return out


def bucket_codes(x: np.ndarray, tables: int, functions: int) -> np.ndarray:
    """Vectors x tables x (own code, then one code per probed neighbour)."""
    out = np.zeros((len(x), tables, 1 + functions), np.int64)
    rows = np.arange(len(x))
    for table in range(tables):
        tops = []
        for f in range(functions):
            turned = rotated(x, 1000 * table + f)
            size = np.abs(turned)
            best = size.argmax(axis=1)
            size[rows, best] = -1
            second = size.argmax(axis=1)
            tops.append([2 * c + (turned[rows, c] < 0) for c in (best, second)])
        base = 4 * x.shape[1]
        for probe in range(1 + functions):
            code = np.zeros(len(x), np.int64)
            for f in range(functions):
                code = code * base + tops[f][1 if probe == f + 1 else 0]
            out[:, table, probe] = code
    return out


def _first_meeting(a: np.ndarray, b: np.ndarray, table: np.ndarray, code: np.ndarray) -> np.ndarray:
    """True for pairs whose first common bucket is `code` of `table`.

    `a` and `b` are pairs x tables x codes.  In a table, the common buckets are the own
    bucket of one side where the other stands; the least of them counts.
    """
    most = np.iinfo(np.int64).max
    in_b = (a[:, :, :1] == b).any(axis=2)
    in_a = (b[:, :, :1] == a).any(axis=2)
    meet = np.minimum(np.where(in_b, a[:, :, 0], most), np.where(in_a, b[:, :, 0], most))
    first = (meet != most).argmax(axis=1)
    return (first == table) & (meet[np.arange(len(a)), first] == code)


def _forest(left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the given ones."""
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = root(i), root(j)
        if a != b:
            parent[a] = b
            kept.append((i, j))
    return kept


def _candidate_pairs(starts: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All i < j within each group, a bounded number at a time."""
    sizes = np.diff(starts)
    after = np.repeat(starts[1:], sizes) - 1 - np.arange(starts[-1])
    ends = np.cumsum(after)
    at = 0
    while at < len(after):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + PAIRS_AT_ONCE, "right")))
        left = np.repeat(np.arange(at, stop), after[at:stop])
        offset = np.arange(len(left)) - np.repeat(ends[at:stop] - after[at:stop] - base, after[at:stop])
        yield left, left + 1 + offset
        at = stop


def _compare(threshold: float, tables: int, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, _SIDE):
            own = rows.column("own").to_numpy(zero_copy_only=False)
            part = rows.column("part").to_numpy()
            low, high = rows.column("low").to_numpy(), rows.column("high").to_numpy()
            table, code = rows.column("table").to_numpy(), rows.column("code").to_numpy()
            copies = rows.column("copies").to_numpy()
            blobs = rows.column("vector").to_pylist()
            marks = rows.column("codes").to_pylist()
            names = rows.column("class").to_pylist()
            links: dict[str, int] = {}
            edges: list[tuple[str, str]] = []
            lefts, rights = [], []
            for i, j in _candidate_pairs(starts):
                # Two halves of a hot bucket meet across; each half alone in its own cell.
                meets = (own[i] | own[j]) & ((low[i] == high[i]) | (part[i] != part[j]))
                i, j = i[meets], j[meets]
                if not len(i):
                    continue
                used, at = np.unique(np.concatenate([i, j]), return_inverse=True)
                for dim in {len(blobs[u]) for u in used.tolist()}:
                    same = [n for n, u in enumerate(used.tolist()) if len(blobs[u]) == dim]
                    place = np.full(len(used), -1)
                    place[same] = np.arange(len(same))
                    x = np.frombuffer(b"".join(blobs[used[n]] for n in same)).reshape(len(same), -1)
                    a, b = place[at[: len(i)]], place[at[len(i) :]]
                    inside = (a >= 0) & (b >= 0)
                    close = np.zeros(len(i), bool)
                    close[inside] = np.einsum("ij,ij->i", x[a[inside]], x[b[inside]]) >= threshold
                    lefts.append(i[close])
                    rights.append(j[close])
            if not lefts:
                continue
            i, j = np.concatenate(lefts), np.concatenate(rights)
            for at in range(0, len(i), PAIRS_AT_ONCE // 8):
                a, b = i[at : at + PAIRS_AT_ONCE // 8], j[at : at + PAIRS_AT_ONCE // 8]
                used, where = np.unique(np.concatenate([a, b]), return_inverse=True)
                if not len(used):
                    continue
                all_codes = np.frombuffer(
                    b"".join(marks[u] for u in used.tolist()), np.int64
                ).reshape(len(used), tables, width)
                first = _first_meeting(
                    all_codes[where[: len(a)]], all_codes[where[len(a) :]], table[a], code[a]
                )
                a, b = a[first], b[first]
                for x, y in zip(a.tolist(), b.tolist(), strict=True):
                    links[names[x]] = links.get(names[x], 0) + int(copies[y])
                    links[names[y]] = links.get(names[y], 0) + int(copies[x])
                edges += [(names[x], names[y]) for x, y in _forest(a, b, rows.num_rows)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([*links, *[e[0] for e in edges]], pa.string()),
                    pa.array([*[None] * len(links), *[e[1] for e in edges]], pa.string()),
                    pa.array([*links.values(), *[0] * len(edges)], pa.int64()),
                ],
                ["a", "b", "n"],
            )

    return run


def near_vectors(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", threshold: float = THRESHOLD, tables: int = TABLES,
    functions: int = FUNCTIONS, block: int = BLOCK,
) -> DataFrame:
    """A row per vector: id, n_links, component_id (least id linked, directly or not), kept."""
    v = F.col(vector_col)
    numbers = F.transform(v, lambda x: x.cast("double"))
    finite = F.forall(
        numbers, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    )
    usable = F.coalesce(
        F.col(label_col).isNotNull() & (F.size(v) > 0) & finite
        & F.exists(numbers, lambda x: x != 0), F.lit(False),
    )
    rows = vectors.select(
        F.col(id_col).alias("id"), F.col(label_col).cast("string").alias("label"),
        F.when(usable, numbers).alias("x"),
    )
    width = 1 + functions

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                lists = part.column("x").to_pylist()
                labels = part.column("label").to_pylist()
                n = len(lists)
                names, blobs, codes, dims = [None] * n, [None] * n, [None] * n, [0] * n
                for dim in {len(x) for x in lists if x is not None}:
                    here = [i for i, x in enumerate(lists) if x is not None and len(x) == dim]
                    raw = np.array([lists[i] for i in here]) + 0.0
                    # Scaled by the largest component first: no overflow, no vanishing.
                    unit = raw / np.abs(raw).max(axis=1, keepdims=True)
                    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                    all_codes = bucket_codes(unit, tables, functions)
                    for k, i in enumerate(here):
                        text = f"{labels[i]}\0{dim}\0".encode() + raw[k].tobytes()
                        names[i] = hashlib.blake2b(text, digest_size=16).hexdigest()
                        blobs[i], codes[i], dims[i] = unit[k].tobytes(), all_codes[k].tobytes(), dim
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("id"), part.column("label"), pa.array(dims, pa.int32()),
                        pa.array(names, pa.string()), pa.array(blobs, pa.binary()),
                        pa.array(codes, pa.binary()),
                        pa.array([
                            None if c is None else np.frombuffer(c, np.int64).tolist() for c in codes
                        ], pa.list_(pa.int64())),
                    ],
                    ["id", "label", "dim", "class", "vector", "codes", "flat"],
                )

    id_type = rows.schema["id"].dataType.simpleString()
    coded = materialize(
        rows.mapInArrow(
            code, f"id {id_type}, label string, dim int, class string, vector binary,"
            " codes binary, flat array<bigint>",
        ), "vector-codes",
    )
    classes = materialize(
        coded.filter(F.col("class").isNotNull()).groupBy("class").agg(
            F.min("id").alias("least"), F.count("*").alias("copies"),
            *[F.any_value(c).alias(c) for c in ("label", "dim", "vector", "codes", "flat")],
        ), "vector-classes",
    )
    places = (
        classes.select("class", "label", "dim", F.posexplode("flat").alias("at", "code"))
        .select(
            "class", "label", "dim", "code", F.floor(F.col("at") / width).cast("int").alias("table"),
            (F.col("at") % width == 0).alias("own"),
        )
        # A vector stands once in a bucket, in its own one if that is among them.
        .groupBy("class", "label", "dim", "table", "code").agg(F.max("own").alias("own"))
    )
    bucket = ["label", "dim", "table", "code"]
    sizes = (
        places.groupBy(*bucket).agg(F.count("*").alias("n"), F.max("own").alias("has_own"))
        .filter("n > 1 and has_own").select(*bucket, F.ceil(F.col("n") / block).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("class"), F.col("parts")).cast("int")
    split = places.join(sizes, bucket).withColumn("part", part).withColumn(
        "__other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    ).select(
        "class", *bucket, "own", "part",
        F.least("part", "__other").alias("low"), F.greatest("part", "__other").alias("high"),
    )
    dealt = (
        split.join(classes.select("class", "copies", "vector", "codes"), "class")
        .repartition(*_SIDE).sortWithinPartitions(*_SIDE)
    )
    found = materialize(
        dealt.mapInArrow(_compare(threshold, tables, width), "a string, b string, n long"),
        "vector-links",
    )
    links = found.filter("b is null").groupBy(F.col("a").alias("class")).agg(F.sum("n").alias("n"))
    groups = connected_components(found.filter("b is not null").select("a", "b"))
    members = classes.join(groups, classes["class"] == groups["node"], "left").select(
        "class", "least", "copies", F.coalesce("component", "class").alias("component")
    )
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    resolved = members.join(least, "component").join(links, "class", "left").select(
        "class", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    return coded.select("id", "class").join(resolved, "class", "left").select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        F.coalesce(F.col("id") == F.coalesce("component_id", "id"), F.lit(True)).alias("kept"),
    )
