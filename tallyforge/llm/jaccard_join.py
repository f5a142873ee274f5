"""N-gram Jaccard self-join by rare-first prefix filtering.

A document is the set of its distinct word n-grams, as 64-bit hashes.  All n-grams get
one global order, rarest first: by the count of their cell in a table of `CELLS` hashed
counters that is filled from all documents (a fixed size, whatever the input), then by
hash.  The order decides speed only, never results.  Two sets with Jaccard similarity
of `percent` hundredths or more share an n-gram among the first
``size - ceil(percent * size / 100) + 1`` of each, so documents are joined on those.

Equal sets become one node first.  A pair must pass, in this order, the length filter,
the positional filter (what can still be common given where the shared n-gram stands in
both), the suffix filter (the sum of differences between counts of both sets in
`PARTS` ranges of hashes is no more than their allowed difference), and is then
verified once on the whole sets.

To find components no group is expanded into all its pairs.  Each round, every node
tries the most promising of its n-grams' pivots (one member per n-gram) that lies in
another component; verified links join components; pairs tried are not tried again.
After `ROUNDS` rounds, what is left are pairs across components: those of n-grams that
still stand in several components are all verified, so no link between components is
lost.

Nulls and texts without words have an empty set and link with nothing.  Rows with equal
id and text count as one document, rows with equal ids and different texts as several.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.arrow import lower_ascii, text_blocks, text_bytes, word_spans
from tallyforge.llm.components import connected_components
from tallyforge.llm.hashing import shingle_hashes, word_hashes
from tallyforge.llm.keys import KEY, row_key
from tallyforge.sources.scratch import materialize

CELL_BITS = 20
SLICES = 64
SALTS = 16
PARTS = 64
ROUNDS = 3

_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, *range(9, 14)]] = False


def shingle_sets(column: pa.Array, size: int) -> list[np.ndarray]:
    """Sorted distinct n-gram hashes of each text of a block."""
    data, offsets = text_bytes(column)
    data = lower_ascii(data)
    starts, ends, first = word_spans(_IS_WORD[data], offsets)
    words = word_hashes(data, starts, ends)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        grams = np.sort(shingle_hashes(words[a:b], size))
        if len(grams) > 1:
            grams = grams[np.concatenate([[True], grams[1:] != grams[:-1]])]
        out.append(grams)
    return out


def _cell(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def cell_counts(docs: DataFrame, text_col: str, size: int) -> np.ndarray:
    """In how many documents the n-grams of each cell stand, over all documents."""
    width = (1 << CELL_BITS) // SLICES

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, salt = np.zeros(1 << CELL_BITS, np.int64), 0
        for block in text_blocks(batches, "__text"):
            grams = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(block.column("__text"), size)])
            total += np.bincount(_cell(grams), minlength=1 << CELL_BITS)
            salt = int(total.sum())
        yield from _slices(total, salt % SALTS, width)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for place, raw in zip(
                batch.column("slice").to_pylist(), batch.column("counts").to_pylist(), strict=True
            ):
                values = np.frombuffer(raw, np.int64)
                sums[place] = sums[place] + values if place in sums else values
        for place, values in sums.items():
            yield _slice_row(place, 0, values)

    schema = "slice int, salt int, counts binary"
    parts = docs.select(F.col(text_col).alias("__text")).mapInArrow(count, schema)
    # Two levels: no task adds up more than a share of the map tasks' counters.
    parts = parts.repartition("slice", "salt").mapInArrow(add, schema)
    rows = parts.repartition("slice").mapInArrow(add, schema).collect()
    out = np.zeros(1 << CELL_BITS, np.int64)
    for r in rows:
        out[r["slice"] * width : (r["slice"] + 1) * width] = np.frombuffer(r["counts"], np.int64)
    return np.minimum(out, np.iinfo(np.int32).max).astype(np.int32)


def _slice_row(place: int, salt: int, values: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([place], pa.int32()), pa.array([salt], pa.int32()),
         pa.array([values.tobytes()], pa.binary())], ["slice", "salt", "counts"],
    )


def _slices(total: np.ndarray, salt: int, width: int) -> Iterator[pa.RecordBatch]:
    for place in range(SLICES):
        values = total[place * width : (place + 1) * width]
        if values.any():
            yield _slice_row(place, salt, values)


def prefix_length(size: int, percent: int) -> int:
    return size - -(-percent * size // 100) + 1


def document_sets(
    docs: DataFrame, id_col: str, text_col: str, size: int, percent: int
) -> DataFrame:
    """A row per row of `docs`: id, key, n, signature, prefix (rarest first), parts."""
    counts = docs.sparkSession.sparkContext.broadcast(cell_counts(docs, text_col, size))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequency = counts.value
        for block in text_blocks(batches, "__text"):
            sets = shingle_sets(block.column("__text"), size)
            signatures, prefixes, parts = [], [], []
            for grams in sets:
                if not len(grams):
                    signatures.append(None)
                    prefixes.append([])
                    parts.append(None)
                    continue
                signatures.append(hashlib.blake2b(grams.tobytes(), digest_size=16).hexdigest())
                order = np.argsort(frequency[_cell(grams)], kind="stable")
                chosen = grams[order[: prefix_length(len(grams), percent)]]
                prefixes.append(chosen.view(np.int64))
                spread = np.bincount(_cell(grams) % PARTS, minlength=PARTS)
                parts.append(spread.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("id"), block.column(KEY),
                    pa.array([len(g) for g in sets], pa.int64()), pa.array(signatures, pa.string()),
                    pa.array(prefixes, pa.list_(pa.int64())), pa.array(parts, pa.binary()),
                ],
                ["id", KEY, "n", "signature", "prefix", "parts"],
            )

    rows = docs.select(
        F.col(id_col).alias("id"), row_key(id_col, text_col).alias(KEY),
        F.col(text_col).alias("__text"),
    )
    return rows.mapInArrow(
        run, f"id {id_type}, {KEY} string, n long, signature string,"
        " prefix array<bigint>, parts binary",
    )


def _passes(percent: int):
    """Length and positional filter of a row with n, pos and other_n, other_pos.

    Both sets are in one order, so before the first n-gram that a pair shares it shares
    none: that one and what follows it on the shorter side must be enough.  A pair that
    links passes at its first shared n-gram at least.
    """
    n, m = F.col("n"), F.col("other_n")
    length = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    most = F.least(n - F.col("pos"), m - F.col("other_pos"))
    return length & ((100 + percent) * most >= percent * (n + m))


class _Verifier:
    """Pairs of nodes to links; keeps the sets of nodes it has already cut."""

    def __init__(self, docs, nodes, id_col, text_col, size, percent):
        self.texts = docs.select(row_key(id_col, text_col).alias(KEY), F.col(text_col).alias("__text"))
        self.nodes, self.size, self.percent = nodes, size, percent
        self.sets = None

    def _sets_of(self, wanted: DataFrame) -> DataFrame:
        """`node`, `grams` for the wanted nodes; cut from the texts once per node."""
        if self.sets is not None:
            wanted = wanted.join(self.sets.select("node"), "node", "left_anti")
        size = self.size

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in text_blocks(batches, "__text"):
                sets = [g.tobytes() for g in shingle_sets(block.column("__text"), size)]
                yield pa.RecordBatch.from_arrays(
                    [block.column("node"), pa.array(sets, pa.binary())], ["node", "grams"]
                )

        keys = self.nodes.select("node", KEY).join(wanted, "node")
        # Rows with equal id and text give the same set twice.
        cuts = self.texts.join(keys, KEY).select("node", "__text").mapInArrow(
            cut, "node long, grams binary"
        ).dropDuplicates(["node"])
        new = materialize(cuts, "jaccard-sets")
        self.sets = new if self.sets is None else self.sets.unionByName(new)
        return self.sets

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs `a`, `b` whose similarity is high enough."""
        percent = self.percent

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n = batch.column("an").to_numpy() + batch.column("bn").to_numpy()
                apart = np.array([
                    np.abs(np.frombuffer(a, "<i4") - np.frombuffer(b, "<i4")).sum()
                    for a, b in zip(
                        batch.column("ap").to_pylist(), batch.column("bp").to_pylist(), strict=True
                    )
                ])
                # Sets that link differ in (100 - percent) / (100 + percent) of both at most.
                yield batch.select(["a", "b"]).filter(
                    pa.array((100 + percent) * apart <= (100 - percent) * n)
                )

        def same(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = []
                for a, b in zip(
                    batch.column("ag").to_pylist(), batch.column("bg").to_pylist(), strict=True
                ):
                    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(100 * common >= percent * (len(x) + len(y) - common))
                yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

        short = self.nodes.select("node", "n", "parts")
        filtered = materialize(
            pairs.join(short.toDF("a", "an", "ap"), "a").join(short.toDF("b", "bn", "bp"), "b")
            .mapInArrow(near, "a long, b long"), "jaccard-candidates",
        )
        sets = self._sets_of(
            filtered.select(F.col("a").alias("node"))
            .unionByName(filtered.select(F.col("b").alias("node"))).distinct()
        )
        return materialize(
            filtered.join(sets.toDF("a", "ag"), "a").join(sets.toDF("b", "bg"), "b")
            .mapInArrow(same, "a long, b long"), "jaccard-links",
        )


def jaccard_components(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3,
    percent: int = 90, rounds: int = ROUNDS,
) -> DataFrame:
    """A row per row of `docs`: `id`, key, n_shingles, component_id (the least id that can
    be reached by links) and `group` (a number of the component, null for an empty set).

    Where all ids of a component are null, so is its component_id; `group` is not.
    """
    sets = materialize(document_sets(docs, id_col, text_col, size, percent), "jaccard-docs")
    firsts = sets.filter(F.col("signature").isNotNull()).groupBy("signature").agg(
        F.min("id").alias("least"),
        F.min_by(F.struct(KEY, "n", "parts"), KEY).alias("row"),
    )
    nodes = materialize(
        firsts.select(
            "signature", "least", "row.*", F.monotonically_increasing_id().alias("node")
        ), "jaccard-nodes",
    )
    # Prefixes stay in one table.  A node's row that is repeated only repeats its n-grams.
    grams = sets.join(nodes.select("signature", KEY, "node"), ["signature", KEY]).select(
        "node", "n", F.posexplode("prefix").alias("pos", "gram")
    )
    # One member of each n-gram is its pivot; n-grams with one member end here.  The member
    # with the n-gram nearest to the front has the fewest rarer ones: of copies with edits,
    # the one closest to the original.
    pivots = grams.groupBy("gram").agg(
        F.min(F.struct("pos", "n", "node")).alias("pivot"), F.count("*").alias("members")
    ).filter("members > 1")
    shared = materialize(
        grams.join(pivots.select("gram", "pivot"), "gram"), "jaccard-grams"
    )
    verifier = _Verifier(docs, nodes, id_col, text_col, size, percent)
    tried = groups = None
    for turn in range(rounds):
        pairs = _star_pairs(shared, groups, tried, turn, percent)
        pairs = materialize(pairs, "jaccard-pairs")
        if pairs.isEmpty():
            break
        new = verifier.links(pairs)
        tried = pairs if tried is None else tried.unionByName(pairs)
        groups = materialize(connected_components(new, groups), "jaccard-groups")
    # Also where a round found no pair: that no pivot is left untried says nothing about
    # pairs of other members.
    rest = materialize(_cross_pairs(shared, groups, tried, percent), "jaccard-rest")
    if not rest.isEmpty():
        groups = materialize(connected_components(verifier.links(rest), groups), "jaccard-groups")
    members = nodes.select("signature", "node", "least")
    if groups is not None:
        members = members.join(groups, "node", "left")
    else:
        members = members.withColumn("component", F.lit(None).cast("long"))
    members = members.withColumn("component", F.coalesce("component", "node"))
    least = members.groupBy("component").agg(F.min("least").alias("component_id"))
    classes = members.join(least, "component").select(
        "signature", "component_id", F.col("component").alias("group")
    )
    return sets.select("id", KEY, "n", "signature").join(classes, "signature", "left").select(
        "id", KEY, F.col("n").alias("n_shingles"),
        F.coalesce("component_id", "id").alias("component_id"), "group",
    )


def _with_groups(shared: DataFrame, groups: DataFrame | None) -> DataFrame:
    """`shared` plus the component of each member; a node without links is its own."""
    if groups is None:
        return shared.withColumn("component", F.col("node"))
    return shared.join(groups, "node", "left").withColumn(
        "component", F.coalesce("component", "node")
    )


def _untried(pairs: DataFrame, tried: DataFrame | None) -> DataFrame:
    return pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")


def _star_pairs(shared, groups, tried, turn, percent):
    """For each node the pivot in another component that it shares most n-grams with."""
    rows = _with_groups(shared, groups)
    if turn:
        order = F.col("pos") + F.pmod(F.xxhash64("component", F.lit(turn)), F.lit(2 * turn))
        pivots = rows.groupBy("gram").agg(
            F.min(F.struct(order.alias("o"), "n", "node", "pos", "component")).alias("pivot"),
            F.min("component").alias("low"), F.max("component").alias("high"),
        ).filter("low < high").select("gram", "pivot")
        rows = rows.drop("pivot").join(pivots, "gram").filter("component != pivot.component")
    else:
        rows = rows.filter("node != pivot.node")
    met = rows.select(
        "node", "n", "pos", F.col("pivot.node").alias("other"), F.col("pivot.n").alias("other_n"),
        F.col("pivot.pos").alias("other_pos"),
    ).filter(_passes(percent))
    counted = met.groupBy("node", "other").agg(F.count("*").alias("common"))
    counted = _untried(
        counted.select("node", "other", "common", F.greatest("node", "other").alias("a"),
                       F.least("node", "other").alias("b")), tried,
    )
    best = counted.groupBy("node").agg(F.max(F.struct("common", "a", "b")).alias("p"))
    return best.select("p.a", "p.b").distinct()


def _cross_pairs(shared, groups, tried, percent):
    """All untried pairs across components that share an n-gram and pass the filters."""
    rows = _with_groups(shared, groups)
    mixed = rows.groupBy("gram").agg(
        F.min("component").alias("low"), F.max("component").alias("high")
    ).filter("low < high").select("gram")
    rows = materialize(
        rows.join(mixed, "gram").select("gram", "node", "n", "pos", "component"), "jaccard-mixed"
    )
    other = rows.toDF("gram", "other", "other_n", "other_pos", "other_component")
    met = rows.join(other, "gram").filter(
        (F.col("component") < F.col("other_component")) & _passes(percent)
    )
    pairs = met.select(F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b"))
    return _untried(pairs.distinct(), tried)


def one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are the first of their component, columns unchanged.

    The first is the one with the least id (null before all), then the least key; of rows
    with equal id and text one stays.  Rows without n-grams all stay.
    """
    found = jaccard_components(docs, id_col, text_col, **options)
    own = F.when(F.col("group").isNull(), F.col(KEY)).alias("own")
    kept = found.groupBy("group", own).agg(F.min(F.struct("id", KEY)).alias("first")).select(f"first.{KEY}")
    keyed = docs.withColumn(KEY, row_key(id_col, text_col))
    with_grams = keyed.join(kept, KEY, "left_semi")
    return with_grams.dropDuplicates([KEY]).select(*docs.columns)
