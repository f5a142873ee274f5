"""Removal of long repeated byte strings by suffix arrays.

Every byte covered by a string of `length` bytes that also starts elsewhere, in any
document or the same one, is removed.  Matches lie within documents.

1. *Anchors.*  Each string of `length` bytes is assigned to the least hash among its
   `ANCHOR`-byte substrings, the leftmost of equal ones.  Equal strings have equal
   anchors at equal places.  Consecutive strings with one anchor form a piece; equal
   pieces of a document make one row: anchor, digest of the bytes, where they start.
   An anchor that occurs once in the whole corpus cannot lie in a repeated string; its
   pieces end here.  This drops nothing and leaves the repeated part of the corpus.
2. *Shards.*  Equal pieces become one, with the number of its occurrences, and its bytes
   are cut from one document.  All pieces of an anchor go to one shard, so strings can
   only be equal within shards; an anchor with very many different pieces is spread over
   several.
3. *Suffix arrays.*  A shard orders all suffixes of its pieces (Larsson-Sadakane), takes
   the common prefixes of neighbours (Kasai), and so finds the classes of equal strings.
   A class that occurs twice or more is repeated.
4. *Merging.*  For anchors spread over several shards, each shard hands on a sorted run
   with one entry per class; the runs are split by value and looked up in each other by
   binary search.
5. Repeated strings are brought back to every document that holds their piece.

Nulls and empty texts have no bytes.  Rows with equal id and text are separate texts
that repeat each other; each gets the same result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.arrow import text_blocks, text_bytes, whole_groups
from tallyforge.llm.hashing import mix
from tallyforge.llm.suffix_array import common_prefixes, suffix_array
from tallyforge.sources.scratch import materialize

LENGTH = 400
ANCHOR = 64
#: Pieces per shard: at most twice so many, of less than 2 * LENGTH bytes each.
SHARD_PIECES = 1000
#: Bytes hashed at once; a longer text is walked in overlapping parts.
SEGMENT = 4 << 20
_PLACE_BITS = np.uint64(24)
_PLACE = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def substring_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes from each position."""
    n = len(data)
    up, down = _power_tables(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=total[1:])
    return mix((total[size:] - total[: n + 1 - size]) * down[: n + 1 - size])


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` consecutive values."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def pieces(data: np.ndarray, offsets: np.ndarray, length: int, anchor: int):
    """Anchor hash, first string and number of strings of each piece of a block."""
    n = len(data)
    found = []
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    inside, begins = np.ones(n, bool), np.zeros(n, bool)
    for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        inside[max(start, end - length + 1) : end] = False
        if start < end:
            begins[start] = True
    for low in range(0, max(n - length + 1, 0), SEGMENT):
        part = data[low : low + SEGMENT + length - 1]
        hashes = substring_hashes(part, anchor)
        place = np.arange(len(hashes), dtype=np.uint64)
        least = _sliding_least((hashes & ~_PLACE) | place, length - anchor + 1)
        at = (least & _PLACE).astype(np.int64)
        own = inside[low : low + len(at)]
        new = begins[low : low + len(at)].copy()
        new[0] = True
        new[1:] |= (at[1:] != at[:-1]) | (own[1:] != own[:-1])
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(at)))
        keep = own[starts]
        starts, counts = starts[keep], counts[keep]
        found.append((hashes[at[starts]], starts + low, counts, owner[starts + low]))
    if not found:
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def piece_rows(docs: DataFrame, length: int, anchor: int) -> DataFrame:
    """A row per document and distinct piece: id, text_hash, anchor, digest (two numbers),
    strings (how many start in it), starts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            data, offsets = text_bytes(block.column("text"))
            raw = data.tobytes()
            rows: dict[tuple, list[int]] = {}
            for h, start, count, owner in zip(
                *(x.tolist() for x in pieces(data, offsets, length, anchor)), strict=True
            ):
                digest = xxhash.xxh3_128_digest(raw[start : start + count + length - 1])
                rows.setdefault((owner, h, count, digest), []).append(start - int(offsets[owner]))
            owners = pa.array([k[0] for k in rows], pa.int64())
            digests = np.frombuffer(b"".join(k[3] for k in rows), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("id").take(owners), block.column("text_hash").take(owners),
                    pa.array(np.array([k[1] for k in rows], np.uint64).view(np.int64)),
                    pa.array(digests[:, 0]), pa.array(digests[:, 1]),
                    pa.array([k[2] for k in rows], pa.int32()),
                    pa.array(list(rows.values()), pa.list_(pa.int32())),
                ],
                ["id", "text_hash", "anchor", "d1", "d2", "strings", "starts"],
            )

    id_type = docs.schema["id"].dataType.simpleString()
    return docs.mapInArrow(
        run, f"id {id_type}, text_hash bigint, anchor bigint, d1 bigint, d2 bigint,"
        " strings int, starts array<int>",
    )


def shard_classes(
    texts: list[bytes], strings: np.ndarray, weights: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Piece and offset of every string of the shard in suffix order, the class it is in,
    and the number of occurrences of each class."""
    data = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes) - sizes
    ends = np.repeat(begins + sizes, sizes)
    order, rank = suffix_array(data, ends)
    common = common_prefixes(data, ends, order, rank, begins, strings)
    owner = np.repeat(np.arange(len(texts)), sizes)
    offset = np.arange(len(data)) - begins[owner]
    # Suffixes that begin a whole string, in suffix order.
    whole = order[offset[order] < strings[owner[order]]]
    new = common[whole] < length
    if len(new):
        new[0] = True
    group = np.cumsum(new) - 1
    total = np.bincount(group, weights[owner[whole]], minlength=0).astype(np.int64)
    return owner[whole], offset[whole], group, total


def _runs(owner: np.ndarray, offset: np.ndarray, length: int) -> Iterator[tuple[int, list[dict]]]:
    """Byte ranges covered by the given strings, for each piece."""
    if not len(owner):
        return
    at = np.lexsort((offset, owner))
    owner, offset = owner[at], offset[at]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (offset[1:] > offset[:-1] + length)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(owner)) - 1
    spans: dict[int, list[dict]] = {}
    for o, a, b in zip(owner[first].tolist(), offset[first].tolist(), offset[last].tolist(), strict=True):
        spans.setdefault(o, []).append({"first": a, "last": b + length})
    yield from spans.items()


_RUNS = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
_PIECE_SCHEMA = "anchor bigint, d1 bigint, d2 bigint, runs array<struct<first:int,last:int>>"
_RUN_FIELDS = ("pieces", "owner", "offset", "marks", "alone")
_SHARD_SCHEMA = (
    f"{_PIECE_SCHEMA}, shard int, slice int, " + ", ".join(f"{c} binary" for c in _RUN_FIELDS)
)
#: Shards whose runs one merging task takes a slice of.
SHARDS_PER_SLICE = 4


def _sorted_runs(marks: np.ndarray, slices: int) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of each slice of the 128-bit marks, ascending."""
    order = np.argsort(marks)
    lead = np.frombuffer(marks.tobytes(), ">u8")[::2][order]
    slice_of = (lead >> np.uint64(32)) * np.uint64(slices) >> np.uint64(32)
    cuts = np.searchsorted(slice_of, np.arange(slices + 1, dtype=np.uint64))
    for k, (low, high) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if low < high:
            yield k, order[low:high]


def _one_each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first row of each piece, of rows sorted by piece."""
    last = None
    for batch in batches:
        keys = np.stack([batch.column(c).to_numpy() for c in ("anchor", "d1", "d2")], axis=1)
        new = np.ones(len(keys), bool)
        new[1:] = (keys[1:] != keys[:-1]).any(axis=1)
        if last is not None and len(keys):
            new[0] = (keys[0] != last).any()
        if len(keys):
            last = keys[-1].copy()
        if new.any():
            yield batch.filter(pa.array(new))


def _shard(length: int):
    """Covered ranges of each piece; for spread anchors also the shard's sorted runs, one
    row per slice of values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(_one_each(batches), ["anchor", "shard"], SHARD_PIECES):
            texts = table.column("piece").to_pylist()
            strings = table.column("strings").to_numpy().astype(np.int64)
            weights = table.column("weight").to_numpy().astype(np.int64)
            shards = table.column("shards").to_numpy()
            anchors, shard = table.column("anchor").to_numpy(), table.column("shard").to_numpy()
            digests = np.stack([table.column(c).to_numpy() for c in ("d1", "d2")], axis=1)
            owner, offset, group, total = shard_classes(texts, strings, weights, length)
            repeated = total[group] > 1
            covered = list(_runs(owner[repeated], offset[repeated], length))
            rows = [
                (int(anchors[o]), *digests[o].tolist(), spans, None, None, *[None] * len(_RUN_FIELDS))
                for o, spans in covered
            ]
            first = np.ones(len(group), bool)
            first[1:] = group[1:] != group[:-1]
            open_rows = np.flatnonzero(first & (shards[owner] > 1))
            part = np.searchsorted(starts, owner[open_rows], "right")
            for p in np.unique(part).tolist():
                own = open_rows[part == p]
                low, high = int(starts[p - 1]), int(starts[p])
                marks = np.array([
                    xxhash.xxh3_128_digest(texts[o][a : a + length])
                    for o, a in zip(owner[own].tolist(), offset[own].tolist(), strict=True)
                ], "S16")
                slices = -(-int(shards[low]) // SHARDS_PER_SLICE)
                for k, at in _sorted_runs(marks, slices):
                    rows.append((
                        int(anchors[low]), None, None, None, int(shard[low]), k,
                        digests[low:high].tobytes(),
                        (owner[own[at]] - low).astype("<i4").tobytes(),
                        offset[own[at]].astype("<i4").tobytes(),
                        marks[at].tobytes(),
                        (total[group[own[at]]] < 2).tobytes(),
                    ))
            yield _batch(rows, True)

    return run


def _batch(rows: list[tuple], with_runs: bool) -> pa.RecordBatch:
    fields = [("anchor", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64()), ("runs", _RUNS)]
    if with_runs:
        fields += [("shard", pa.int32()), ("slice", pa.int32()), *[(c, pa.binary()) for c in _RUN_FIELDS]]
    return pa.RecordBatch.from_arrays(
        [pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], [n for n, _ in fields]
    )


def _merge(length: int):
    """Ranges of strings that another shard's run holds too, found by binary search."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["anchor", "slice"], 16):
            anchors = table.column("anchor").to_pylist()
            columns = {c: table.column(c).to_pylist() for c in _RUN_FIELDS}
            out = []
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                runs = [np.frombuffer(m, "S16") for m in columns["marks"][low:high]]
                seen, at_run, at_row = runs[0][:0], np.zeros(0, np.int64), np.zeros(0, np.int64)
                hits = [np.zeros(len(r), bool) for r in runs]
                for k, marks in enumerate(runs):
                    at = np.searchsorted(seen, marks)
                    same = np.zeros(len(marks), bool)
                    if len(seen):
                        near = np.minimum(at, len(seen) - 1)
                        same = seen[near] == marks
                        hits[k] |= same
                        for j in np.unique(at_run[near[same]]).tolist():
                            found = near[same][at_run[near[same]] == j]
                            hits[j][at_row[found]] = True
                    # What is new is merged in, so that each run is searched once.
                    new = np.flatnonzero(~same)
                    seen = np.insert(seen, at[new], marks[new])
                    at_run = np.insert(at_run, at[new], k)
                    at_row = np.insert(at_row, at[new], new)
                for k, hit in enumerate(hits):
                    row = low + k
                    alone = np.frombuffer(columns["alone"][row], bool)
                    wanted = np.flatnonzero(hit & alone)
                    owner = np.frombuffer(columns["owner"][row], "<i4")[wanted].astype(np.int64)
                    offset = np.frombuffer(columns["offset"][row], "<i4")[wanted].astype(np.int64)
                    digests = np.frombuffer(columns["pieces"][row], np.int64).reshape(-1, 2)
                    out += [
                        (anchors[row], *digests[o].tolist(), spans) for o, spans in _runs(owner, offset, length)
                    ]
            yield _batch(out, False)

    return run


def repeated_pieces(docs: DataFrame, length: int, anchor: int) -> tuple[DataFrame, DataFrame]:
    """Rows of pieces with repeated anchors, and the covered ranges of each piece."""
    pieces_of = materialize(piece_rows(docs, length, anchor), "suffix-pieces")
    repeated = pieces_of.groupBy("anchor").agg(F.sum(F.size("starts")).alias("n")).filter("n > 1")
    rows = materialize(pieces_of.join(repeated.select("anchor"), "anchor"), "suffix-repeated")
    piece = ["anchor", "d1", "d2"]
    classes = materialize(
        rows.groupBy(*piece).agg(
            F.sum(F.size("starts")).alias("weight"), F.any_value("strings").alias("strings"),
            F.min(F.struct("id", "text_hash", F.get("starts", F.lit(0)).alias("start"))).alias("at"),
        ), "suffix-classes",
    )
    shards = classes.groupBy("anchor").agg(
        F.ceil(F.count("*") / SHARD_PIECES).cast("int").alias("shards")
    ).filter("shards > 1")
    placed = classes.join(shards, "anchor", "left").withColumn(
        "shards", F.coalesce("shards", F.lit(1))
    ).withColumn("shard", F.pmod(F.xxhash64("d1", "d2"), F.col("shards")).cast("int"))
    # A document's own pieces: fewer than its bytes.
    wanted = placed.groupBy("at.id", "at.text_hash").agg(F.collect_list(F.struct(
        *piece, "strings", "weight", "shards", "shard", F.col("at.start").alias("start")
    )).alias("wanted"))
    texts = docs.select("id", "text_hash", "text").join(
        wanted.withColumnRenamed("id", "__id"),
        F.col("id").eqNullSafe(F.col("__id")) & (docs["text_hash"] == wanted["text_hash"]),
    ).select(F.col("text").cast("binary").alias("bytes"), F.explode("wanted").alias("w"))
    cut = texts.select(
        "w.*", F.expr(f"substring(bytes, w.start + 1, w.strings + {length - 1})").alias("piece")
    )
    # Repeated rows of a text give a piece again; a shard takes it once.
    shard = cut.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard", "d1", "d2")
    found = materialize(shard.mapInArrow(_shard(length), _SHARD_SCHEMA), "suffix-shards")
    merged = (
        found.filter("runs is null").select("anchor", "shard", "slice", *_RUN_FIELDS)
        .repartition("anchor", "slice").sortWithinPartitions("anchor", "slice", "shard")
        .mapInArrow(_merge(length), _PIECE_SCHEMA)
    )
    covered = found.filter("runs is not null").select(*piece, "runs").unionByName(merged)
    # At most one range per string of a piece.
    return rows, covered.groupBy(*piece).agg(F.flatten(F.collect_list("runs")).alias("runs"))


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    length: int = LENGTH, anchor: int = ANCHOR,
) -> DataFrame:
    """A row per row of `docs`: id, `n_bytes`, `spans` (maximal removed byte ranges,
    `first` and `last` exclusive) and `kept` (the remaining bytes)."""
    narrow = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(text_col).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    rows, covered = repeated_pieces(narrow, length, anchor)
    per_text = rows.join(covered, ["anchor", "d1", "d2"]).groupBy("id", "text_hash").agg(
        F.collect_set(F.struct("starts", "runs")).alias("covered")
    ).toDF("__id", "__hash", "covered")
    joined = narrow.join(
        per_text, F.col("id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left"
    ).select("id", "text", "covered")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "text"):
            data, offsets = text_bytes(block.column("text"))
            raw = data.tobytes()
            spans, kept = [], []
            for i, entries in enumerate(block.column("covered").to_pylist()):
                text = raw[offsets[i] : offsets[i + 1]]
                own = _maximal(entries or [])
                spans.append([{"first": a, "last": b} for a, b in own])
                ends = [0, *[b for _, b in own]]
                begins = [*[a for a, _ in own], len(text)]
                kept.append(b"".join(text[a:b] for a, b in zip(ends, begins, strict=True)))
            yield pa.RecordBatch.from_arrays(
                [block.column("id"), pa.array(np.diff(offsets), pa.int64()),
                 pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))),
                 pa.array(kept, pa.binary())],
                ["id", "n_bytes", "spans", "kept"],
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    return joined.mapInArrow(
        cut, f"id {id_type}, n_bytes bigint, spans array<struct<first:bigint,last:bigint>>, kept binary"
    ).withColumnRenamed("id", id_col)


def _maximal(entries: list[dict]) -> list[tuple[int, int]]:
    """Union of the ranges, as ascending maximal ranges."""
    ranges = sorted(
        (start + run["first"], start + run["last"])
        for e in entries for start in e["starts"] for run in e["runs"]
    )
    out: list[list[int]] = []
    for a, b in ranges:
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]
