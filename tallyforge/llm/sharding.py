"""Minimax contiguous partition of groups of equal texts into shards.

Groups are ordered by the SHA-256 of their text and never split.  The smallest
capacity with which the ordered group sizes fit into the given number of shards is
found by binary search; a greedy walk checks each capacity.  The walk does not need
all sizes on the driver: it works on blocks of groups that share a hash prefix, and
only the blocks in which a cut can fall for any capacity still in question are opened
one level deeper, until those hold single groups.  Each level brings a bounded number
of block sums, whatever the number of documents.

The cuts follow the capacity found.  Where a group outweighs a fair share (its size is
then the capacity), filling every shard to capacity would starve the last ones, so a
shard is closed at its fair share of what remains whenever the rest still fits.

Nulls and empty texts count as one group of empty texts.  A null id is a row like any
other; repeated ids are placed by repeated rows.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.sources.scratch import materialize

FIRST_DIGITS = 3
MORE_DIGITS = 2


def fits(sizes: list[int], capacity: int, shards: int, start: int = 0) -> bool:
    """True when greedy filling needs at most `shards` shards."""
    used, room = 0, 0
    for size in sizes[start:]:
        if size > capacity:
            return False
        if size > room:
            used, room = used + 1, capacity
            if used > shards:
                return False
        room -= size
    return True


def smallest_capacity(sizes: list[int], shards: int, low: int) -> int:
    """The smallest feasible capacity not under `low`."""
    low = max(low, -(-sum(sizes) // shards), max(sizes, default=0))
    high = max(low, sum(sizes))
    while low < high:
        middle = (low + high) // 2
        if fits(sizes, middle, shards):
            high = middle
        else:
            low = middle + 1
    return low


def cut(sizes: list[int], shards: int, capacity: int) -> list[int]:
    """First block of each shard; a shard without blocks starts where the next does."""
    firsts, at, left = [], 0, sum(sizes)
    for shard in range(shards):
        firsts.append(at)
        after = shards - shard - 1
        if after == 0:
            break
        share, load, fair, end = -(-left // (after + 1)), 0, None, at
        while end < len(sizes) and load + sizes[end] <= capacity:
            load += sizes[end]
            end += 1
            if fair is None and load >= share:
                fair = end
        if fair is not None and fair < end and fits(sizes, capacity, after, fair):
            end = fair
        left -= sum(sizes[at:end])
        at = end
    return firsts


def _open_blocks(blocks: list[tuple], shards: int, low: int, high: int) -> list[str]:
    """Blocks of several groups in which a cut can fall for a capacity in [low, high]."""
    total = sum(b[1] for b in blocks)
    starts, ends, at = [], [], 0
    for _, size, _ in blocks:
        starts.append(at)
        at += size
        ends.append(at)
    near, far, found = 0, 0, set()
    for _ in range(shards - 1):
        near = min(near + low, total)
        # The walk may stop short of `near` by less than the group that does not fit.
        near = max((s for s, e in zip(starts, ends, strict=True) if s <= near < e), default=near)
        far = min(far + high, total)
        found |= {
            b[0] for b, s, e in zip(blocks, starts, ends, strict=True)
            if b[2] > 1 and s <= far and e > near
        }
    return sorted(found)


def shard_starts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """Lowest group key of each shard (shards - 1 cuts) and the capacity found.

    `groups` has `key` (lowercase hexadecimal SHA-256) and `size`, one row per group.
    """
    def sums(frame, digits):
        return [
            (r["block"], int(r["size"]), int(r["n"]))
            for r in frame.groupBy(F.substring("key", 1, digits).alias("block"))
            .agg(F.sum("size").alias("size"), F.count("*").alias("n"))
            .orderBy("block").collect()
        ]

    digits = FIRST_DIGITS
    blocks = sums(groups, digits)
    if not blocks:
        return ["~"] * (shards - 1), 0
    largest = int(groups.agg(F.max("size")).first()[0])
    low = max(-(-sum(b[1] for b in blocks) // shards), largest)
    while True:
        high = smallest_capacity([b[1] for b in blocks], shards, low)
        wanted = _open_blocks(blocks, shards, low, high)
        if not wanted:
            break
        by_length = {}
        for block in wanted:
            by_length.setdefault(len(block), []).append(block)
        digits = min(digits + MORE_DIGITS, 64)
        inside = None
        for length, names in by_length.items():
            test = F.substring("key", 1, length).isin(names)
            inside = test if inside is None else inside | test
        opened = sums(groups.filter(inside), digits)
        blocks = sorted([b for b in blocks if b[0] not in set(wanted)] + opened)
    sizes = [b[1] for b in blocks]
    capacity = smallest_capacity(sizes, shards, low)
    names = [b[0] for b in blocks] + ["~"]
    return [names[i] for i in cut(sizes, shards, capacity)[1:]], capacity


def shard_documents(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of `docs`: `id_col`, size, text_crc32, text_sha256, shard, slot.

    `size` is the UTF-8 length of the text plus 1, `slot` the position within the shard
    by (text_sha256, id), without gaps.  Only these five short columns are shuffled.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = materialize(
        docs.select(
            F.col(id_col),
            (F.octet_length(text).cast("bigint") + 1).alias("size"),
            F.crc32(text).alias("text_crc32"),
            F.sha2(text, 256).alias("text_sha256"),
        ), "shard-rows",
    )
    groups = materialize(
        rows.groupBy(F.col("text_sha256").alias("key")).agg(F.sum("size").alias("size")),
        "shard-groups",
    )
    starts, _ = shard_starts(groups, shards)
    shard = F.lit(0)
    for start in starts:
        shard = shard + (F.col("text_sha256") >= start).cast("int")
    place = F.monotonically_increasing_id()
    ranged = materialize(
        rows.repartitionByRange("text_sha256", id_col)
        .sortWithinPartitions("text_sha256", id_col)
        .withColumn("__part", F.shiftright(place, 33).cast("int"))
        .withColumn("__at", place.bitwiseAND(F.lit((1 << 33) - 1)))
        .withColumn("shard", shard.cast("int")),
        "shard-ranged",
    )
    counts = ranged.groupBy("__part", "shard").agg(F.count("*").alias("n")).collect()
    before, in_part, in_shard, bases = 0, {}, {}, []
    for part, shard_no, n in sorted(tuple(r) for r in counts):
        first_in_part = in_part.setdefault(part, before)
        first_in_shard = in_shard.setdefault(shard_no, before)
        bases.append((part, shard_no, first_in_part - first_in_shard))
        before += n
    # One row per partition and shard that meet: at most partitions + shards rows.
    base = spark.createDataFrame(bases, "__part int, shard int, __base long")
    return (
        ranged.join(F.broadcast(base), ["__part", "shard"])
        .select(
            id_col, "size", "text_crc32", "text_sha256", "shard",
            (F.col("__at") + F.col("__base")).alias("slot"),
        )
    )
