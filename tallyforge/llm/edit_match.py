"""Benchmark decontamination by pigeonhole edit matching.

Texts and items are compared lower-cased with white space folded.  An item of m
characters has an error budget of ``floor(error_rate * m)`` edits.  It is split into
budget + 1 pieces: where a text holds the item within its budget, at least one piece
stands there unchanged, at most that many places from where it should.  All pieces are
looked up in one pass over the text (Aho-Corasick), and around each hit Myers'
bit-parallel algorithm gives the least edit distance of the item to any passage.

Items are read in blocks of bounded size; each block is broadcast and applied to all
rows in turn, in the same stage, so nothing is shuffled and any number of items works.

Null or empty texts and items match nothing.  Equal items are all reported.  An item
shorter than ``1 / error_rate`` characters is matched exactly.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tallyforge.llm.arrow import text_blocks

ERROR_RATE = 0.08
ITEM_BLOCK_BYTES = 4 << 20


def normalized(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def pieces(item: str, budget: int) -> list[tuple[int, str]]:
    """Offset and text of budget + 1 pieces of nearly equal length."""
    n = budget + 1
    cuts = [len(item) * i // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Pattern:
    """An item's bit masks for Myers' algorithm."""

    def __init__(self, item: str):
        self.length = len(item)
        self.masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(item):
            self.masks[c] |= 1 << i
        self.masks = dict(self.masks)

    def best(self, text: str) -> tuple[int, int]:
        """Least edit distance to a passage of `text`, and where the first such ends."""
        m = self.length
        full, high = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score, best, end = full, 0, m, m, 0
        get = self.masks.get
        for i, c in enumerate(text):
            eq = get(c, 0)
            down = eq | minus
            across = (((eq & plus) + plus) ^ plus) | eq
            up = minus | (full & ~(across | plus))
            dn = plus & across
            if up & high:
                score += 1
            elif dn & high:
                score -= 1
                if score < best:
                    best, end = score, i + 1
            up <<= 1
            plus = ((dn << 1) | ~(down | up)) & full
            minus = up & down & full
        return best, end


class Matcher:
    def __init__(self, items: list[tuple[object, str]], error_rate: float):
        self.items = []
        places = defaultdict(list)
        for item_id, text in items:
            item = normalized(text)
            if not item:
                continue
            budget = int(error_rate * len(item))
            for offset, piece in pieces(item, budget):
                places[piece].append((len(self.items), offset))
            self.items.append((item_id, Pattern(item), budget))
        self.search = ahocorasick.Automaton()
        for piece, where in places.items():
            self.search.add_word(piece, (len(piece), where))
        if places:
            self.search.make_automaton()

    def match(self, text: str | None) -> list[tuple[object, int, int]]:
        """(item, distance, end) of each item within its budget; `end` counts characters
        of the normalised text."""
        text = normalized(text)
        if not text or not self.items:
            return []
        windows = defaultdict(list)
        for last, (length, where) in self.search.iter(text):
            for number, offset in where:
                windows[number].append(last + 1 - length - offset)
        found = []
        for number, starts in windows.items():
            item_id, pattern, budget = self.items[number]
            best = None
            merged: list[list[int]] = []
            for start in sorted(starts):
                low, high = max(0, start - budget), start + pattern.length + budget
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = high
                else:
                    merged.append([low, high])
            for low, high in merged:
                distance, end = pattern.best(text[low:high])
                if distance <= budget and (best is None or distance < best[0]):
                    best = (distance, low + end)
            if best:
                found.append((item_id, *best))
        return sorted(found, key=lambda f: (str(f[0]), f[1]))


def item_blocks(
    items: DataFrame, id_col: str, text_col: str, limit: int = ITEM_BLOCK_BYTES
) -> Iterator[list[tuple[object, str]]]:
    """Items in blocks that hash to about `limit` bytes each, one in memory at a time."""
    named = items.filter(F.length(text_col) > 0).select(
        F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    total = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-total // limit)
    for block in range(blocks):
        part = named.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block)
        yield [(r["id"], r["text"]) for r in part.collect()]


def match_items(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", error_rate: float = ERROR_RATE,
) -> DataFrame:
    """`docs` plus `matches`: item, distance and end of each item found in the text.

    An own column `matches` of `docs` is replaced.
    """
    entry = T.StructType([
        T.StructField("item", items.schema[item_id].dataType),
        T.StructField("distance", T.IntegerType()), T.StructField("end", T.LongType()),
    ])
    kept = [c for c in docs.columns if c != "matches"]
    schema = T.StructType(
        [*[docs.schema[c] for c in kept], T.StructField("matches", T.ArrayType(entry))]
    )
    arrow = to_arrow_schema(schema)
    rows = docs.select(*kept, F.array().cast(T.ArrayType(entry)).alias("matches"))
    for block in item_blocks(items, item_id, item_text):
        rows = _apply(rows, block, kept, text_col, schema, arrow, error_rate)
    return rows


def _apply(rows, block, kept, text_col, schema, arrow, error_rate):
    shared = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(shared.value, error_rate)
        names = ("item", "distance", "end")
        for part in text_blocks(batches, text_col):
            before = part.column("matches").to_pylist()
            after = [
                (old or []) + [dict(zip(names, m, strict=True)) for m in matcher.match(text)]
                for old, text in zip(before, part.column(text_col).to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in kept], pa.array(after, arrow.field("matches").type)],
                [*kept, "matches"],
            )

    return rows.mapInArrow(run, schema)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that hold no item within its error budget; columns unchanged."""
    own = "__own_matches"
    named = docs.withColumnRenamed("matches", own)
    clean = match_items(named, items, text_col, **options).filter(F.size("matches") == 0)
    return clean.drop("matches").withColumnRenamed(own, "matches").select(*docs.columns)
