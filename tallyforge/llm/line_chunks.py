"""Removal of repeated multi-line chunks, with DataFrame functions only.

A text's lines are hashed.  A line is a boundary at divisor d where the rolling hash over
the last `window` line hashes is divisible by d, and so are a text's first and last line.
A chunk runs from one boundary to the next, both included, at each of several divisors:
at 1 every two neighbouring lines are one, at larger ones some d + 1 lines.  Boundaries
depend on the lines around them alone, so lines put in before a passage do not shift its
chunks.  A line of over `LONG_LINE` words is a chunk of its own.

A chunk of lines needs `CHUNK_CHARS` characters besides white space: a pair of braces or
blank lines is no passage, but a longer run of short lines is one.  A chunk that stands
elsewhere too is kept at its first place, by (id, line), and removed at the others, after
its bytes have been compared with the first one's.  Chunks overlap; the union of the
repeated ones goes.  A removed line has an equal one at an earlier place, so none is lost.

1. One scan makes a short row per chunk; digests are counted with map-side combining.
   A chunk whose pairs are all long enough is covered by them wherever it repeats, so
   divisors above 1 add rows only among short lines.
2. Texts of the documents that hold a repeated digest are cut again, and the pieces of
   later places joined with the first one's, one row per digest on one side, so that a
   hot chunk is a skewed join which Spark splits.
3. Documents are joined with their removed ranges.

Null texts stay null and have no lines; an empty text is one empty line.  Rows with
equal id and text count as one document.  Columns of `docs` keep names and order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.llm.keys import KEY, row_key
from tallyforge.operators.binding import bind
from tallyforge.sources.scratch import materialize

DIVISORS = tuple(range(1, 9))
WINDOW = 2
LONG_LINE = 50
CHUNK_CHARS = 32
_BASE = 31
_SPACE = r"[\x20\x09-\x0D]+"
_WORD = r"[^\x20\x09-\x0D]+"


def line_hash(line: Column) -> Column:
    """The first 32 bits of the line's MD5."""
    return F.conv(F.substring(F.md5(line), 1, 8), 16, 10).cast("bigint")


def _lines(text_col: str) -> Column:
    return F.split(F.col(text_col), "\n", -1)


def _boundaries(hashes: Column, window: int, divisor: int) -> Column:
    """Numbers of the lines where chunks begin and end."""
    last = F.size(hashes) - 1

    def is_boundary(i):
        rolled = F.lit(0).cast("bigint")
        for back in range(window):
            rolled = rolled + F.get(hashes, i - back) * (_BASE ** back)
        return (i == 0) | (i == last) | ((i >= window - 1) & (rolled % divisor == 0))

    return F.filter(F.sequence(F.lit(0), last), is_boundary)


def line_chunks(
    docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW,
    divisors: Sequence[int] = DIVISORS,
) -> DataFrame:
    """A row per chunk: key, id, start, stop (line numbers), digest."""
    rows = docs.filter(F.col(text_col).isNotNull()).select(
        row_key(id_col, text_col).alias(KEY), F.col(id_col).alias("__id"),
        _lines(text_col).alias("__lines"),
    )
    rows = bind(rows, __bound_lines=F.col("__lines"))
    lines = F.col("__bound_lines")
    rows = bind(rows, __chars=F.transform(
        lines, lambda line: F.length(F.regexp_replace(line, _SPACE, ""))
    ))
    chars = F.col("__chars")
    more = [d for d in divisors if d != 1]

    def pair_chars(i):
        return F.get(chars, i) + F.get(chars, i + 1)

    hashes = F.transform(lines, line_hash)
    if 1 in divisors:
        # Texts without a short pair need no other divisor: null here, no chunks there.
        numbers = F.sequence(F.lit(0), F.greatest(F.size(lines) - 2, F.lit(0)))
        short = F.exists(numbers, lambda i: pair_chars(i) < CHUNK_CHARS)
        hashes = F.when((F.size(lines) > 2) & short, hashes)
    rows = bind(rows, __hashes=hashes)
    rows = bind(rows, **{
        f"__at_{d}": F.when(
            F.col("__hashes").isNotNull(), _boundaries(F.col("__hashes"), window, d)
        ) for d in more
    }, __at_1=F.sequence(F.lit(0), F.size(lines) - 1))

    def is_passage(c):
        inside = F.slice(chars, c["start"] + 1, c["stop"] - c["start"] + 1)
        return F.aggregate(inside, F.lit(0), lambda total, n: total + n) >= CHUNK_CHARS

    def has_short_pair(c):
        return F.exists(
            F.sequence(c["start"], c["stop"] - 1), lambda i: pair_chars(i) < CHUNK_CHARS
        )

    def of_divisor(divisor):
        at = F.col(f"__at_{divisor}")

        def chunk(start, k):
            return F.struct(start.alias("start"), F.get(at, k + 1).alias("stop"))

        def is_wanted(c):
            if divisor == 1:
                return c["stop"].isNotNull() & (pair_chars(c["start"]) >= CHUNK_CHARS)
            wanted = c["stop"].isNotNull()
            if 1 in divisors:
                wanted = wanted & (c["stop"] > c["start"] + 1) & has_short_pair(c)
            return wanted & is_passage(c)

        none = F.array().cast("array<struct<start:int,stop:int>>")
        return F.coalesce(F.filter(F.transform(at, chunk), is_wanted), none)

    def single(line, i):
        return F.struct(i.alias("start"), i.alias("stop"))

    def is_long(c):
        line = F.get(lines, c["start"])
        return (F.length(line) > 2 * LONG_LINE) & (F.regexp_count(line, F.lit(_WORD)) > LONG_LINE)

    def with_digest(c):
        piece = F.array_join(F.slice(lines, c["start"] + 1, c["stop"] - c["start"] + 1), "\n")
        return F.struct(c["start"].alias("start"), c["stop"].alias("stop"), F.xxhash64(piece).alias("digest"))

    longs = F.filter(F.transform(lines, single), is_long)
    chunks = F.array_distinct(F.concat(*[of_divisor(d) for d in divisors], longs))
    # Digests are made before the rows, so that no row carries all lines.
    return rows.select(KEY, "__id", F.explode(F.transform(chunks, with_digest)).alias("__c")).select(
        KEY, "__id", "__c.*"
    )


def _united(removed: DataFrame) -> DataFrame:
    """Ranges of lines without overlaps: maximal runs of the lines in any range."""
    lines = removed.select(KEY, F.explode(F.sequence("start", "stop")).alias("line")).distinct()
    # A document's lines at most are in one window.
    run = F.col("line") - F.row_number().over(Window.partitionBy(KEY).orderBy("line"))
    return lines.withColumn("run", run).groupBy(KEY, "run").agg(
        F.min("line").alias("start"), F.max("line").alias("stop")
    )


def repeated_ranges(
    docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW,
    divisors: Sequence[int] = DIVISORS,
) -> DataFrame:
    """Key and `ranges` (start and stop of each run of lines to remove, ascending)."""
    # Repeated rows give each chunk once.
    chunks = materialize(line_chunks(docs, id_col, text_col, window, divisors), "line-chunks")
    first = F.min(F.struct("__id", KEY, "start")).alias("first")
    last = F.max(F.struct("__id", KEY, "start")).alias("last")
    repeated = chunks.groupBy("digest").agg(first, last).filter("first != last")
    candidates = chunks.join(repeated.select("digest", "first"), "digest").select(
        KEY, "start", "stop", "digest",
        ((F.col(KEY) == F.col(f"first.{KEY}")) & (F.col("start") == F.col("first.start")))
        .alias("is_first"),
    )
    # A document's own chunks: a few at most for each of its lines.
    wanted = candidates.groupBy(KEY).agg(
        F.collect_set(F.struct("start", "stop", "digest", "is_first")).alias("__wanted")
    )
    texts = docs.filter(F.col(text_col).isNotNull()).select(
        row_key(id_col, text_col).alias(KEY), F.col(text_col).alias("__text")
    )
    found = bind(
        texts.join(wanted, KEY), __bound_lines=F.split(F.col("__text"), "\n", -1)
    )
    lines = F.col("__bound_lines")

    def with_piece(c):
        piece = F.array_join(F.slice(lines, c["start"] + 1, c["stop"] - c["start"] + 1), "\n")
        return F.struct(
            *[c[n].alias(n) for n in ("start", "stop", "digest", "is_first")], piece.alias("piece")
        )

    pieces = materialize(
        found.select(KEY, F.explode(F.transform("__wanted", with_piece)).alias("__c"))
        .select(KEY, "__c.*"), "line-pieces",
    )
    # Repeated rows repeat the first piece; one is enough.
    firsts = pieces.filter("is_first").groupBy("digest").agg(F.any_value("piece").alias("kept"))
    removed = pieces.filter(~F.col("is_first")).join(firsts, "digest").filter("piece = kept")
    return _united(removed).groupBy(KEY).agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("ranges")
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, divisors: Sequence[int] = DIVISORS,
) -> DataFrame:
    """`docs` with repeated chunks taken out of the text, plus `n_lines` (before) and
    `n_removed_lines`; own columns of these two names are replaced."""
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed_lines")]
    ranges = repeated_ranges(docs, id_col, text_col, window, divisors)
    joined = docs.select(*own, row_key(id_col, text_col).alias(KEY)).join(ranges, KEY, "left")
    bound = bind(joined, __bound_lines=_lines(text_col))
    lines, gone = F.col("__bound_lines"), F.col("ranges")
    n_lines = F.coalesce(F.size(lines), F.lit(0))

    def segment(k):
        start = F.when(k == 0, F.lit(0)).otherwise(F.get(gone, k - 1)["stop"] + 1)
        stop = F.when(k == F.size(gone), F.size(lines)).otherwise(F.get(gone, k)["start"])
        return F.slice(lines, start + 1, stop - start)

    kept = F.array_join(
        F.flatten(F.transform(F.sequence(F.lit(0), F.size(gone)), segment)), "\n"
    )
    count = F.aggregate(
        gone, F.lit(0), lambda total, r: total + r["stop"] - r["start"] + 1
    )
    return bound.select(
        *[
            F.when(gone.isNull(), F.col(text_col)).otherwise(kept).alias(c)
            if c == text_col else F.col(c) for c in own
        ],
        F.when(F.col(text_col).isNull(), 0).otherwise(n_lines).cast("bigint").alias("n_lines"),
        F.coalesce(count, F.lit(0)).cast("bigint").alias("n_removed_lines"),
    )
