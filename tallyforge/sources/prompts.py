"""Prompt batches: JSON arrays of strings, and the single prompt.

A batch file is one JSON array.  `read_prompt_arrays` reads one file with many tasks:
the text source cuts it at quotation marks, by byte ranges, wherever a range begins.  A
mark counts as a string's edge when the text before it ends in an even number of
backslashes; the running number of edges says which pieces lie inside a string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.operators.running import running_sums

_LITERAL = r"(?:null|true|false|-?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"
# What may stand before the first string, between two, after the last, or without any.
_FIRST = rf"\A\s*\[\s*(?:{_LITERAL}\s*,\s*)*\z"
_MIDDLE = rf"\A\s*,\s*(?:{_LITERAL}\s*,\s*)*\z"
_LAST = rf"\A\s*(?:,\s*{_LITERAL}\s*)*\]\s*\z"
_ONLY = rf"\A\s*\[\s*(?:{_LITERAL}\s*(?:,\s*{_LITERAL}\s*)*)?\]\s*\z"

# All that those texts may hold; one with anything else breaks the array.
_OUTER_TEXT = r"\A[\s\[\],0-9.+\-eEnultrfas]*\z"

_FILE, _SEQ, _EDGES, _LITERALS, _OUTER = "__file", "__seq", "__edges", "__literals", "__outer"


def read_prompts(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_idx, prompt) of a batch file, a folder or a glob of batch files.

    Each file is read by one task, which suits many small files; see
    `read_prompt_arrays` for large ones.  Partition columns of the folder (a batch id,
    say) are kept.  A broken file fails the job.
    """
    files = spark.read.text(path, wholetext=True)
    kept = [c for c in files.columns if c != "value"]
    prompts = F.from_json(F.col("value"), "ARRAY<STRING>", {"mode": "FAILFAST"})
    return files.select(*kept, F.posexplode(prompts).alias("prompt_idx", "prompt"))


def read_prompt_arrays(spark: SparkSession, path: str) -> DataFrame:
    """(prompt_idx, prompt) like `read_prompts`, with large files split over tasks.

    Elements are strings, null, booleans or numbers; an array that holds others, or a
    file that is no array, raises ValueError.  Files are checked while the frame is made,
    since that takes a running number over all pieces, which is written once.
    """
    pieces = spark.read.text(path, lineSep='"')
    kept = [c for c in pieces.columns if c != "value"]
    place = F.struct(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    ordered = pieces.select(
        *kept, "value", F.col("_metadata.file_path").alias(_FILE), place.alias(_SEQ),
        (_trailing("value") % 2 == 0).cast("bigint").alias("__edge"),
        F.when(F.col("value").rlike(_OUTER_TEXT), F.col("value")).otherwise(F.lit("?")).alias(_OUTER),
    )
    counted = running_sums(ordered, [_FILE], _SEQ, {_EDGES: (F.col("__edge"), "BIGINT")})
    # Edges before the piece: odd inside a string.
    numbered = counted.withColumn(_EDGES, F.col(_EDGES) - F.col("__edge"))

    def pieced(column: str) -> DataFrame:
        parts = numbered.groupBy(*kept, _FILE, _EDGES).agg(
            F.array_sort(F.collect_list(F.struct(_SEQ, F.col(column).alias("value")))).alias("parts")
        )
        return parts.select(
            *kept, _FILE, _EDGES, (F.col(_EDGES) % 2 == 1).alias("__inside"),
            F.array_join(F.transform("parts", lambda p: p["value"]), '"').alias("value"),
        )

    # The check shuffles no strings.
    outer = pieced(_OUTER)
    outside = outer.filter(~F.col("__inside")).withColumn(_LITERALS, _literals("value"))
    joined = pieced("value")
    if not _checked(outside, outer):
        strings = joined.filter("__inside")
        return strings.select(
            *kept, F.floor(F.col(_EDGES) / 2).cast("int").alias("prompt_idx"),
            _unquoted("value").alias("prompt"),
        )
    # Values that are no strings take a place too.
    values = F.when(F.col("__inside"), F.array(_unquoted("value"))).otherwise(_literals("value"))
    listed = joined.select(*kept, _FILE, _EDGES, values.alias("values"))
    placed = running_sums(listed, [_FILE], _EDGES, {"__count": (F.size("values"), "BIGINT")})
    return placed.select(
        *kept, (F.col("__count") - F.size("values")).alias("__before"),
        F.posexplode("values").alias("__at", "prompt"),
    ).select(*kept, (F.col("__before") + F.col("__at")).cast("int").alias("prompt_idx"), "prompt")


def _trailing(column: str) -> Column:
    """Number of backslashes at the end."""
    return F.length(column) - F.length(F.rtrim(F.col(column), F.lit("\\")))


def _literals(column: str) -> Column:
    found = F.regexp_extract_all(column, F.lit(f"({_LITERAL})"), F.lit(1))
    return F.transform(found, lambda v: F.when(v != "null", v))


def _unquoted(column: str) -> Column:
    text = F.concat(F.lit('["'), F.col(column), F.lit('"]'))
    return F.from_json(text, "ARRAY<STRING>", {"mode": "FAILFAST"})[0]


def _checked(outside: DataFrame, joined: DataFrame) -> int:
    """Number of values that are no strings; fails for a file that is no array."""
    ends = F.col(_EDGES) == 0, F.col("value").contains("]")
    right = (
        F.when(ends[0] & ends[1], F.col("value").rlike(_ONLY))
        .when(ends[0], F.col("value").rlike(_FIRST))
        .when(ends[1], F.col("value").rlike(_LAST))
        .otherwise(F.col("value").rlike(_MIDDLE))
    )
    closed = outside.groupBy(_FILE).agg(
        F.count(F.when(~right, 1)).alias("wrong"),
        F.coalesce(F.max(F.when(ends[1], F.col(_EDGES))), F.lit(-1)).alias("closed"),
        F.sum(F.size(_LITERALS)).alias("literals"),
    )
    last = joined.groupBy(_FILE).agg(F.max(_EDGES).alias("last"))
    whole = last.join(closed, _FILE, "left")
    found = whole.agg(
        F.min(F.when(~(F.coalesce("wrong", F.lit(1)) == 0) | (F.col("closed") != F.col("last")), F.col(_FILE)))
        .alias("broken"),
        F.coalesce(F.sum("literals"), F.lit(0)).alias("literals"),
    ).first()
    if found["broken"] is not None:
        raise ValueError(f"no JSON array of plain values: {found['broken']}")
    return found["literals"]


def write_prompt_arrays(
    prompts: DataFrame, path: str, order: str, text: str = "prompt", file_bytes: int = 64 << 20
) -> None:
    """Arrays of about `file_bytes` each as ``batch=0, 1, ...`` under `path`, in `order`.

    A batch ends with the prompt that fills it, counting each prompt's UTF-8 bytes and
    four for quotes, comma and line.  Every prompt is a row and a line of its own, so no
    task holds a batch as one value.  `order` is unique.
    """
    size = F.coalesce(F.octet_length(text), F.lit(0)) + 4
    summed = running_sums(
        prompts.select(order, text), [], order, {"__bytes": (size, "BIGINT")}
    )
    batched = summed.withColumn(
        "batch", F.floor((F.col("__bytes") - size) / F.lit(file_bytes)).cast("bigint")
    )
    in_batch = Window.partitionBy("batch").orderBy(order)
    quoted = F.to_json(F.array(text))
    line = F.concat(
        F.when(F.row_number().over(in_batch) == 1, "[").otherwise(""),
        F.substring(quoted, F.lit(2), F.length(quoted) - 2),
        F.when(F.lead(F.lit(1)).over(in_batch).isNull(), "]").otherwise(","),
    )
    batched.select("batch", line.alias("value")).write.partitionBy("batch").text(path)


def write_prompt_batches(
    prompts: DataFrame, path: str, batch: str, order: str, text: str = "prompt"
) -> None:
    """One JSON array file per `batch` value, in `order`, for batches of the caller's own.

    A batch is gathered in one row, so it is one file's worth; `write_prompt_arrays` cuts
    batches by size.
    """
    arrays = prompts.groupBy(batch).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct(order, text))), lambda r: r[text]
        ).alias("texts")
    )
    arrays.select(batch, F.to_json("texts").alias("value")).write.partitionBy(batch).text(path)


def single_prompt(spark: SparkSession, prompt: str) -> DataFrame:
    return spark.createDataFrame([(0, prompt)], schemas.PROMPTS)
