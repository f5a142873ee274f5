"""Recorded responses and call logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions.text import strip


def read_responses(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.RESPONSES).format(fmt).load(path)


def read_call_log(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(schemas.CALL_LOG).format(fmt).load(path)


def read_call_stream(
    spark: SparkSession, path: str, fmt: str = "parquet", horizon: str | None = "1 day",
    files_per_batch: int | None = None,
) -> DataFrame:
    """The call log as it arrives, each call once even where files are delivered again.

    A call is known by (session, call_seq).  Its key is held until the newest timestamp
    is `horizon` ahead of it; what arrives later than that is dropped, as it cannot be
    told from a replay.  Without `horizon` nothing is dropped and nothing is held.
    """
    reader = spark.readStream.schema(schemas.CALL_LOG).format(fmt)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    calls = reader.load(path)
    if horizon is None:
        return calls
    return calls.withWatermark("ts", horizon).dropDuplicatesWithinWatermark(["session_id", "call_seq"])


def responses_from_map(
    documents: DataFrame, key: str = "prompt_id", responses: str = "responses"
) -> DataFrame:
    """``map<model, text>`` to one row per model; the map's order becomes `model_pos`."""
    return documents.select(
        key, F.posexplode(F.map_entries(responses)).alias("model_pos", "entry")
    ).select(
        key, F.col("entry.key").alias("model"), "model_pos",
        F.col("entry.value").alias("response"),
    )


def stripped(responses: DataFrame) -> DataFrame:
    return responses.withColumn("response", strip(F.col("response")))
