"""Evaluation documents: nested rows, JSON text, JSON files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge import schemas
from tallyforge.functions.json_text import indented_json

_BROKEN = "__broken"
#: Fields that a text evaluation never has.
_OTHER_KINDS = ("error", "details", "results", "judge_analysis")
#: Keys of a document in written order, over all kinds.
_KEYS = (
    "prompt", "responses", "results", "scores", "winner", "judge_analysis", "cost_breakdown",
    "error", "details", "prompt_id",
)


def read_documents(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Saved documents of any generation, with `kind` and `file_name`.

    `multi_line` fits one indented document per file; files written by
    `write_documents` hold one document per line and split across tasks.  What is no
    JSON document keeps its row, with kind ``broken`` and its text as `details`.
    """
    docs = (
        spark.read.schema(f"{schemas.EVALUATION_DOC}, {_BROKEN} STRING")
        .option("multiLine", multi_line)
        .option("columnNameOfCorruptRecord", _BROKEN)
        .json(path)
    )
    broken = F.col(_BROKEN).isNotNull()
    return docs.withColumn("details", F.coalesce(_BROKEN, "details")).select(
        *[c for c in docs.columns if c != _BROKEN],
        F.when(broken, F.lit("broken")).otherwise(document_kind()).alias("kind"),
        F.col("_metadata.file_name").alias("file_name"),
    )


def document_kind() -> Column:
    """From the keys a document has; file names say ``code`` for both kinds."""
    return (
        F.when(F.col("error").isNotNull(), F.lit("failed"))
        .when(F.col("results").isNotNull(), F.lit("code"))
        .when(F.col("responses").isNotNull(), F.lit("text"))
    )


def write_documents(documents: DataFrame, path: str, partition: str = "run_ts") -> None:
    """One JSON document per evaluation, partitioned by run.

    The rebalance keeps files of even size: small runs share tasks, a run that holds
    most documents is split over many.
    """
    line = document_line([c for c in documents.columns if c != partition])
    lines = documents.select(partition, line.alias("value"))
    lines.hint("rebalance", partition).write.partitionBy(partition).text(path)


def document_line(columns: Sequence[str]) -> Column:
    """A document as one line of JSON.

    Absent fields stay absent, except that a text evaluation always has its winner,
    which a held verdict may leave null.
    """
    present = F.to_json(F.struct(*columns))
    if not {"responses", "winner"} <= set(columns):
        return present
    fields = [c for c in columns if c not in _OTHER_KINDS and c != "cost_breakdown"]
    nulls = {"ignoreNullFields": "false"}
    whole = F.to_json(F.struct(*fields), nulls)
    if "cost_breakdown" in columns:
        priced = F.to_json(F.struct(*fields, "cost_breakdown"), nulls)
        whole = F.when(F.col("cost_breakdown").isNotNull(), priced).otherwise(whole)
    return F.when(F.col("responses").isNotNull(), whole).otherwise(present)


def as_json(document: Column, pretty: bool = True) -> Column:
    """Any struct as JSON text with two-space indent; absent fields stay absent.

    Values held as VARIANT are written on one line with sorted keys; for whole
    evaluation documents see `document_text`.
    """
    return F.to_json(document, {"pretty": "true"} if pretty else {})


def document_text(columns: Sequence[str]) -> Column:
    """A document of any kind as indented JSON text, its keys in written order.

    `columns` are those of the documents.  `scores_text` and `judge_analysis_text`, where
    present, hold those two values as the judge wrote them and keep their order of keys;
    a VARIANT alone is written with sorted keys.  Absent fields stay absent; the winner
    of a text evaluation is written even when null.
    """
    has_responses = F.col("responses").isNotNull() if "responses" in columns else F.lit(False)

    def value(key: str) -> Column:
        held = F.col(key)
        if key in ("scores", "judge_analysis"):
            text = F.to_json(held)
            written = f"{key}_text"
            return F.coalesce(F.when(held.isNotNull(), F.col(written)), text) if written in columns else text
        if key in ("responses", "results", "cost_breakdown"):
            return F.to_json(held)
        # A string between the brackets of a list.
        listed = F.to_json(F.array(held.cast("string")))
        token = F.when(held.isNotNull(), F.substring(listed, F.lit(2), F.length(listed) - 2))
        if key == "winner":
            return F.when(has_responses, F.coalesce(token, F.lit("null"))).otherwise(token)
        return token

    fields = [
        F.concat(F.lit(f'"{key}":'), value(key)) for key in _KEYS if key in columns
    ]
    return indented_json(F.concat(F.lit("{"), F.concat_ws(",", *fields), F.lit("}")))
