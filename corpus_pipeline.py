"""The corpus pipeline: five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and all
but the last return the columns of `docs`.  `run` writes each stage's result to the
shared scratch folder and rereads it, so no stage is computed twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import knn_quality
from tallyforge.llm.bpe import encode_texts, read_tokenizer
from tallyforge.llm.edit_match import decontaminate
from tallyforge.llm.jaccard_join import one_per_group
from tallyforge.llm.line_chunks import dedup_lines
from tallyforge.llm.queries import tokenizer_path
from tallyforge.sources.scratch import materialize


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = knn_quality.fit(docs, labels, F.lit(True))
    return knn_quality.keep_quality(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated chunks of lines; n_chars follows the text.

    A document of which nothing but white space is left is dropped: all of its text
    stands in other documents.  What had no text before stays.
    """
    aside = {c: f"__own_{c}" for c in ("n_lines", "n_removed_lines") if c in docs.columns}
    kept = dedup_lines(docs.withColumnsRenamed(aside))
    emptied = (F.col("n_removed_lines") > 0) & (F.trim(F.regexp_replace("text", r"\s+", " ")) == "")
    left = kept.filter(~F.coalesce(emptied, F.lit(False))).drop("n_lines", "n_removed_lines")
    left = left.withColumnsRenamed({v: k for k, v in aside.items()})
    return left.select(*[
        F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns
    ])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five words, similarity 0.8."""
    return one_per_group(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) and the hash of the decoded text."""
    coded = encode_texts(docs.select("doc_id", "lang", "source", "text"), read_tokenizer(tokenizer_path()))
    return coded.select(
        "doc_id", "lang", "source", "n_tokens", "token_ids",
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("BPE encoding and decoding", tokens),
]

#: Nearest neighbours, edit distances and token merges are beyond SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i + 1}")
    return docs
