"""Bounded samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_remainder(id_col: str, modulus: int) -> Column:
    """CRC-32 of the id as text, modulo `modulus`; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % modulus


def sampled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(`__text`, label) of the sampled ids, thus no more rows than `sample` has.

    Of an id that stands in several rows, the text with the least hash is taken.
    """
    chosen = docs.select(id_col, F.col(text_col).alias("__text")).join(F.broadcast(sample), id_col)
    return chosen.groupBy(id_col).agg(
        F.min(F.struct(F.xxhash64("__text").alias("hash"), "__text", "label")).alias("one")
    ).select("one.__text", "one.label")


def sample_labels(
    labels: DataFrame, id_col: str, label_col: str, learn: Column, per_class: int
) -> DataFrame:
    """At most `per_class` ids of each label 0 and 1, chosen by hash: `id_col`, `label`.

    Rows with a null id or label are left out.  An id that is labelled twice counts with
    its greatest label.
    """
    rows = (
        labels.filter(learn & F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1))
        .groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
        .withColumn("__order", F.xxhash64(id_col))
    )
    parts = [
        rows.filter(F.col("label") == y).orderBy("__order", id_col).limit(per_class)
        for y in (0, 1)
    ]
    return parts[0].unionByName(parts[1]).select(id_col, "label")
