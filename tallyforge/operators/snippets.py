"""Per-snippet aggregates of recorded tool tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def avg_complexity(snippets: DataFrame, blocks: DataFrame, key: str = "snippet_id") -> DataFrame:
    """Mean block complexity of each snippet; 0 where it has no blocks."""
    means = blocks.groupBy(key).agg(F.avg("complexity").alias("avg_complexity"))
    return snippets.join(means, key, "left").withColumn(
        "avg_complexity", F.coalesce("avg_complexity", F.lit(0.0))
    )


def finding_count(snippets: DataFrame, findings: DataFrame, key: str = "snippet_id") -> DataFrame:
    """Number of scanner findings of each snippet, from a table of findings."""
    counts = findings.groupBy(key).agg(F.count("*").cast("int").alias("security_issues"))
    return snippets.join(counts, key, "left").withColumn(
        "security_issues", F.coalesce("security_issues", F.lit(0))
    )
