"""Where intermediate tables go."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; a temporary one only in local mode."""
    root = spark.conf.get(_CONF, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_CONF} to a folder all executors share")
    return os.path.join(tempfile.gettempdir(), "tallyforge")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the scratch root."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


#: For rows of a megabyte: the writer looks at a page's and a row group's size after each
#: row.  It would gather a hundred of them first, and pages are packed and unpacked whole.
WIDE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.block.size.row.check.min": "1"}


def materialize(
    table: DataFrame, name: str, compression: str | None = None, wide: bool = False,
    path: str | None = None,
) -> DataFrame:
    """Write once, read back: cuts lineage and survives the loss of executors.

    With a `path` of `scratch_path` the caller can `discard` the table before the job ends.
    """
    spark = table.sparkSession
    path = path or scratch_path(spark, name)
    table.write.options(**(WIDE_ROWS if wide else {})).parquet(path, compression=compression)
    return spark.read.schema(table.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that nothing reads any more."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
