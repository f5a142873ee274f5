"""Does a snippet compile?  The one scalar check the JVM cannot make."""

from __future__ import annotations

import warnings

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def syntax_ok(code: Column) -> Column:
    """Compile each snippet, an Arrow batch at a time; nothing is ever run."""

    # Nested, so that executors get the code itself and need no copy of the package.
    def compiles(text):
        if text is None:
            return None
        try:
            # Bytes, so that a coding line counts as it does in a file.
            compile(text.encode("utf-8"), "<snippet>", "exec", dont_inherit=True)
        except Exception:
            return False
        return True

    @F.pandas_udf("boolean")
    def check(batch: pd.Series) -> pd.Series:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return batch.map(compiles)

    return check(code)
