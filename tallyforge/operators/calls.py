"""Plug-in model and judge functions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Columns an answering function adds.
ANSWER_FIELDS = (
    T.StructField("response", T.StringType()),
    T.StructField("input_tokens", T.LongType()),
    T.StructField("output_tokens", T.LongType()),
)


def call_models(
    requests: DataFrame, answer: Callable[[pd.DataFrame], pd.DataFrame]
) -> DataFrame:
    """Answer each request row with a user's function, one Arrow batch at a time.

    `answer` takes a batch of request rows and returns `response`, `input_tokens` and
    `output_tokens` for each.  Partitions run in parallel; the result carries what
    the call log needs.
    """
    schema = T.StructType([*requests.schema.fields, *ANSWER_FIELDS])
    names = [f.name for f in ANSWER_FIELDS]

    def answered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            answers = answer(batch)
            yield batch.assign(**{n: answers[n].to_numpy() for n in names})

    return requests.mapInPandas(answered, schema)
