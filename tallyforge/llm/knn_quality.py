"""Quality by nearest-neighbour voting among labelled latent-semantic vectors.

Terms are hashed byte trigrams, word shapes and repeated words.  Document frequencies
are counted over all documents (a fixed number of cells per task).  A bounded sample of
labelled documents (`LABELLED_PER_CLASS` of each label) gives, weighted by tf-idf and
reduced by a truncated SVD, the labelled vectors; they and the projection have a fixed
size and are broadcast.  Every document is projected, its cosine with every labelled
vector computed exactly in blocks, and the labels of the nearest `NEIGHBOURS` vote with
a power of their similarity.

Null and empty texts have the zero vector and get `EMPTY_SCORE`.  Without labelled rows
of either kind every document gets the share of label 1 (0.5 with none at all).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.arrow import text_blocks, text_bytes, word_spans
from tallyforge.llm.hashing import word_hashes
from tallyforge.llm.labelled import sample_labels, sampled_texts

LABELLED_PER_CLASS = 2000
TRIGRAM_CELLS = 3072
SHAPE_CELLS = 512
CELLS = TRIGRAM_CELLS + SHAPE_CELLS
#: A word that repeats the one before counts in one of several cells, and documents with
#: at least these shares of such words get terms of their own: one cell would drown.
REPEAT_CELLS = 12
REPEAT_SHARES = (0.02, 0.1, 0.3)
REPEAT_COUNT = 100
RANK = 64
NEIGHBOURS = 25
POWER = 8
EMPTY_SCORE = 0.0

_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
#: Class of a byte within a word: lower case, upper case, digit, other ASCII, not ASCII.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 0, 1, 2, 4


def term_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Documents x cells: how often each cell's terms occur."""
    docs = len(offsets) - 1
    counts = np.zeros((docs, CELLS), np.float32)
    n = len(data)
    if n >= 3:
        owner = np.repeat(np.arange(docs, dtype=np.int64), np.diff(offsets))
        code = data.astype(np.uint32)
        tri = code[:-2] | (code[1:-1] << 8) | (code[2:] << 16)
        cell = ((tri * np.uint32(2654435761)) >> np.uint32(8)) % np.uint32(TRIGRAM_CELLS)
        inside = owner[:-2] == owner[2:]
        key = owner[:-2][inside] * TRIGRAM_CELLS + cell[inside]
        counts[:, :TRIGRAM_CELLS] = np.bincount(
            key, minlength=docs * TRIGRAM_CELLS
        ).reshape(docs, TRIGRAM_CELLS)
    starts, ends, first = word_spans(~_SPACE[data], offsets)
    if len(starts):
        owner = np.repeat(np.arange(docs, dtype=np.int64), np.diff(first))
        kind = _CLASS[data]
        other = np.concatenate([[0], np.cumsum(kind == 3)])
        upper = np.concatenate([[0], np.cumsum(kind == 1)])
        size = ends - starts
        others = other[ends] - other[starts]
        uppers = upper[ends] - upper[starts]
        # First and last class, signs within, share of capitals, length.
        shape = (
            kind[starts] + 5 * kind[ends - 1] + 25 * np.minimum(others, 3)
            + 100 * ((uppers >= 2) + (2 * uppers >= size)) + 300 * (size > 16)
        ).astype(np.int64)
        hashes = word_hashes(data, starts, ends)
        again = np.zeros(len(starts), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        shapes = SHAPE_CELLS - REPEAT_CELLS - len(REPEAT_SHARES)
        key = owner * SHAPE_CELLS + np.where(
            again, shapes + np.arange(len(starts)) % REPEAT_CELLS, shape % shapes
        )
        part = np.bincount(key, minlength=docs * SHAPE_CELLS).reshape(docs, SHAPE_CELLS)
        repeats = part[:, shapes : shapes + REPEAT_CELLS].sum(axis=1)
        share = repeats / np.maximum(np.diff(first), 1)
        for i, least in enumerate(REPEAT_SHARES):
            part[:, shapes + REPEAT_CELLS + i] = REPEAT_COUNT * (share >= least)
        counts[:, TRIGRAM_CELLS:] = part
    return counts


def weighted(counts: np.ndarray, idf: np.ndarray, out: np.ndarray | None = None) -> np.ndarray:
    """Unit rows of (1 + log tf) idf; a row without terms stays zero.  `out` may be `counts`."""
    x = np.log1p(counts, out=out)
    x *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", x, x))
    x /= np.where(norm > 0, norm, 1)[:, None]
    return x


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """In how many documents each cell occurs, and the number of documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros(CELLS, np.int64), 0
        for block in text_blocks(batches, "__text"):
            total += (term_counts(*text_bytes(block.column("__text"))) > 0).sum(axis=0)
            seen += block.num_rows
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(CELLS + 1), pa.int32()), pa.array([*total.tolist(), seen], pa.int64())],
            ["cell", "n"],
        )

    rows = (
        docs.select(F.col(text_col).alias("__text")).mapInArrow(run, "cell int, n long")
        .groupBy("cell").agg(F.sum("n").alias("n")).collect()
    )
    out = np.zeros(CELLS + 1, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out[:CELLS], int(out[CELLS])


def labelled_counts(
    docs: DataFrame, sample: DataFrame, id_col: str, text_col: str
) -> tuple[np.ndarray, np.ndarray]:
    """Term counts and labels of the sampled documents (bounded by the sample)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            counts = term_counts(*text_bytes(block.column("__text")))
            cells = [np.flatnonzero(row) for row in counts]
            raw = [row[at].astype("<u4").tobytes() for row, at in zip(counts, cells, strict=True)]
            cells = [at.astype("<u2").tobytes() for at in cells]
            yield pa.RecordBatch.from_arrays(
                [block.column("label"), pa.array(cells, pa.binary()), pa.array(raw, pa.binary())],
                ["label", "cells", "counts"],
            )

    # At most two times LABELLED_PER_CLASS rows, of each only the cells that occur.
    chosen = sampled_texts(docs, sample, id_col, text_col)
    rows = chosen.mapInArrow(run, "label int, cells binary, counts binary").collect()
    counts = np.zeros((len(rows), CELLS), np.float32)
    for i, r in enumerate(rows):
        counts[i, np.frombuffer(r["cells"], "<u2")] = np.frombuffer(r["counts"], "<u4")
    return counts, np.array([r["label"] for r in rows], np.float32)


class Model(NamedTuple):
    idf: np.ndarray
    axes: np.ndarray  # cells x rank
    vectors: np.ndarray  # labelled x rank, unit rows
    labels: np.ndarray

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Similarity-weighted share of label 1 among the nearest labelled vectors."""
        x = weighted(counts, self.idf)
        out = np.full(len(x), EMPTY_SCORE)
        filled = counts.any(axis=1)
        if not len(self.labels) or self.labels.min() == self.labels.max():
            out[filled] = self.labels.mean() if len(self.labels) else 0.5
            return out
        near = project(x, self.axes) @ self.vectors.T
        k = min(NEIGHBOURS, near.shape[1])
        top = np.argpartition(near, near.shape[1] - k, axis=1)[:, -k:]
        weight = np.maximum(np.take_along_axis(near, top, axis=1), 1e-6).astype(np.float64) ** POWER
        votes = (weight * self.labels[top]).sum(axis=1) / weight.sum(axis=1)
        out[filled] = np.clip(votes[filled], 0, 1)
        return out


def project(x: np.ndarray, axes: np.ndarray) -> np.ndarray:
    z = x @ axes
    norm = np.sqrt(np.einsum("ij,ij->i", z, z))
    return z / np.where(norm > 0, norm, 1)[:, None]


def latent_axes(x: np.ndarray, rank: int, seed: int = 7) -> np.ndarray:
    """Right singular vectors of `x` by a randomised range finder, scaled by nothing."""
    rank = min(rank, *x.shape)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(x @ rng.standard_normal((x.shape[1], rank + 16)).astype(np.float32))[0]
    for _ in range(3):
        q = np.linalg.qr(x.T @ q)[0]
        q = np.linalg.qr(x @ q)[0]
    return np.linalg.svd(q.T @ x, full_matrices=False)[2][:rank].T.astype(np.float32)


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "quality", per_class: int = LABELLED_PER_CLASS,
) -> Model:
    """Fit on labelled rows for which `learn` holds; statistics cover all of `docs`."""
    frequency, n = document_frequencies(docs, text_col)
    sample = sample_labels(labels, id_col, label_col, learn, per_class)
    counts, y = labelled_counts(docs, sample, id_col, text_col)
    idf = np.log((1 + n) / (1 + frequency)).astype(np.float32) + 1
    x = weighted(counts, idf, out=counts)
    axes = latent_axes(x, RANK) if len(x) else np.zeros((CELLS, 1), np.float32)
    return Model(idf, axes, project(x, axes) if len(x) else np.zeros((0, 1), np.float32), y)


def score_quality(
    docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score"
) -> DataFrame:
    """`docs` plus `score_col` (0 to 1); an own column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != score_col]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField(score_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in text_blocks(batches, text_col, max_rows=1024):
            counts = term_counts(*text_bytes(block.column(text_col)))
            yield pa.RecordBatch.from_arrays(
                [*[block.column(c) for c in kept], pa.array(model.score(counts), pa.float64())],
                [*kept, score_col],
            )

    return docs.select(*kept).mapInArrow(run, schema)


def keep_quality(
    docs: DataFrame, model: Model, text_col: str = "text", least: float = 0.7
) -> DataFrame:
    """The rows of `docs` that score `least` or more; columns unchanged."""
    scored = score_quality(docs, model, text_col, "__quality")
    return scored.filter(F.col("__quality") >= least).select(*docs.columns)
