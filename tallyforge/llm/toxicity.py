"""Toxicity by a linear classifier that identity terms cannot sway.

A text is the set of its lower-cased words, hashed to cells.  A logistic model is
fitted on a bounded sample of labelled rows (`LABELLED_PER_CLASS` of each label) by
accelerated proximal gradient with an L1 penalty.  For each labelled text that names a
group, counterfactuals swap every identity term for the next one of its category, and for
no term at all; the squared change of the score is penalised for both.  A neutral
mention then gets no weight of its own, whatever company it keeps in the sample.

The weights have a fixed size and are broadcast; scoring needs no shuffle.  Nulls and
empty texts score as a text without words.  Without labelled rows of both kinds every
text gets the smoothed share of label 1.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.arrow import lower_ascii, text_blocks, text_bytes, word_spans
from tallyforge.llm.hashing import word_hashes
from tallyforge.llm.labelled import sample_labels, sampled_texts

LABELLED_PER_CLASS = 5000
CELL_BITS = 18
L1 = 2e-4
COUNTERFACTUAL = 1.0
STEPS = 800

#: Categories of identity terms; a term is swapped for the next one in its row.
IDENTITY_TERMS = (
    ("women", "men"), ("woman", "man"), ("girls", "boys"), ("girl", "boy"),
    ("female", "male"), ("gay", "straight"), ("lesbian", "heterosexual"),
    ("transgender", "cisgender"), ("homosexual", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "arab", "mexican", "chinese", "indian"),
    ("immigrant", "citizen"), ("immigrants", "citizens"),
    ("disabled", "blind", "deaf"), ("old", "young"), ("elderly", "teenage"),
    ("frauen", "männer"), ("femmes", "hommes"), ("mujeres", "hombres"),
    ("juden", "christen", "muslime"), ("juifs", "chrétiens", "musulmans"),
    ("judíos", "cristianos", "musulmanes"),
)

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_SHIFT = np.uint64(64 - CELL_BITS)


def _cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> _SHIFT).astype(np.int64)


def word_cells(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct cells of each text in one array, and where each text's cells start."""
    data = lower_ascii(data)
    starts, ends, first = word_spans(_IS_WORD[data], offsets)
    owner = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(first))
    keys = np.sort((owner << CELL_BITS) | _cells(word_hashes(data, starts, ends)))
    if len(keys):
        keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    bounds = np.searchsorted(keys, np.arange(len(offsets), dtype=np.int64) << CELL_BITS)
    return keys & ((1 << CELL_BITS) - 1), bounds


def term_cell(term: str) -> int:
    data = np.frombuffer(term.encode(), np.uint8)
    return int(_cells(word_hashes(data, np.array([0]), np.array([len(data)])))[0])


def swapped_cells() -> dict[int, int]:
    """Cell of each identity term to the cell of the one it is swapped for."""
    return {
        term_cell(a): term_cell(b)
        for row in IDENTITY_TERMS for a, b in zip(row, (*row[1:], row[0]), strict=True)
    }


class Rows(NamedTuple):
    """Sparse rows: cells and values of all rows, and where each row starts."""

    cells: np.ndarray
    values: np.ndarray
    bounds: np.ndarray

    def times(self, w: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0.0], np.cumsum(w[self.cells] * self.values)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def back(self, r: np.ndarray, width: int) -> np.ndarray:
        each = np.repeat(r, np.diff(self.bounds)) * self.values
        return np.bincount(self.cells, each, minlength=width)


def counterfactual_rows(
    rows: Rows, scale: np.ndarray, swap: dict[int, int]
) -> Rows:
    """Text minus each of its counterfactuals, for each row that names a group."""
    named = np.flatnonzero(np.isin(rows.cells, np.fromiter(swap, np.int64)))
    cells, values, bounds = [], [], [0]
    for row in np.unique(np.searchsorted(rows.bounds, named, "right") - 1):
        own = set(rows.cells[rows.bounds[row] : rows.bounds[row + 1]].tolist())
        terms = {c for c in own if c in swap}
        for instead in ({swap[c] for c in terms}, set()):
            other = (own - terms) | instead
            for c in own - other:
                cells.append(c)
                values.append(scale[c])
            for c in other - own:
                cells.append(c)
                values.append(-scale[c])
            bounds.append(len(cells))
    return Rows(np.array(cells, np.int64), np.array(values, float), np.array(bounds))


class Model(NamedTuple):
    weights: np.ndarray
    bias: float

    def score(self, cells: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        rows = Rows(cells, np.ones(len(cells)), bounds)
        margin = np.clip(rows.times(self.weights) + self.bias, -30, 30)
        return 1 / (1 + np.exp(-margin))


def fit_rows(
    cells: np.ndarray, bounds: np.ndarray, y: np.ndarray,
    l1: float = L1, counterfactual: float = COUNTERFACTUAL, steps: int = STEPS,
) -> Model:
    """Logistic regression with L1 and counterfactual penalties, by FISTA.

    Cells are scaled by their inverse document frequency in the sample, so that very
    common words neither dominate the step size nor the score.
    """
    n, weights = len(y), np.zeros(1 << CELL_BITS, np.float32)
    if n == 0 or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return Model(weights, float(np.log(share / (1 - share))))
    # A word of one sampled text alone says nothing about others.
    kept = np.bincount(cells, minlength=len(weights))[cells] > 1
    bounds = np.concatenate([[0], np.cumsum(kept)])[bounds]
    cells = cells[kept]
    # Work with the cells that occur or are swapped in, numbered from 0.
    swap = swapped_cells()
    used = np.union1d(cells, np.array([*swap, *swap.values()]))
    number = {int(c): i for i, c in enumerate(used.tolist())}
    swap = {number[a]: number[b] for a, b in swap.items()}
    cells, width = np.searchsorted(used, cells), len(used)
    scale = np.log((1 + n) / (1 + np.bincount(cells, minlength=width)))
    x = Rows(cells, scale[cells], bounds)
    pairs = counterfactual_rows(x, scale, swap)
    m = max(len(pairs.bounds) - 1, 1)
    # One weight per label, so that either half of the sample counts alike.
    each = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())

    def gradient(w, b):
        margin = np.clip(x.times(w) + b, -30, 30)
        r = (1 / (1 + np.exp(-margin)) - y) * each
        g = x.back(r, width)
        if len(pairs.cells):
            g += counterfactual * 2 / m * pairs.back(pairs.times(w), width)
        return g, r.sum()

    probe = np.random.default_rng(3).standard_normal(width)
    top = 1.0
    for _ in range(12):
        image = 0.25 * x.back(x.times(probe) * each, width)
        if len(pairs.cells):
            image += counterfactual * 2 / m * pairs.back(pairs.times(probe), width)
        top = np.linalg.norm(image)
        probe = image / max(top, 1e-12)
    step = 1 / (1.2 * top + 0.25)
    w, b = np.zeros(width), 0.0
    at_w, at_b, t = w, b, 1.0
    for _ in range(steps):
        g, gb = gradient(at_w, at_b)
        new_w = at_w - step * g
        new_w = np.sign(new_w) * np.maximum(np.abs(new_w) - step * l1, 0)
        new_b = at_b - step * gb
        new_t = (1 + np.sqrt(1 + 4 * t * t)) / 2
        at_w = new_w + (t - 1) / new_t * (new_w - w)
        at_b = new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new_w, new_b, new_t
    weights[used] = w * scale
    return Model(weights, float(b))


def fit(
    docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id",
    text_col: str = "text", label_col: str = "toxic", per_class: int = LABELLED_PER_CLASS,
) -> Model:
    """Fit on a bounded sample of the labelled rows for which `learn` holds."""
    sample = sample_labels(labels, id_col, label_col, learn, per_class)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, "__text"):
            cells, bounds = word_cells(*text_bytes(block.column("__text")))
            raw = [cells[a:b].astype("<i4").tobytes() for a, b in zip(bounds, bounds[1:], strict=False)]
            yield pa.RecordBatch.from_arrays(
                [block.column("label"), pa.array(raw, pa.binary())], ["label", "cells"]
            )

    # At most two times `per_class` rows.
    chosen = sampled_texts(docs, sample, id_col, text_col)
    rows = chosen.mapInArrow(run, "label int, cells binary").collect()
    parts = [np.frombuffer(r["cells"], "<i4") for r in rows]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(int)
    cells = np.concatenate(parts).astype(np.int64) if parts else np.zeros(0, np.int64)
    return fit_rows(cells, bounds, np.array([r["label"] for r in rows], float))


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """`docs` plus `score` (0 to 1); an own column of that name is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != "score"]
    schema = T.StructType([*[docs.schema[c] for c in kept], T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for block in text_blocks(batches, text_col):
            scores = model.score(*word_cells(*text_bytes(block.column(text_col))))
            yield pa.RecordBatch.from_arrays(
                [*[block.column(c) for c in kept], pa.array(scores, pa.float64())],
                [*kept, "score"],
            )

    return docs.select(*kept).mapInArrow(run, schema)
