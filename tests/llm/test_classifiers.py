import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyforge.llm import knn_quality, toxicity
from tallyforge.llm.arrow import text_bytes
from tallyforge.llm.queries import QUERIES
from tests.llm.helpers import awkward_rows, frame

BIG = "/root/testdata/sf0.1"


def held_out_rows(spark, name, label, modulus, remainder):
    found = {r["doc_id"]: r for r in QUERIES[name](spark, BIG).collect()}
    assert len(found) == spark.read.parquet(f"{BIG}/documents.parquet").count()
    for i, r in found.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % modulus == remainder)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    labels = spark.read.parquet(f"{BIG}/labels.parquet").collect()
    pairs = [(found[r["doc_id"]]["predicted"], r[label]) for r in labels if found[r["doc_id"]]["held_out"]]
    return np.array(pairs)


def test_quality_on_held_out_labels(spark):
    p, y = held_out_rows(spark, "op8_quality", "quality", 4, 2).T
    assert (p[y == 1] == 1).mean() > 0.98 and (p[y == 0] == 0).mean() > 0.95


def test_toxicity_on_held_out_labels(spark):
    p, y = held_out_rows(spark, "op6_toxicity", "toxic", 3, 1).T
    assert (p[y == 1] == 1).mean() > 0.7 and (p[y == 0] == 0).mean() > 0.99


def cells(texts):
    return toxicity.word_cells(*text_bytes(pa.array(texts)))


@pytest.mark.parametrize("penalty", [0.0, 5.0])
def test_counterfactuals_spare_neutral_mentions(penalty):
    """Insults in the sample often name one group; a neutral mention must not score."""
    rng = np.random.default_rng(0)
    filler = [f"word{i}" for i in range(200)]
    say = lambda *w: " ".join([*rng.choice(filler, 12), *w])
    insults = ["vile", "filthy", "rotten", "nasty", "cruel"]
    bad = [say(insults[i % 5], "muslim") for i in range(200)] + [say(w) for w in insults * 4]
    good = [say() for _ in range(210)] + [say("christian") for _ in range(10)]
    c, b = cells(bad + good)
    y = np.array([1.0] * len(bad) + [0.0] * len(good))
    model = toxicity.fit_rows(c, b, y, counterfactual=penalty)
    mean = lambda *w: model.score(*cells([say(*w) for _ in range(40)])).mean()
    assert mean("vile") > 0.7 > 0.1 > mean("muslim")
    swayed = abs(model.weights[toxicity.term_cell("muslim")])
    assert swayed < 0.1 if penalty else swayed > 1


def test_nearest_neighbours_are_exact():
    rng = np.random.default_rng(1)
    texts = [" ".join(rng.choice(["abc", "de", "xyz", "Q1", "!!"], 30)) for _ in range(60)]
    counts = knn_quality.term_counts(*text_bytes(pa.array(texts)))
    y = (np.arange(60) % 3 > 0).astype(np.float32)
    idf = np.ones(knn_quality.CELLS, np.float32)
    x = knn_quality.weighted(counts, idf)
    axes = knn_quality.latent_axes(x, 16)
    model = knn_quality.Model(idf, axes, knn_quality.project(x, axes), y)
    z = (x @ axes).astype(float)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    for i, score in enumerate(model.score(counts)):
        near = sorted(((z[i] @ z[j], y[j]) for j in range(60)), reverse=True)[: knn_quality.NEIGHBOURS]
        w = [max(c, 1e-6) ** knn_quality.POWER for c, _ in near]
        assert abs(score - sum(a * b for a, (_, b) in zip(w, near)) / sum(w)) < 1e-3


@pytest.mark.parametrize("module,label,score", [
    (knn_quality, "quality", knn_quality.score_quality), (toxicity, "toxic", toxicity.score_toxicity),
])
def test_awkward_rows_and_labels(spark, module, label, score):
    docs = spark.createDataFrame(awkward_rows(), "doc_id bigint, text string, score string")
    schema = f"doc_id bigint, {label} int"
    odd = [(None, 1), (3, None), (4, 0), (4, 1), (5, 0), (1, 1), (2, 0), (999, 1), (6, 7)]
    for labels in ([], [(3, 1)], odd):
        model = module.fit(docs, spark.createDataFrame(labels, schema), F.lit(True), label_col=label)
        out = score(docs, model).collect()
        assert len(out) == len(awkward_rows()) and all(0 <= r["score"] <= 1 for r in out)
    model = module.fit(frame(spark, []), spark.createDataFrame([], schema), F.lit(True), label_col=label)
    assert score(frame(spark, []), model).count() == 0


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_repeated_ids_do_not_widen_the_sample(spark, label):
    from tallyforge.llm.labelled import sample_labels, sampled_texts

    docs = spark.range(3000).select(
        (F.col("id") % 3).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text")
    )
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1)], f"doc_id bigint, {label} int")
    sample = sample_labels(labels, "doc_id", label, F.lit(True), 2)
    rows = sampled_texts(docs, sample, "doc_id", "text").collect()
    assert sorted(r["label"] for r in rows) == [0, 1, 1]


def test_stored_counts_are_not_clipped(spark):
    docs = spark.createDataFrame([(1, "ab " * 90_000), (2, "cd ef")], "doc_id bigint, text string")
    sample = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, label int")
    counts, labels = knn_quality.labelled_counts(docs, sample, "doc_id", "text")
    assert counts[labels == 1].max() > 65535


def test_only_cells_that_occur_go_to_the_driver(spark, monkeypatch):
    rows = [(i, f"some words {i} of a text {i % 7}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    sample = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, label int")
    sent, collect = [], type(docs).collect
    monkeypatch.setattr(type(docs), "collect", lambda self: sent.append(collect(self)) or sent[-1])
    counts, labels = knn_quality.labelled_counts(docs, sample, "doc_id", "text")
    assert sum(len(v) for r in sent[0] for v in r if isinstance(v, (bytes, bytearray))) < 40 * 600
    whole = knn_quality.term_counts(*text_bytes(pa.array([t for _, t in rows])))
    found = sorted((y, *row) for y, row in zip(labels, counts.tolist(), strict=True))
    assert found == sorted((i % 2, *row) for i, row in enumerate(whole.tolist()))
