"""Registered queries of this subpackage: thin digests of its operators' results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import knn_quality, toxicity
from tallyforge.llm.bpe import encode_texts, read_tokenizer
from tallyforge.llm.centroids import cluster_vectors, with_inertia
from tallyforge.llm.chat_format import format_chats, read_learned, read_turns
from tallyforge.llm.edit_match import match_items
from tallyforge.llm.jaccard_join import jaccard_components
from tallyforge.llm.labelled import id_remainder
from tallyforge.llm.license_scan import scan_licenses
from tallyforge.llm.line_chunks import dedup_lines
from tallyforge.llm.phrases import mine_phrases
from tallyforge.llm.sharding import shard_documents
from tallyforge.llm.suffix_dedup import remove_repeats
from tallyforge.llm.vector_lsh import near_vectors
from tallyforge.operators.binding import bind

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op2_jaccard(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    found = jaccard_components(docs, size=3, percent=90)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


@query
def op3_line_chunks(spark: SparkSession, sf: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf, "documents").select("doc_id", "text"))
    return kept.select(
        "doc_id", "n_lines", "n_removed_lines",
        F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query
def op4_bpe(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    coded = encode_texts(docs, read_tokenizer(tokenizer_path()))
    return coded.select(
        "doc_id", "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op5_licenses(spark: SparkSession, sf: str) -> DataFrame:
    found = scan_licenses(_table(spark, sf, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_words",
        F.size("base_starts").cast("bigint").alias("n_base"),
        F.array_min("base_starts").alias("first_word"),
        F.array_max("base_starts").alias("last_word"),
        F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


@query
def op10_sharding(spark: SparkSession, sf: str) -> DataFrame:
    placed = shard_documents(_table(spark, sf, "documents"), shards=16)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def _predicted(scored: DataFrame, held_out) -> DataFrame:
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


@query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 3) == 1
    model = toxicity.fit(docs, _table(spark, sf, "labels"), ~held_out)
    return _predicted(toxicity.score_toxicity(docs, model), held_out)


@query
def op7_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return near_vectors(_table(spark, sf, "embeddings"))


@query
def op8_quality(spark: SparkSession, sf: str) -> DataFrame:
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    held_out = id_remainder("doc_id", 4) == 2
    model = knn_quality.fit(docs, _table(spark, sf, "labels"), ~held_out)
    return _predicted(knn_quality.score_quality(docs, model), held_out)


@query
def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    """A row per document and benchmark item that it holds; clean documents have none."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    matched = match_items(docs, _table(spark, sf, "benchmark"))
    return matched.select("doc_id", F.inline("matches")).select(
        "doc_id", F.col("item").alias("item_id"), "distance", "end"
    )


@query
def op11_centroids(spark: SparkSession, sf: str) -> DataFrame:
    assigned, centroids = cluster_vectors(_table(spark, sf, "embeddings"))
    return with_inertia(assigned, centroids)


@query
def op12_phrases(spark: SparkSession, sf: str) -> DataFrame:
    return mine_phrases(_table(spark, sf, "documents"))


#: The conversation that the query adds: both turns look like another template's marks.
ODD_CHAT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


@query
def op13_chats(spark: SparkSession, sf: str) -> DataFrame:
    turns = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.createDataFrame(ODD_CHAT, "conv_id bigint, turn bigint, role string, text string")
    chats = format_chats(turns.unionByName(odd))
    read = bind(
        chats, turns=read_turns(F.col("formatted")),
        learned=read_learned(F.col("formatted"), F.col("loss_mask")),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
