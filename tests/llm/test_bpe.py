import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

tokenizers = pytest.importorskip("tokenizers")
from tallyforge.llm.bpe import WordTokenizer, decode_ids, encode_texts, read_tokenizer  # noqa: E402
from tallyforge.llm.queries import QUERIES, tokenizer_path  # noqa: E402
from tests.llm.helpers import SF, awkward_rows, frame  # noqa: E402


@pytest.fixture(scope="module")
def both():
    path = tokenizer_path()
    theirs = tokenizers.Tokenizer.from_file(path)
    theirs.no_truncation()
    theirs.no_padding()
    return WordTokenizer(read_tokenizer(path)), theirs


def same(both, text):
    mine, theirs = both
    ids = theirs.encode(text, add_special_tokens=False).ids
    coded = mine.encode(text)
    assert np.frombuffer(coded, "<u4").tolist() == ids
    assert mine.decode(coded) == theirs.decode(ids, skip_special_tokens=False)


@pytest.mark.parametrize("text", [
    "", " ", "Hello  World's don't I'LL 're", "ÀÉÎ straße İstanbul ΣΑΣ ΟΔΟΣ", "é ﬁ Ω",
    "a\x1cb\x1dc d\x85e f\xa0g", "<|startoftext|>Hi<|endoftext|> x<|endoftext|", "１２３ ½ ²x 漢字かな 🙂🙂👩‍👩‍👧",
    "a" * 3000, "!" * 500 + "ab1" * 200, "힣가 İı", "x​y ﻿ z᠎",
])
def test_like_the_library(both, text):
    same(both, text)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_random_texts(both, text):
    same(both, text)


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abcdeinthr ", min_size=50, max_size=300))
def test_long_and_short_merges_agree(both, text):
    mine, _ = both
    for word in text.split():
        parts = [mine.first[b] for b in word.encode()[:-1]] + [mine.last[word.encode()[-1]]]
        assert mine.merge(parts) == mine._merge_long(parts)


def test_query_over_all_documents(spark, both):
    _, theirs = both
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op4_bpe"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        text = theirs.decode(ids, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_awkward_rows(spark, both):
    content = read_tokenizer(tokenizer_path())
    rows = spark.createDataFrame(awkward_rows(), "doc_id bigint, text string, decoded string")
    out = encode_texts(rows, content)
    assert out.columns == ["doc_id", "token_ids", "n_tokens", "decoded"]
    found = out.collect()
    assert len(found) == len(awkward_rows())
    assert all(r["n_tokens"] == 0 and r["decoded"] == "" for r in found if r["doc_id"] in (1, 2, 9))
    again = decode_ids(out.select("doc_id", "token_ids", "decoded"), content).collect()
    assert sorted(map(str, again)) == sorted(str(r) for r in out.select("doc_id", "token_ids", "decoded").collect())
    assert encode_texts(frame(spark, []), content).count() == 0
