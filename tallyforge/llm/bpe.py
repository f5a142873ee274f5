"""Byte-pair encoding and decoding with a contiguous rank array.

A word's parts are held as a list of boundaries beside a list with the rank of each
adjacent pair.  The smallest rank is found by scanning, its boundary deleted, and the
two neighbouring ranks looked up again.  That is quadratic in the word length but
fastest on the short words of prose; a word of more than `LONG` parts is merged with a
heap over a linked list instead, which gives the same parts.

The tokenizer file is that of the `tokenizers` library for a word-level BPE model: NFC,
white space folded, lower case, a splitting pattern, bytes as printable characters and
an end-of-word suffix.  Words that stand apart by white space do not influence each
other, so each distinct one is encoded once per task; the memory is emptied when it
holds `MEMORY` words.

Nulls and empty texts give no ids and an empty text.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.arrow import text_blocks

LONG = 64
MEMORY = 400_000
_NONE = 1 << 60
#: Unicode White_Space.
_SPACE = r"\t-\r\x20\x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
_SPACES = regex.compile(f"[{_SPACE}]+")
#: Code points (first, last) that this `regex` counts as letters or numbers
#: and the tokenizer library, whose tables are those of Unicode 16, does not.
_NOT_LETTERS = (
    (0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC),
    (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4),
    (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF),
    (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A),
    (0x11DB0, 0x11DDB), (0x11DF1, 0x11DF1), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3),
    (0x16FF2, 0x16FF3), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20),
    (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128),
    (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81),
    (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2),
    (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF),
    (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479),
    (0x3D000, 0x3FC3F),
)
_NOT_NUMBERS = (
    (0x11DE0, 0x11DE9), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686),
    (0x16FF4, 0x16FF6),
)
#: Capitals (first, last, distance to the small letter) that the library
#: knows and this Python's tables do not.
_MORE_CAPITALS = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1),
    (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1), (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561),
    (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)
_LOWER = {c: c + d for a, b, d in _MORE_CAPITALS for c in range(a, b + 1)}
_CAPITALS = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b, _ in _MORE_CAPITALS) + "]")


def _class(name: str, without: tuple) -> str:
    """A character class less some ranges, as a set that nests in others."""
    return rf"[\p{{{name}}}--[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in without) + "]]"


def byte_characters() -> list[str]:
    """The printable character for each byte in byte-level vocabularies."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for byte in range(256):
        out.append(chr(byte if byte in printable else spare))
        spare += byte not in printable
    return out


class WordTokenizer:
    """Encodes and decodes by a tokenizer file's content."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec["model"]
        self.vocab = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max(*self.vocab.values(), *added.values(), 0) + 1)
        for token, i in [*self.vocab.items(), *added.items()]:
            self.strings[i] = token
        self.added = added
        self.added_pattern = (
            regex.compile("(" + "|".join(regex.escape(t) for t in added) + ")") if added else None
        )
        self.merges = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[(self.vocab[left], self.vocab[right])] = (rank, self.vocab[left + right])
        pattern = next(
            p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"]
            if p["type"] == "Split"
        )
        for name, own in (
            (r"\s", f"[{_SPACE}]"), (r"\p{L}", _class("L", _NOT_LETTERS)),
            (r"\p{N}", _class("N", _NOT_NUMBERS)),
        ):
            pattern = pattern.replace(name, own)
        self.pattern = regex.compile(pattern, regex.V1)
        chars = byte_characters()
        self.first = [self.vocab[c] for c in chars]
        self.last = [self.vocab[c + self.suffix] for c in chars]
        self.memory: dict[str, bytes] = {}

    def merge(self, parts: list[int]) -> list[int]:
        """Merge the parts of one word by ascending rank, leftmost first."""
        if len(parts) > LONG:
            return self._merge_long(parts)
        merges = self.merges
        ids = list(parts)
        pairs = [merges.get(p, (_NONE, 0)) for p in zip(ids, ids[1:], strict=False)]
        ranks = [p[0] for p in pairs]
        while ranks:
            low = min(ranks)
            if low == _NONE:
                break
            at = ranks.index(low)
            ids[at] = merges[ids[at], ids[at + 1]][1]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = merges.get((ids[at - 1], ids[at]), (_NONE, 0))[0]
            if at < len(ranks):
                ranks[at] = merges.get((ids[at], ids[at + 1]), (_NONE, 0))[0]
        return ids

    def _merge_long(self, parts: list[int]) -> list[int]:
        ids, n = list(parts), len(parts)
        after = [*range(1, n), -1]
        before = list(range(-1, n - 1))
        heap = []

        def offer(left: int) -> None:
            right = after[left]
            if right >= 0 and (found := self.merges.get((ids[left], ids[right]))):
                heap.append((found[0], left, right, ids[left], ids[right], found[1]))

        for i in range(n - 1):
            offer(i)
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, left, right, a, b, new = heapq.heappop(heap)
            stale = not alive[left] or after[left] != right or ids[left] != a or ids[right] != b
            if stale:
                continue
            ids[left] = new
            alive[right] = False
            after[left] = after[right]
            if after[right] >= 0:
                before[after[right]] = left
            for start in (before[left], left):
                if start >= 0:
                    size = len(heap)
                    offer(start)
                    if len(heap) > size:
                        heapq.heappush(heap, heap.pop())
        return [ids[i] for i in range(n) if alive[i]]

    def _word(self, chunk: str) -> bytes:
        """Ids of a piece without white space, as little-endian 32-bit numbers."""
        out = []
        for word in self.pattern.findall(chunk):
            raw = word.encode()
            parts = [self.first[b] for b in raw[:-1]]
            parts.append(self.last[raw[-1]])
            out += self.merge(parts)
        return np.array(out, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        if self.added_pattern and any(t in text for t in self.added):
            out = []
            for piece in self.added_pattern.split(text):
                if piece in self.added:
                    out.append(np.array([self.added[piece]], "<u4").tobytes())
                elif piece:
                    out.append(self._plain(piece))
            return b"".join(out)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        text = unicodedata.normalize("NFC", text)
        # Lower case is taken letter by letter: no final form of sigma.
        text = text.replace("Σ", "σ").lower()
        if not text.isascii() and _CAPITALS.search(text):
            text = text.translate(_LOWER)
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            chunks = [c for c in _SPACES.split(text) if c]
        else:
            chunks = text.split()
        memory = self.memory
        try:
            return b"".join([memory[c] for c in chunks])
        except KeyError:
            pass
        if len(memory) > MEMORY:
            memory.clear()
        out = []
        for chunk in chunks:
            ids = memory.get(chunk)
            if ids is None:
                ids = self._word(chunk)
                if len(chunk) <= LONG:
                    memory[chunk] = ids
            out.append(ids)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids, joined by spaces: the file names no decoder."""
        strings = self.strings
        return " ".join([strings[i] for i in np.frombuffer(ids, "<u4").tolist()])


def read_tokenizer(path: str) -> str:
    """The content of a tokenizer file, read on the driver (a few MB)."""
    with open(path, encoding="utf-8") as file:
        return file.read()


def encode_texts(
    docs: DataFrame, tokenizer: str, text_col: str = "text", decode: bool = True
) -> DataFrame:
    """`docs` without its text, plus `token_ids` (binary, little-endian unsigned 32-bit),
    `n_tokens` and, if wanted, `decoded`, which is made from the ids.

    `tokenizer` is the file's content.  Columns of `docs` with these names are replaced.
    """
    made = ["token_ids", "n_tokens", *(["decoded"] if decode else [])]
    kept = [c for c in docs.columns if c != text_col and c not in made]
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)
    narrow = docs.select(F.col(text_col).alias("__text"), *kept)
    schema = T.StructType([
        *[docs.schema[c] for c in kept],
        T.StructField("token_ids", T.BinaryType()), T.StructField("n_tokens", T.LongType()),
        *([T.StructField("decoded", T.StringType())] if decode else []),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(shared.value)
        for block in text_blocks(batches, "__text"):
            ids = [coder.encode(t or "") for t in block.column("__text").to_pylist()]
            columns = [block.column(c) for c in kept]
            columns += [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64())]
            if decode:
                columns.append(pa.array([coder.decode(i) for i in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(columns, [*kept, *made])

    return narrow.mapInArrow(run, schema)


def decode_ids(rows: DataFrame, tokenizer: str, ids_col: str = "token_ids") -> DataFrame:
    """`rows` plus `decoded`; null ids give an empty text."""
    shared = rows.sparkSession.sparkContext.broadcast(tokenizer)
    kept = [c for c in rows.columns if c != "decoded"]
    schema = T.StructType(
        [*[rows.schema[c] for c in kept], T.StructField("decoded", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordTokenizer(shared.value)
        for block in text_blocks(batches, ids_col):
            texts = [coder.decode(i or b"") for i in block.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*[block.column(c) for c in kept], pa.array(texts, pa.string())],
                [*kept, "decoded"],
            )

    return rows.select(*kept).mapInArrow(run, schema)
