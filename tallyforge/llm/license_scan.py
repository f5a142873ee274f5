"""Licence scan: keyword-gated signature rules with suppression of contained hits.

Words are runs of letters and digits, A-Z lower-cased, non-ASCII characters included.
A text is first searched for root strings; only where one stands are its words taken,
and only rules whose keyword is among the words, as such or with a number joined to it
(gpl2, gplv2), are tried.  Hits are resolved in order
of priority, then length: a hit that lies within an accepted one is dropped.

Beside the rules, fixed phrases are counted at every place where their words stand
consecutively.  Nulls and empty texts have no words and no hits.
"""

from __future__ import annotations

import bisect
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.llm.arrow import lower_ascii, text_blocks, text_bytes, word_spans
from tallyforge.llm.license_rules import ROOTS, Rule, build_rules

#: Fixed phrases and their labels.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
BASE_WEIGHT = 0.8

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_NUMBER = re.compile(r"v?[0-9]+$")
_LOWER = {c: c + 32 for c in range(65, 91)}
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def resolve(hits: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Hits (first word, word after the last, rule) that no accepted hit contains."""
    accepted: list[tuple[int, int, Rule]] = []
    starts: list[int] = []
    reach: list[int] = []
    for hit in sorted(hits, key=lambda h: (-h[2].priority, h[0] - h[1], h[0], h[2].name)):
        at = bisect.bisect_right(starts, hit[0])
        # `reach` holds the furthest end of all accepted hits up to that start.
        if at and reach[at - 1] >= hit[1]:
            continue
        starts.insert(at, hit[0])
        accepted.append(hit)
        reach.insert(at, max(hit[1], reach[at - 1] if at else 0))
        for i in range(at + 1, len(reach)):
            if reach[i] >= hit[1]:
                break
            reach[i] = hit[1]
    return sorted(accepted, key=lambda h: (h[0], h[1], h[2].name))


class Scanner:
    def __init__(self) -> None:
        self.by_word: dict[str, list[Rule]] = defaultdict(list)
        for rule in build_rules():
            self.by_word[rule.keyword].append(rule)
        self.phrases = [(p.split(), label) for p, label in BASE]

    def scan(self, text: str) -> tuple[list, list]:
        """Places of the fixed phrases (word, label) and resolved hits of one text."""
        text = text.translate(_LOWER)
        if not any(root in text for root in ROOTS):
            return [], []
        words = _WORD.findall(text)
        base = []
        for phrase, label in self.phrases:
            n = len(phrase)
            at = -1
            while True:
                try:
                    at = words.index(phrase[0], at + 1)
                except ValueError:
                    break
                if words[at : at + n] == phrase:
                    base.append((at, label))
        seen = set(words)
        seen |= {_NUMBER.sub("", w) for w in seen}
        rules = {r.name: r for w in self.by_word.keys() & seen for r in self.by_word[w]}
        if not rules:
            return base, []
        joined = " ".join(words)
        begins = np.cumsum([0, *[len(w) + 1 for w in words]])
        hits = []
        for rule in rules.values():
            for found in rule.pattern.finditer(joined):
                first = int(np.searchsorted(begins, found.start()))
                last = int(np.searchsorted(begins, found.end()))
                hits.append((first, last, rule))
        return base, resolve(hits)


def scan_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`docs` without its text, plus the columns of `FOUND`; own columns of those names
    are replaced."""
    kept = [c for c in docs.columns if c != text_col and c not in FOUND.names]
    schema = T.StructType([*[docs.schema[c] for c in kept], *FOUND.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner()
        for block in text_blocks(batches, "__text"):
            texts = block.column("__text")
            data, offsets = text_bytes(texts)
            _, _, first = word_spans(_IS_WORD[lower_ascii(data)], offsets)
            out = defaultdict(list)
            for text in texts.to_pylist():
                base, hits = scanner.scan(text or "")
                labels = {label for _, label in base}
                missed = 1.0
                for label in sorted({*labels, *(h[2].label for h in hits)}):
                    best = max([h[2].weight for h in hits if h[2].label == label], default=BASE_WEIGHT)
                    missed *= 1 - best
                out["base_starts"].append(sorted(at for at, _ in base))
                out["base_labels"].append(sorted(labels))
                out["labels"].append(sorted({*labels, *(h[2].label for h in hits)}))
                out["detections"].append([
                    {"rule": r.name, "label": r.label, "first_word": a, "last_word": b - 1,
                     "priority": r.priority} for a, b, r in hits
                ])
                out["score"].append(1 - missed)
            out["n_words"] = np.diff(first).tolist()
            arrow = to_arrow(FOUND)
            yield pa.RecordBatch.from_arrays(
                [*[block.column(c) for c in kept],
                 *[pa.array(out[f.name], f.type) for f in arrow]],
                [*kept, *arrow.names],
            )

    return docs.select(F.col(text_col).alias("__text"), *kept).mapInArrow(run, schema)


FOUND = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("base_starts", T.ArrayType(T.LongType())),
    T.StructField("base_labels", T.ArrayType(T.StringType())),
    T.StructField("labels", T.ArrayType(T.StringType())),
    T.StructField("detections", T.ArrayType(T.StructType([
        T.StructField("rule", T.StringType()), T.StructField("label", T.StringType()),
        T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
        T.StructField("priority", T.IntegerType()),
    ]))),
    T.StructField("score", T.DoubleType()),
])


def to_arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)
