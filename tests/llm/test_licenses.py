import re

from tallyforge.llm.license_rules import build_rules
from tallyforge.llm.license_scan import BASE, Scanner, resolve, scan_licenses
from tallyforge.llm.queries import QUERIES
from tests.llm.helpers import SF, awkward_rows, frame

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute_base(words):
    return sorted(
        (i, label) for phrase, label in BASE for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    )


def test_hundreds_of_rules():
    assert len({r.name for r in build_rules()}) > 250


def test_query_equals_brute_force(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = QUERIES["op5_licenses"](spark, SF).collect()
    assert len(found) == len(texts)
    for r in found:
        words = words_of(texts[r["doc_id"]])
        base = brute_base(words)
        assert r["n_words"] == len(words) and r["n_base"] == len(base)
        assert r["first_word"] == (base[0][0] if base else None)
        assert r["last_word"] == (base[-1][0] if base else None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in base}))
        assert {label for _, label in base} <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def labels(text):
    base, hits = Scanner().scan(text)
    return sorted({h[2].label for h in hits}), [label for _, label in base]


def test_longer_and_stronger_hits_win():
    assert labels("Licensed under the Apache License, Version 2.0") == (["apache-2.0"], ["apache"])
    assert labels("SPDX-License-Identifier: MIT")[0] == ["mit"]
    assert labels("Released under the MIT License.") == (["mit"], ["mit"])
    gnu = "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"
    assert labels(gnu) == (["lgpl"], ["gpl"])
    assert labels("Copyright (c) 2019 X. All rights reserved.")[0] == ["all-rights-reserved", "copyright-notice"]
    assert labels("sie fuhr mit dem zug, um mit ihr zu reden") == ([], [])


def test_joined_numbers_and_split_roots():
    for name, label in (("GPL", "gpl"), ("LGPL", "lgpl"), ("AGPL", "agpl")):
        for number in "23" if name != "AGPL" else "3":
            for joined in (f"{name}{number}", f"{name}v{number}", f"{name} v{number}", f"{name}-{number}.0"):
                assert labels(f"Licensed under the {joined}.") == ([f"{label}-{number}.0"], []), joined
                assert labels(f"the {joined} license") == ([f"{label}-{number}.0"], []), joined
    for gap in (" ", "\n", "  ", " - "):
        assert labels(f"put into the public{gap}domain") == (["public-domain"], [])


def test_contained_hits_are_dropped():
    strong, weak = sorted(build_rules(), key=lambda r: -r.priority)[:: len(build_rules()) - 1]
    assert resolve([(3, 5, weak), (2, 6, strong), (5, 8, weak)]) == [(2, 6, strong), (5, 8, weak)]


def test_awkward_rows(spark):
    docs = spark.createDataFrame(
        [*awkward_rows(), (99, "İ MIT License mit-license ÄMIT license", "z")],
        "doc_id bigint, text string, labels string",
    )
    found = scan_licenses(docs).collect()
    assert len(found) == len(awkward_rows()) + 1
    for r in found:
        if r["doc_id"] in (1, 2, 9):
            assert (r["n_words"], r["base_starts"], r["labels"], r["score"]) == (0, [], [], 0.0)
        if r["doc_id"] == 99:
            words = words_of("İ MIT License mit-license ÄMIT license")
            assert r["n_words"] == len(words) and len(r["base_starts"]) == len(brute_base(words))
    assert scan_licenses(frame(spark, [])).count() == 0


def test_makers_grant_no_licence():
    for text in ("provided with Python", "published by Elastic in 2019", "available with Ruby",
                 "covered by Apache troops", "released with Vim 9", "distributed by Apple"):
        assert labels(text) == ([], [])
    assert labels("provided with the Python license")[0] == ["python-2.0"]
    assert labels("released under Ruby")[0] == ["ruby"]
