"""Small tables with awkward rows, and brute-force versions."""

from __future__ import annotations

import random

SF = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, extra string"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def awkward_rows(seed=5):
    """Null and empty texts, a null id, repeated rows and ids, ties, a very long word."""
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "DELTA", "épée", "zeta", "Eta", "theta"]
    prose = lambda n: " ".join(rng.choice(words) + str(rng.randrange(40)) for _ in range(n))
    shared = "\n".join(prose(12) for _ in range(6))
    rows = [
        (1, None, "a"), (2, "", "b"), (None, prose(30), None), (3, prose(40), "c"),
        (4, shared, "d"), (5, prose(20) + "\n" + shared + "\n" + prose(20), "e"),
        (6, shared, "f"), (6, shared, "f"), (7, prose(5), "g"), (7, prose(300), "h"),
        (8, "x" * 5000, "i"), (9, " \t\n ", "j"), (10, "ab " * 700, "k"),
        (11, prose(25) + shared[: len(shared) // 2], "l"), (None, None, None),
    ]
    long = prose(400)
    return rows + [(20 + i, long.replace("alpha1 ", f"omega{i} ", 1), "near") for i in range(6)]
