import hashlib

import pytest

import __spark_entry__ as entry
from tallyforge.llm.line_chunks import dedup_lines
from tallyforge.llm.oracles import ORACLES
from tests.compare import connect, difference
from tests.llm.helpers import SF, awkward_rows, frame


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    assert difference(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name]) is None


def test_plan_has_no_python(spark):
    plan = dedup_lines(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


def test_awkward_rows(spark):
    passage = "\n".join(f"line {i} of a passage" for i in range(30))
    rows = [
        (1, None, "a"), (2, "", "b"), (3, passage, "c"), (4, "other\nstart\n" + passage + "\nend\n", "d"),
        (3, passage, "c"), (None, passage, "n"), (5, "one line", "e"), (6, "one line", "f"), (7, "\n\n\n", "g"),
    ]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, n_lines string")
    out = dedup_lines(docs).collect()
    by = {}
    for r in out:
        by.setdefault(r["doc_id"], []).append(r)
    assert by[1][0]["text"] is None and by[1][0]["n_lines"] == 0
    assert by[2][0]["text"] == "" and by[2][0]["n_lines"] == 1
    # The null id comes first and keeps the passage; equal rows count as one document.
    assert by[None][0]["text"] == passage
    assert len(by[3]) == 2 and by[3][0]["text"] == by[3][1]["text"]
    assert by[3][0]["n_removed_lines"] >= 20
    assert by[4][0]["n_removed_lines"] >= 20 and by[4][0]["text"].startswith("other\nstart")
    assert by[5][0]["text"] == by[6][0]["text"] == "one line"


def chunks_of(lines):
    """(start, stop) of a text's chunks, straight from the rule."""
    def rolled(k):
        now, before = (int(hashlib.md5(lines[j].encode()).hexdigest()[:8], 16) for j in (k, k - 1))
        return now + 31 * before

    found = {(k, k) for k, line in enumerate(lines) if len(line.split()) > 50}
    for d in range(1, 9):
        ends = [k for k in range(len(lines)) if k in (0, len(lines) - 1) or rolled(k) % d == 0]
        found |= {(a, b) for a, b in zip(ends, ends[1:])
                  if len("".join("".join(lines[a : b + 1]).split())) >= 32}
    return sorted(found)


def without_passages(rows, emptied=False):
    """Texts without every later place of a chunk; texts of which nothing is left are
    dropped, unless `emptied` says that they stay."""
    seen, out = {}, {}
    texts = {i: t.split("\n") for i, t in rows if t is not None}
    for i in sorted(texts):
        for a, b in chunks_of(texts[i]):
            seen.setdefault(tuple(texts[i][a : b + 1]), (i, a))
    for i, lines in texts.items():
        gone = {k for a, b in chunks_of(lines) if seen[tuple(lines[a : b + 1])] != (i, a)
                for k in range(a, b + 1)}
        left = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if left.strip() or not gone or emptied:
            out[i] = left
    return out


@pytest.mark.parametrize("end", ["", "end of this one, which is its own"])
def test_passages_of_short_lines(spark, end):
    """Chunks of larger divisors hold what pairs of short lines cannot."""
    rows = []
    for p in range(20):
        verse = [f"verse {p} {k}" for k in range(16)]
        for d in range(3):
            own = [f"{p} {d} {k} is a line of its own, long enough" for k in range(1 + d)]
            rows.append((3 * p + d, "\n".join(own + verse + [end + f" {p} {d}"] * bool(end)), ""))
    found = {r["doc_id"]: r for r in dedup_lines(frame(spark, rows)).collect()}
    assert {i: r["text"] for i, r in found.items()} == without_passages([r[:2] for r in rows])
    later = sum(r["n_removed_lines"] for i, r in found.items() if i % 3)
    assert later >= 0.6 * 40 * 16 and not any(found[3 * p]["n_removed_lines"] for p in range(20))


def test_trivial_lines_stay(spark):
    rows = [(1, "def f():\n}\n}\n\n\nx = 1", ""), (2, "def g():\n}\n}\n\n\ny = 1", "")]
    assert not any(r["n_removed_lines"] for r in dedup_lines(frame(spark, rows)).collect())


def test_awkward_texts_equal_the_rule(spark):
    rows = [(r[0], r[1], "") for r in awkward_rows() if r[0] is not None]
    rows = list({i: (i, t, x) for i, t, x in rows}.values())
    found = {r["doc_id"]: r["text"] for r in dedup_lines(frame(spark, rows)).collect()}
    want = without_passages([r[:2] for r in rows], emptied=True)
    assert {i: t for i, t in found.items() if t is not None} == want


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8])
def test_short_passages_inside_documents(spark, n):
    """A passage of `n` lines and over 50 words goes from all documents but the first."""
    rows, want = [], {}
    for p in range(12):
        passage = [" ".join(f"p{p}l{k}w{w}" for w in range(60 // n + 1)) for k in range(n)]
        for d in range(3):
            before = [f"own {p} {d} {k}" for k in range(2 + p % 4)]
            after = [f"end {p} {d} {k}" for k in range(3)]
            rows.append((3 * p + d, "\n".join(before + passage + after), ""))
            want[3 * p + d] = "\n".join(before + (passage if d == 0 else []) + after)
    found = dedup_lines(frame(spark, rows))
    assert {r["doc_id"]: r["text"] for r in found.collect()} == want


def test_pipeline_stage_removes_all_repeated_passages(spark):
    from corpus_pipeline import line_dedup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = without_passages([(r["doc_id"], r["text"]) for r in docs.collect()])
    found = {r["doc_id"]: r["text"] for r in line_dedup(spark, docs, SF).collect()}
    assert {i: t for i, t in found.items() if t is not None} == want


def test_empty_table(spark):
    assert dedup_lines(frame(spark, [])).count() == 0
