import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.sources import prompts
from tallyforge.sources.prompts import read_prompt_arrays, read_prompts, write_prompt_arrays


@pytest.fixture(params=["128m", "150b"])
def ranges(spark, request):
    """Whole files, and byte ranges that begin in the middle of strings and escapes."""
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", request.param)
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    yield request.param
    spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
    spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def awkward(seed, n=40):
    rng = random.Random(seed)
    bits = ['"', "\\", '\\"', "[", "]", ", ", "null", "\n", "é", "𝄞", " ", "word ", "\t", "", "{}", '","']
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 14))) for _ in range(n)]


def rows(df):
    return sorted((r["prompt_idx"], r["prompt"]) for r in df.collect())


def read(spark, path):
    return [r[1] for r in sorted(
        ((r["prompt_idx"], r["prompt"]) for r in read_prompt_arrays(spark, path).collect()), key=lambda r: r[0]
    )]


@pytest.mark.parametrize("indent,ascii_only", [(None, True), (2, False)])
def test_reads_any_array_of_strings(spark, ranges, tmp_path, indent, ascii_only):
    prompts = awkward(1)
    path = str(tmp_path / "batch.json")
    with open(path, "w") as f:
        json.dump(prompts, f, indent=indent, ensure_ascii=ascii_only)
    found = read_prompt_arrays(spark, path)
    assert rows(found) == list(enumerate(prompts)) == rows(read_prompts(spark, path))
    if ranges == "150b":
        assert spark.read.text(path, lineSep='"').rdd.getNumPartitions() > 4


@pytest.mark.parametrize("values", [
    [], [None], [None, "a", None, None, "b,null,]", None], ["x"], [1, -2.5, True, "t", False, 1e30, None], [""],
])
def test_other_values(spark, ranges, tmp_path, values):
    path = str(tmp_path / "batch.json")
    with open(path, "w") as f:
        json.dump(values, f)
    as_text = [v if v is None or isinstance(v, str) else json.dumps(v) for v in values]
    assert read(spark, path) == as_text


@pytest.mark.parametrize("text", [
    '["a" "b"]', '["a", "b"', '["a", "b]', '["a"], "b"', '{"a": "b"}', '["a", ["b"]]', '["a",, "b"]', "", "a",
    '["a"] x', '[null', '["a", nul, "b"]',
])
def test_broken_files_fail(spark, tmp_path, text):
    (tmp_path / "fine.json").write_text('["z"]')
    (tmp_path / "broken.json").write_text(text)
    if text:
        with pytest.raises(ValueError, match="broken.json"):
            read_prompt_arrays(spark, str(tmp_path))
    else:  # an empty file has no pieces
        assert read(spark, str(tmp_path)) == ["z"]


def test_written_batches(spark, ranges, tmp_path):
    prompts = [*awkward(2), None, "x" * 400, "y" * 5]
    path = str(tmp_path / "arrays")
    table = spark.createDataFrame(list(enumerate(prompts)), "n bigint, prompt string").repartition(3)
    write_prompt_arrays(table, path, "n", file_bytes=300)
    found = read_prompt_arrays(spark, path).collect()
    back = [r["prompt"] for r in sorted(found, key=lambda r: (r["batch"], r["prompt_idx"]))]
    assert back == prompts
    files = sorted((tmp_path / "arrays").glob("batch=*/part-*.txt"), key=lambda p: int(p.parent.name[6:]))
    assert len(files) == len({r["batch"] for r in found}) > 4
    whole = [json.loads(f.read_text()) for f in files]
    assert [p for batch in whole for p in batch] == prompts
    sizes = [sum(len((p or "").encode()) + 4 for p in batch) for batch in whole]
    assert all(s < 300 + 404 for s in sizes)


def test_nothing_to_write(spark, tmp_path):
    write_prompt_arrays(spark.createDataFrame([], "n bigint, prompt string"), str(tmp_path / "a"), "n")
    assert not list((tmp_path / "a").glob("batch=*"))


def test_the_check_of_arrays_moves_no_strings(spark, tmp_path):
    path = str(tmp_path / "a")
    spark.range(400).select(
        F.col("id").alias("n"), F.repeat(F.sha2(F.col("id").cast("string"), 512), F.lit(40)).alias("prompt")
    ).write.parquet(str(tmp_path / "texts"))
    write_prompt_arrays(spark.read.parquet(str(tmp_path / "texts")), path, "n", file_bytes=1 << 20)
    checked = []
    known = prompts._checked

    def spied(outside, joined):
        checked.extend([outside, joined])
        return known(outside, joined)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(prompts, "_checked", spied)
        found = read_prompt_arrays(spark, path)
    assert found.count() == 400
    longest = [t.agg(F.max(F.length("value"))).first()[0] for t in checked]
    assert max(longest) < 10
    # What is written on the way, by zstd.
    assert all(".zstd." in f for f in found.inputFiles())
