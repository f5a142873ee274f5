from tallyforge.operators.snippets import avg_complexity, finding_count


def test_snippets_without_rows_get_zero(spark):
    snippets = spark.createDataFrame([(1,), (2,)], "snippet_id INT")
    blocks = spark.createDataFrame([(1, 2), (1, 5)], "snippet_id INT, complexity INT")
    got = {r.snippet_id: r.avg_complexity for r in avg_complexity(snippets, blocks).collect()}
    assert got == {1: 3.5, 2: 0.0}
    got = {r.snippet_id: r.security_issues for r in finding_count(snippets, blocks).collect()}
    assert got == {1: 2, 2: 0}
