from gleanery.llm.mixing import emitted, mix


def test_edge_rows_and_targets(spark):
    rows = [(i, "w " * (i % 9), "abc"[i % 3], i) for i in range(300)] + [(None, None, None, 1), (7, "x y", "a", 2), (7, "x y", "a", 2), (8, "long " * 40_000, "b", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    got = mix(df).collect()
    assert len(got) == len(rows)
    total = sum(r["size"] for r in got)
    sources = {r["source"]: r for r in got}
    assert abs(sum(r["target"] for r in sources.values()) - total) < 1e-6 * total
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"]
    for s, r in sources.items():
        largest = max(x["size"] for x in got if x["source"] == s)
        assert abs(sum(x["taken"] for x in got if x["source"] == s) - r["target"]) <= 2 * largest + 1
    again = mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    assert emitted(mix(df)).count() == sum(r["copies"] for r in got)
    assert mix(df.limit(0)).count() == 0
