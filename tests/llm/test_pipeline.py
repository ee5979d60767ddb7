import corpus_pipeline
from gleanery.llm.line_dedup import mark_lines
from gleanery.llm.near_dup import near_classes

SF = "/root/testdata/sf0.001"


def test_stages_by_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, None
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{i}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{i}")
        if name != "best_fit_packing":
            assert docs.columns == columns
        rows, had = docs.collect(), {r["doc_id"]: r for r in before.collect()}
        if name == "language_id":
            kept = {r["doc_id"] for r in rows}
            assert all(d in kept for d, r in had.items() if sum(map(str.isalpha, r["text"] or "")) > 200)
            assert all(any(map(str.isalpha, r["text"])) for r in rows)
        elif name == "line_dedup":
            gone = {r["doc_id"]: set(r["removed_lines"]) for r in mark_lines(before).collect()}
            want = {d: "\n".join(x for k, x in enumerate(r["text"].split("\n")) if k not in gone[d]) for d, r in had.items()}
            assert {r["doc_id"]: r["text"] for r in rows} == {d: t for d, t in want.items() if t.strip()}
            lines = [x for r in rows for x in r["text"].split("\n") if x.strip()]
            assert len(lines) == len(set(lines))
        elif name == "minhash_near_dedup":
            assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in near_classes(before).where("kept").collect())
        elif name == "mixing":
            assert all(had[r["doc_id"]] == r for r in rows)
            assert max(sum(r["doc_id"] == d for r in rows) for d in had) <= 3
        else:
            assert {r["doc_id"] for r in rows} == set(had)


def test_run_is_the_stages(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0
