import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from gleanery.operators import archive
from gleanery.sources import readers, writers
from gleanery.streaming import incremental

LIST = """<div class="post"><h2><a href="/a/1">A long enough title one</a></h2><p>Deadline: 1 May 2027</p></div><div class="post"><a href="https://x.org/2">Another fine long title</a></div>
<div class="post"><a href="/s">Share on facebook now</a></div><div class="post"><a href="/t">short</a></div>"""


def test_listing_and_table(spark):
    pages = spark.createDataFrame([("https://e.org/list", LIST), ("https://e.org/none", None)], "url string, html string")
    got = readers.html_listing(pages, "s", "div.post", "h2 > a, h2 a").orderBy("pos").collect()
    assert [(r["title"], r["url"]) for r in got] == [("A long enough title one", "https://e.org/a/1"), ("Another fine long title", "https://x.org/2")]
    rows = "<table><tr><th>x</th></tr><tr><td><a href='p'>Title of a row</a></td><td>€500</td><td>Peru</td></tr><tr><td>only one</td></tr></table>"
    t = readers.html_table(spark.createDataFrame([("https://e.org/t/", rows)], "url string, html string"), "t", columns={"title": 0, "value": 1, "country": 2}).collect()
    assert [(r["title"], r["url"], r["cell_value"], r["cell_country"]) for r in t] == [("Title of a row", "https://e.org/t/p", "€500", "Peru")]
    assert len(readers.select(readers.tree("<ul id=u><li class='a b'>1<li>2</ul><p data-x='yes'>3"), "#u .a.b, [data-x^=ye]")) == 2
    with pytest.raises(ValueError):
        readers.reader("nothing")


def test_feed_json_and_seeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>One</title><link>https://e.org/1</link><description>d</description></item><item><title>none</title></item></channel></rss>")
    assert [(r["title"], r["url"]) for r in readers.feed(spark, str(tmp_path / "f.xml"), "f").collect()] == [("One", "https://e.org/1")]
    (tmp_path / "j.json").write_text(json.dumps({"data": {"content": [{"t": "A", "c": [{"x": "PE"}], "n": "12"}, {"t": "B", "n": "much"}]}}))
    got = readers.json_api(spark, str(tmp_path / "j.json"), "j", "data.content", {"title": "t", "country": "c.0.x", "n": "n"}, ("n",)).orderBy("pos").collect()
    assert [(r["title"], r["country"], r["n"]) for r in got] == [("A", "PE", 12.0), ("B", None, None)]
    (tmp_path / "s.json").write_text(json.dumps({"scholarships": [{"id": "a", "title": "A", "deadline": "2027-01-01", "review_before": "2026-01-01", "verify_url": "v"}, {"id": "b", "title": "B"}]}))
    live = spark.createDataFrame([("a", "2026-05-05", "€5", None, None)], "id string, deadline string, amount_text string, eligibility string, funding_type string")
    rows = {r["id"]: r for r in readers.seeds(spark, str(tmp_path / "s.json"), "2026-06-01", live).collect()}
    assert rows["a"]["stale"] and rows["a"]["deadline"] == "2027-01-01" and rows["a"]["amount_text"] == "€5" and rows["a"]["check_url"] == "v" and not rows["b"]["stale"]
    c = spark.createDataFrame([("s", i, f"t{i}", f"u{i % 3}") for i in range(6)] + [("s", 9, "", "u9")], "source string, pos int, title string, url string")
    assert [r["pos"] for r in readers.finished(c, 2).orderBy("pos").collect()] == [0, 1]


def test_chunks_and_reports(spark, tmp_path):
    df = spark.createDataFrame([("aa\nbb\ncc\n" + "d" * 20,)], "t string")
    assert df.select(writers.chunked(F.col("t"), 6, 3).alias("c")).first()["c"] == ["aa\nbb", "cc", "d" * 20]
    top = spark.createDataFrame([(i, f"T{i}", "s", None, "Master", "f", "Full", 5.0, "x", None, None, float(i), "low", 0.5, "u", "active") for i in range(5)], "id long, title string, source string, country string, degree_level string, field string, funding_type string, amount_usd double, amount_text string, deadline timestamp, days_left int, score double, tier string, confidence double, url string, status string")
    writers.write_csv(top, str(tmp_path / "csv"))
    back = spark.read.option("header", "true").csv(str(tmp_path / "csv"))
    assert back.columns == list(writers.CSV_COLUMNS) and back.count() == 5
    assert writers.markdown(top, 2).first()[0].startswith("1. **T4**")
    doc = json.loads(writers.json_report(top, top.agg(F.count("*").alias("total")), "2026-01-01").first()[0])
    assert doc["stats"]["total"] == 5 and [r["id"] for r in doc["rows"]] == [4, 3, 2, 1, 0]
    assert "T4" in writers.html_page(top)


def test_stream_upsert_is_idempotent(spark, tmp_path):
    at = lambda h: datetime(2026, 1, 1, h)
    schema = "url_key string, title string, deadline timestamp, seen_at timestamp"
    src, root, ckpt = (str(tmp_path / x) for x in ("src", "root", "ckpt"))
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    spark.createDataFrame([("a", "A", at(1), at(2)), ("a", "late", at(1), at(3)), ("b", "B", None, at(2))], schema).write.parquet(src)
    incremental.run_incremental(stream(), root, ckpt).awaitTermination()
    first = sorted(map(tuple, incremental.current(spark, root).select("url_key", "title", "times_seen", "change_type").collect()))
    assert first == [("a", "A", 1, "new"), ("b", "B", 1, "new")]
    incremental.run_incremental(stream(), root, ckpt).awaitTermination()
    run = incremental._versions(spark, root)[0][1]
    incremental.apply_batch(spark.createDataFrame([("a", "x", None, at(9))], schema), 0, root, run=run)  # a replay
    assert sorted(map(tuple, incremental.current(spark, root).select("url_key", "title", "times_seen", "change_type").collect())) == first
    spark.createDataFrame([("a", "A", at(5), at(6)), ("c", "C", None, at(6))], schema).write.mode("append").parquet(src)
    incremental.run_incremental(stream(), root, ckpt).awaitTermination()
    assert sorted(map(tuple, incremental.current(spark, root).select("url_key", "times_seen", "change_type").collect())) == [("a", 2, "deadline_moved"), ("b", 1, None), ("c", 1, "new")]
    # a new checkpoint on the same archive reads everything again and drops no batch
    spark.createDataFrame([("d", "D", None, at(7))], schema).write.mode("append").parquet(src)
    incremental.run_incremental(stream(), root, str(tmp_path / "other")).awaitTermination()
    assert sorted(map(tuple, incremental.current(spark, root).select("url_key", "times_seen").collect())) == [("a", 3), ("b", 2), ("c", 2), ("d", 1)]


def test_merge_of_all_fields(spark):
    at = lambda h: datetime(2026, 1, 1, h)
    old = spark.createDataFrame([("a", "A", "old", 5.0, at(1), at(1), 1, "new"), ("b", "B", None, None, at(1), at(1), 4, None)],
                                "url_key string, title string, place string, amount_usd double, first_seen timestamp, last_seen timestamp, times_seen long, change_type string")
    batch = spark.createDataFrame([("a", None, 6.0, at(2), at(3)), ("b", "B2", None, None, at(3)), (None, "x", 1.0, None, at(3)), ("c", "C", None, None, at(3)), ("a", "late", 9.0, None, at(4))],
                                  "url_key string, title string, amount_usd double, deadline timestamp, seen_at timestamp")
    got = {r["url_key"]: r for r in incremental.merged(old, batch, "url_key").collect()}
    assert {k: (r["title"], r["place"], r["amount_usd"], r["times_seen"], r["change_type"]) for k, r in got.items()} == {
        "a": ("A", "old", 6.0, 2, "deadline_added"), "b": ("B2", None, None, 5, "content_changed"), "c": ("C", None, None, 1, "new")}


def test_stream_breaker_and_dedupe(spark, tmp_path):
    src = str(tmp_path / "ev")
    spark.createDataFrame([("s", datetime(2026, 1, 1, i), i != 1) for i in range(5)], "source string, ts timestamp, failed boolean").write.parquet(src)
    read = lambda: spark.readStream.schema("source string, ts timestamp, failed boolean").parquet(src)
    q = incremental.breaker(read()).writeStream.trigger(availableNow=True).format("memory").queryName("brk").outputMode("append").option("checkpointLocation", str(tmp_path / "c1")).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("brk").collect()] == [("s", 3, True)]
    q = incremental.deduplicated(read(), "ts", "source").writeStream.trigger(availableNow=True).format("memory").queryName("ddp").outputMode("append").option("checkpointLocation", str(tmp_path / "c2")).start()
    q.awaitTermination()
    assert spark.table("ddp").count() == 1


def test_rollforward_keeps_to_the_28th(spark):
    df = spark.sql("SELECT DATE '1996-02-29' AS d")
    assert str(df.select(archive.rolled_forward(F.col("d"), F.lit(True), "1999-06-01").alias("r")).first()["r"]) == "2000-02-28"


def test_plans_keep_to_the_shape_they_should(spark):
    from gleanery.plans.queries import QUERIES
    plan = lambda name: QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan("report_topn") and "WindowGroupLimit" in plan("pool_quota")
    assert "BatchEvalPython" not in plan("evaluate") and "CartesianProduct" not in plan("evaluate")


def test_listings_of_all_pages(spark):
    from gleanery.plans.queries import QUERIES
    from gleanery.sources.readers import listing_rows

    sf = "/root/testdata/sf0.1"
    want = {(p["url"].split("/")[2], r[2]) for p in spark.read.parquet(f"{sf}/pages.parquet").collect() if p["html"]
            for r in listing_rows(p["html"], p["url"], "li, article", "a[href], h1", 2**31 - 1) if r[1] and r[2]}
    got = [(r["source"], r["url"]) for r in QUERIES["scan_html_list"](spark, sf).collect()]
    assert len(got) == len(set(got)) > 120 and set(got) == want
