from datetime import datetime

from pyspark.sql import functions as F

from gleanery.functions import notices
from gleanery.operators import archive, browse, delivery, telemetry
from gleanery.sources import readers, writers

ROWS = [(1, "a", 50.0, "active", None, True, "strong", True, 10.0, datetime(2027, 1, 2)), (2, "b", 70.0, "active", True, None, "low", True, None, None),
        (3, "c", None, "expired", False, None, None, False, 99.0, datetime(2026, 1, 1)), (4, "d", 50.0, "active", False, None, None, None, 5.0, datetime(2027, 1, 1))]
SCHEMA = "id long, title string, score double, status string, hidden boolean, starred boolean, tier string, gate_pass boolean, amount_usd double, deadline timestamp_ntz"


def test_listing(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = browse.listing(df, limit=2, offset=1).first()
    assert (r["total"], r["limit"], r["offset"]) == (4, 2, 1)
    assert [(x["place"], x["id"], x["deadline"], x["provider"]) for x in r["rows"]] == [(1, 4, "2027-01-01", None), (2, 1, "2027-01-02", None)]
    assert r["rows"][0].asDict().keys() == {"place", *browse.LIST_COLUMNS, "days_left", "reasons"} and len(browse.LIST_COLUMNS) == 35
    beyond = browse.listing(df, limit=0, offset=9).first()
    assert (beyond["total"], beyond["limit"], beyond["rows"]) == (4, 1, [])
    empty = browse.listing(df.limit(0), offset=-3).first()
    assert (empty["total"], empty["offset"], empty["rows"]) == (0, 0, [])


def test_overview(spark):
    at = datetime(2027, 1, 1, 5)
    runs = spark.createDataFrame([(1, "x", "ok", at), (2, "y", "empty", at)], "id long, source string, status string, started_at timestamp_ntz")
    log = spark.createDataFrame([(7, "email", "me", 3, "sent", at, "d" * 400)], "id long, channel string, recipient string, count int, status string, created_at timestamp_ntz, detail string")
    df = spark.createDataFrame(ROWS, SCHEMA)
    r = browse.overview(df, runs, log).first()
    assert r.asDict() | {"last_run": r["last_run"]["source"], "last_notice": len(r["last_notice"]["detail"])} == {
        "total": 4, "active": 2, "eligible": 1, "starred": 1, "hidden": 1, "max_award": 99.0, "soonest": datetime(2027, 1, 1), "tiers": {"?": 1, "low": 1, "strong": 1}, "last_run": "y", "last_notice": 300}
    r = browse.overview(df.limit(0), runs.limit(0), log.limit(0)).first()
    assert (r["total"], r["hidden"], r["max_award"], r["tiers"], r["last_run"], r["last_notice"]) == (0, 0, None, {}, None, None)


def outcomes(digests, log, *policy, **named):
    return sorted((r["digest_key"] or "", r["at"].hour, r["channel"], r["outcome"], r["rows"], r["logged"]) for r in delivery.deliveries(digests, log, delivery.Policy(*policy, **named)).collect())


def test_deliveries(spark):
    t = lambda d, h: datetime(2027, 1, d, h)
    digests = spark.createDataFrame([("a", t(2, 6), 30), ("a", t(2, 8), 30), ("b", t(2, 8), 0), ("c", t(2, 8), None), (None, t(2, 9), 1), ("d", t(2, 3), 2)], "digest_key string, at timestamp_ntz, rows int")
    log = spark.createDataFrame([("a", t(1, 11), "sent"), ("d", t(2, 3), "failed"), (None, t(2, 9), "sent")], "digest_key string, created_at timestamp_ntz, status string")
    both = ("console", "email")
    want = [("", 9, "console", "send", 1, True), ("", 9, "email", "send", 1, True), ("a", 6, "all", "duplicate", 25, False), ("a", 8, "console", "send", 25, True), ("a", 8, "email", "send", 25, True),
            ("b", 8, "all", "nothing", 0, False), ("c", 8, "all", "nothing", 0, False), ("d", 3, "console", "send", 2, True), ("d", 3, "email", "quiet", 2, False)]
    assert outcomes(digests, log, both) == want
    assert {o[3] for o in outcomes(digests, log, both, dry_run=True)} == {"dry-run", "duplicate", "nothing", "quiet"}
    assert {o[3] for o in outcomes(digests, log, (*both, "pager"), dry_run=True, force=True)} == {"send", "nothing", "unknown"}
    assert outcomes(digests.where("digest_key = 'd'"), log, both, quiet=(3, 3))[1][3] == "send"
    assert outcomes(digests.limit(0), log, both) == []


def test_logs_keep_their_columns(spark, tmp_path):
    runs, notes = str(tmp_path / "runs"), str(tmp_path / "notes")
    writers.append_runs(spark.createDataFrame([("x", "ok", None, "7"), ("y", "odd", "boom", "much")], "source string, status string, error string, items_found string"), runs)
    writers.append_runs(spark.createDataFrame([("z", None)], "source string, status string").withColumn("error", F.lit("")), runs)
    got = spark.read.parquet(runs)
    assert [f"{n} {t}" for n, t in got.dtypes] == writers.RUNS.replace("long", "bigint").split(", ")
    assert sorted((r["source"], r["status"], r["items_found"], r["llm_cost_usd"]) for r in got.collect()) == [("x", "ok", 7, 0.0), ("y", "error", 0, 0.0), ("z", "ok", 0, 0.0)]
    digests = spark.createDataFrame([("k", datetime(2027, 1, 1, 8), 3), ("n", datetime(2027, 1, 1, 8), 0)], "digest_key string, at timestamp_ntz, rows int")
    done = delivery.deliveries(digests, spark.createDataFrame([], "digest_key string, created_at timestamp_ntz, status string"), delivery.Policy(("console", "pager")))
    writers.append_notifications(delivery.log_rows(done, "me").withColumn("detail", F.lit("x" * 1000)), notes)
    writers.append_notifications(delivery.log_rows(done).withColumn("status", F.lit("failed")).withColumn("detail", F.lit("")), notes)
    assert [(r["digest_key"], r["channel"], r["recipient"], r["count"], r["status"], len(r["detail"])) for r in spark.read.parquet(notes).collect()] == [("k", "console", "me", 3, "sent", 900)]
    again = delivery.deliveries(digests.where("rows > 0"), spark.read.parquet(notes), delivery.Policy())
    assert [r["outcome"] for r in again.collect()] == ["duplicate"]


def test_html_is_escaped(spark):
    df = spark.createDataFrame([("<b>A</b> & 'B'", None, "", None, None, None, None, 61.5, "worth_a_look", {"field": 2.0, "amount": 7.5}, ['x "y"'], "http://e.org/?a=1&b=2")],
                               "title string, country string, degree_level string, funding_type string, deadline timestamp_ntz, amount_text string, amount_usd double, score double, tier string, breakdown map<string,double>, warnings array<string>, url string")
    got = df.select(F.lit(1).alias("place"), notices.digest_html(F.lit("1")).alias("html"))
    assert got.first()["html"] == ("<article><p>#1 · worth a look · score 62/100</p><h3>&lt;b&gt;A&lt;/b&gt; &amp; &#39;B&#39;</h3><p>? · ? · funding ? · <b>rolling</b></p><p>amount not stated</p>"
                                   '<p><span>amount 8</span> <span>field 2</span></p><p>⚠ x &quot;y&quot;</p><a href="http://e.org/?a=1&amp;b=2">Apply</a></article>')
    page = writers.digest_page(got, "News & more", "2027-01-01", footer="bye").first()["page"]
    assert "<title>News &amp; more</title>" in page and "1 matches" in page and page.endswith("</article><footer>bye</footer></body></html>")
    assert "0 matches" in writers.digest_page(got.limit(0), "x", "y").first()["page"]


def test_last_of_recent(spark):
    df = spark.createDataFrame([(i, i % 3, i * 1.0) for i in range(10)], "id long, source long, cost double")
    assert sorted((r["source"], r["cost"]) for r in telemetry.recent_per(df, "source", "id", 2).collect()) == [(0, 9.0), (2, 8.0)]


def test_feeds(spark, tmp_path):
    (tmp_path / "rss.xml").write_text("""<?xml version="1.0"?><rss><channel><title>Site</title>
<item><title>Grants  for &amp; by all | Site Name</title><link> https://e.org/1 </link><description><![CDATA[<p>Up to <b>5</b></p>]]></description><category>a</category><category>b</category></item>
<item><title>no link</title></item><item><link>https://e.org/2</link></item><item><title> </title><link>https://e.org/3</link></item></channel></rss>""")
    (tmp_path / "atom.xml").write_text("""<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Two</title><link rel="self" href="https://e.org/s"/><link href="https://e.org/4"/>
<published>2027-01-01</published><summary>s</summary><category term="t"/></entry><entry><title>Three</title><link rel="edit" href="https://e.org/5"/></entry></feed>""")
    (tmp_path / "none.xml").write_text("no feed")
    got = [(r["title"], r["url"], r["text"]) for r in readers.feed(spark, str(tmp_path), "f").collect()]
    assert sorted(got) == [("Grants for & by all", "https://e.org/1", "Grants for & by all | Site Name\nhttps://e.org/1\nUp to 5\na\nb"), ("Three", "https://e.org/5", "Three\nhttps://e.org/5"),
                           ("Two", "https://e.org/4", "Two\nhttps://e.org/4\n2027-01-01\ns\nt")]
    assert readers.feed(spark, str(tmp_path / "atom.xml"), "f", 1).count() == 1


def test_pages_to_read(spark):
    kept = spark.createDataFrame([("u", "s", "t,s", "h", ["v"]), ("w", "s", None, None, None), ("x", None, "", "h", None), ("y", "q", "q", "h", [])], "url string, source string, seen_in string, content_hash string, alt_urls array<string>")
    found = spark.createDataFrame([(1, "s", "u", "h"), (2, "t", "v", "h"), (3, "r", "u", "h"), (4, "s", "u", "new"), (5, "s", "w", "h"), (6, "s", "x", "h"), (7, "q", "y", None), (8, None, "u", "h"), (9, "q", None, "h"), (10, "q", "y", "h"), (10, "q", "y", "h")],
                                  "id long, source string, url string, page_hash string")
    assert sorted(r["id"] for r in archive.pages_to_read(found, kept).collect()) == [3, 4, 5, 6, 7, 8, 9]
    assert archive.pages_to_read(found, kept.limit(0)).count() == 11


def test_html_report(spark):
    df = spark.createDataFrame([(1, "A <1>", 61.25, "low", "Chad", "https://e.org/?a=1&b=2", datetime(2027, 1, 2)), (2, "B", 80.0, "strong", None, "javascript:x()", None), (3, "C", None, "low", "Chad", None, None)],
                               "id long, title string, score double, tier string, country string, url string, deadline timestamp_ntz")
    page = writers.html_report(df, "2027-01-01 <now>", 2).first()["page"]
    rows = page[page.index("<tbody>") + 7:page.index("</tbody>")].split("\n")
    assert rows == ['<tr data-tier="strong" data-country="" data-fundingtype="" data-source=""><td>80.0</td><td>strong</td><td>B</td><td></td><td></td><td></td><td></td><td></td><td>rolling</td><td></td><td></td></tr>',
                    '<tr data-tier="low" data-country="Chad" data-fundingtype="" data-source=""><td>61.3</td><td>low</td><td><a href="https://e.org/?a=1&amp;b=2">A &lt;1&gt;</a></td><td>Chad</td><td></td><td></td><td></td><td></td><td>2027-01-02</td><td></td><td></td></tr>']
    assert '<select data-by="tier"><option value="">tier</option><option>low</option><option>strong</option></select>' in page and "2027-01-01 &lt;now&gt;" in page and page.endswith("</script></body></html>")
    assert "<tbody></tbody>" in writers.html_report(df.limit(0)).first()["page"]
    everything = writers.html_report(df).first()["page"]
    assert everything.count("<tr data-") == 3 and "<td></td><td>low</td><td>C</td>" in everything
