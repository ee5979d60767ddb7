import os
from datetime import datetime

from gleanery.operators import archive
from gleanery.streaming.bucketed import BucketedArchive, run_bucketed

BATCH = "url_key string, canonical string, seen_in string, seen_at timestamp, title string, deadline timestamp, amount_usd double, place string"
at = lambda h: datetime(2026, 1, 1, h)


def row(key, canonical, source="s", h=1, title="T", deadline=None, amount=None, place=None):
    return key, canonical, source, at(h), title, deadline, amount, place


def state(df, *names):
    return {r["url_key"]: tuple(r[n] for n in names) for r in df.collect()}


def test_upsert_merges_and_counts(spark):
    first = spark.createDataFrame([row("a", "ca", "s1"), row("b", "cb", "s1", amount=5.0), row("c", "ca", "s2", 2), row(None, "x"), row("e", "ce", title=""), row("f", None), row("g", None)], BATCH)
    none = spark.createDataFrame([], "url_key string, canonical string")
    rows, outcomes = archive.upsert(first, none)
    assert sorted((r["url_key"] or "", r["outcome"]) for r in outcomes.collect()) == [("", "rejected"), ("a", "new"), ("b", "new"), ("c", "duplicate"), ("e", "rejected"), ("f", "new"), ("g", "new")]
    assert state(rows, "times_seen", "seen_in", "alt_urls", "is_new", "notified")["a"] == (2, "s1,s2", ["c"], True, False)
    second = spark.createDataFrame([row("a", "ca", "s3", 5, deadline=at(9)), row("b", "cb", "s1", 5, amount=6.0), row("d", "cb", "s9", 6), row("d", "cb", "s8", 7), row("f", None, "s", 6, place="p"), row("g", None, "s", 6)], BATCH)
    told = rows.withColumn("notified", rows.url_key.isNotNull())
    rows, outcomes = archive.upsert(second, told)
    assert state(outcomes, "outcome", "change_type") == {"a": ("changed", "deadline_added"), "b": ("changed", "funding_changed"), "d": ("duplicate", None), "f": ("changed", "content_changed"), "g": ("unchanged", None)}
    got = state(rows, "times_seen", "seen_in", "change_type", "changed", "is_new", "notified", "amount_usd")
    assert got == {"a": (3, "s1,s2,s3", "deadline_added", True, False, True, None), "b": (3, "s1,s8,s9", "funding_changed", True, True, False, 6.0),
                   "f": (2, "s", "content_changed", True, False, True, None), "g": (2, "s", None, False, True, True, None)}
    assert state(rows, "alt_urls", "last_seen")["b"] == (["d"], at(6)) and archive.upsert(second.limit(0), rows)[1].count() == 0


def test_a_crowd_of_twins_keeps_eight_aliases(spark):
    crowd = spark.createDataFrame([row(f"k{i:04d}", "same", f"s{i % 3}", 1 + i % 20) for i in range(3000)], BATCH)
    rows, outcomes = archive.upsert(crowd, spark.createDataFrame([], "url_key string, canonical string"))
    (only,) = rows.collect()
    assert (only["url_key"], only["times_seen"], only["seen_in"], len(only["alt_urls"])) == ("k0000", 3000, "s0,s1,s2", 8)
    assert outcomes.groupBy("outcome").count().collect()[0]["count"] in (1, 2999)


def files(root):
    return {os.path.relpath(os.path.join(d, f), root) for d, _, fs in os.walk(os.path.join(root, "data")) for f in fs if f.endswith(".parquet")}


def test_bucketed_archive_rewrites_what_a_batch_touches(spark, tmp_path):
    root = str(tmp_path / "arc")
    first = spark.createDataFrame([row(f"k{i}", f"c{i}") for i in range(200)], BATCH)
    a = BucketedArchive(spark, root, 16)
    a.apply(first, "r", 0)
    before, whole = files(root), a.current()
    assert whole.count() == 200 and len(a.manifest()["data"]) == 16
    second = spark.createDataFrame([row("k7", "c7", "z", 5, amount=3.0), row("other", "c9", "y", 6)], BATCH)
    a.apply(second, "r", 1)
    a.apply(second, "r", 1)  # a replay
    new = files(root) - before
    assert before <= files(root) and 1 <= len({os.path.dirname(f) for f in new}) <= 3 and a.manifest()["version"] == 2
    want, outcomes = archive.upsert(second, whole.withColumn("change_type", whole.change_type).withColumn("changed", whole.changed))
    names = ("times_seen", "seen_in", "amount_usd", "alt_urls", "is_new", "notified", "first_seen", "last_seen")
    assert state(a.current(), *names) == state(want, *names)
    assert state(a.outcomes(), "outcome") == state(outcomes, "outcome") == {"k7": ("changed",), "other": ("duplicate",)}
    assert state(a.current().where("changed"), "change_type") == {"k7": ("funding_changed",)} and a.current().where("change_type = 'new'").count() == 0
    a.apply(spark.createDataFrame([row("third", "c11", h=7), row("fourth", "c999", h=7)], BATCH), "q", 0)
    assert a.compact(1) > 0 and len(a.versions()) == 1
    assert BucketedArchive(spark, root, 5).buckets == 16 and a.current().count() == 201 and state(a.current(), "alt_urls")["k11"] == (["third"],)


def test_stream_into_buckets_equals_batches(spark, tmp_path):
    src, root, ckpt = (str(tmp_path / x) for x in ("src", "root", "ckpt"))
    one = spark.createDataFrame([row(f"k{i}", f"c{i % 40}", f"s{i % 3}", 1 + i % 5) for i in range(60)], BATCH)
    two = spark.createDataFrame([row(f"k{i}", f"c{i % 40}", "t", 8, amount=float(i % 2)) for i in range(30, 80)], BATCH)
    for part in (one, two):
        part.write.mode("append").parquet(src)
        run_bucketed(spark.readStream.schema(BATCH).parquet(src), root, ckpt, 8).awaitTermination()
    rows, _ = archive.upsert(one, spark.createDataFrame([], "url_key string, canonical string"))
    rows, _ = archive.upsert(two, rows)
    names = ("canonical", "times_seen", "seen_in", "amount_usd", "alt_urls", "is_new", "notified", "first_seen", "last_seen")
    assert state(BucketedArchive(spark, root).current(), *names) == state(rows, *names)
