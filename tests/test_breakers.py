from datetime import datetime, timedelta

from pyspark.sql import functions as F

from gleanery.operators import telemetry
from gleanery.streaming.breakers import breaker_events

SCHEMA = "source string, event_id long, ts timestamp, failed boolean"


def test_stream_equals_the_batch_query_late_events_included(spark, tmp_path):
    start = datetime(2026, 1, 1)
    rows = [(f"s{i % 3}", i, start + timedelta(seconds=40 * i), i % 7 not in (0, 5) if i % 3 else i % 2 == 0) for i in range(240)]
    late = [(s, i, t, f) for s, i, t, f in rows if i % 11 == 3]  # these come a file later than they should, within the delay
    now = [r for r in rows if r not in late]
    src = str(tmp_path / "ev")
    for k in range(4):
        part = now[len(now) * k // 4:len(now) * (k + 1) // 4]
        seen = part[-1][2]
        part = part + [r for r in late if part[0][2] - timedelta(seconds=440) <= r[2] < part[0][2]]
        part = part + [r for r in late if part[0][2] <= r[2] <= seen - timedelta(seconds=440)]
        spark.createDataFrame(sorted(part, key=lambda r: hash(r[1] * 7919)), SCHEMA).coalesce(1).write.mode("append").parquet(src)
    told = {r["event_id"] for r in spark.read.parquet(src).collect()}
    spark.createDataFrame([("end", 999, start + timedelta(days=3), False)], SCHEMA).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(src)
    out = str(tmp_path / "out")
    breaker_events(stream).writeStream.trigger(availableNow=True).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).format("parquet").start(out).awaitTermination()
    got = spark.read.parquet(out)
    df = spark.createDataFrame([r for r in rows if r[1] in told], SCHEMA)
    want = telemetry.breaker(df, "source", "ts", F.col("failed")).select("event_id", "failures", "open_s").collect()
    have = got.where("event_id IS NOT NULL AND source <> 'end'").select("event_id", "failures", "open_s").collect()
    assert sorted(map(tuple, have)) == sorted(map(tuple, want)) and len(have) == len(told)
    ends = {(r["source"], r["ts"]) for r in got.where("state = 'half open'").collect()}
    opens = sorted((r["source"], r["ts"], r["open_s"]) for r in got.where("source <> 'end' AND event_id IS NOT NULL").collect())
    after = {}
    for (s, t, w), nxt in zip(opens, [*opens[1:], (None, None, 0)]):
        until = t + timedelta(seconds=w)
        if w and (nxt[0] != s or nxt[1] >= until):
            after[s, until] = True
    assert ends == set(after)
