"""Incremental runs with Structured Streaming: idempotent upserts, dedupe within a window, and breaker state."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


#: Fields of a record whose change is one of funding; any other but the deadline is one of content.
FUNDING = ("amount_text", "funding_type", "amount_usd")
STATE = {"first_seen": "timestamp", "last_seen": "timestamp", "times_seen": "long", "change_type": "string"}


def _versions(spark: SparkSession, root: str) -> list[tuple[int, str, int]]:
    """The complete versions of an archive, ascending, each with the run and the batch that made it; a half-written one is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    done = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory() and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted((int(m[1]), m[2], int(m[3])) for n in done if (m := re.fullmatch(r"v(\d+)-(\w*)-(\d+)", n)))


def versions(spark: SparkSession, root: str) -> list[int]:
    return [n for n, _, _ in _versions(spark, root)]


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The latest complete version."""
    found = _versions(spark, root)
    return spark.read.parquet("{}/v{}-{}-{}".format(root, *found[-1])) if found else None


def merged(old: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """An archive (key, fields, STATE) with a batch (key, fields, seen_at) merged in, by one full outer join.

    Within a batch the earliest row of a key counts. A field that the batch's row lacks or says nothing of keeps the archive's
    value and never counts as changed. A row seen again is unchanged (no change_type), or deadline_moved, deadline_added,
    funding_changed or content_changed, the first that applies; rows without a key are left out.
    """
    fields = [c for c in batch.columns if c not in (key, "seen_at")]
    new = batch.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct("seen_at", *fields)).alias("n"))
    for c in fields:
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast(batch.schema[c].dataType))
    met = old.join(new, key, "full_outer")
    known, fresh = F.col("times_seen").isNotNull(), F.col("n").isNotNull()
    moved = {c: F.col(f"n.{c}").isNotNull() & ~F.col(f"n.{c}").eqNullSafe(F.col(c)) for c in fields}
    any_of = lambda cs: reduce(Column.__or__, [moved[c] for c in cs], F.lit(False))
    change = F.when(any_of([c for c in fields if c in FUNDING]), "funding_changed").when(any_of([c for c in fields if c not in FUNDING]), "content_changed")
    if "deadline" in fields:
        change = F.when(moved["deadline"] & F.col("deadline").isNull(), "deadline_added").when(moved["deadline"], "deadline_moved").otherwise(change)
    kept = [c for c in old.columns if c not in (key, *fields, *STATE)]
    return met.select(
        key, *[F.coalesce(F.col(f"n.{c}"), F.col(c)).alias(c) for c in fields], *kept, F.coalesce("first_seen", "n.seen_at").alias("first_seen"),
        F.coalesce("n.seen_at", "last_seen").alias("last_seen"), (F.coalesce("times_seen", F.lit(0)) + fresh.cast("int")).cast("long").alias("times_seen"),
        F.when(fresh & ~known, "new").when(fresh, change).alias("change_type"))


def apply_batch(batch: DataFrame, batch_id: int, root: str, key: str = "url_key", run: str = "") -> None:
    """Merges a micro-batch into the archive as its next version, named after the `run` (a checkpoint) and the batch; one that this run has
    merged before changes nothing. The version before stays as it is; each version is the whole archive."""
    spark = batch.sparkSession
    found = _versions(spark, root)
    if (run, batch_id) in {(r, b) for _, r, b in found}:
        return
    old = current(spark, root)
    if old is None:
        fields = [f"`{c}` {t}" for c, t in batch.dtypes if c != "seen_at"]
        old = spark.createDataFrame([], ", ".join([*fields, *(f"{k} {t}" for k, t in STATE.items())]))
    merged(old, batch, key).write.mode("overwrite").parquet(f"{root}/v{found[-1][0] + 1 if found else 1}-{run}-{batch_id}")


def run_incremental(stream: DataFrame, root: str, checkpoint: str, key: str = "url_key"):
    """Works off what is there and stops; run again with its checkpoint, it goes on where it stopped. With a new checkpoint it reads all
    of the stream again, into the same archive."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]
    return (stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
            .foreachBatch(lambda batch, i: apply_batch(batch, i, root, key, run)).start())


def deduplicated(stream: DataFrame, at: str = "ts", key: str = "digest_key", window: str = "20 hours") -> DataFrame:
    """The first row of a key within the window."""
    return stream.withWatermark(at, window).dropDuplicatesWithinWatermark([key])


def breaker(stream: DataFrame, key: str = "source", opens: int = 3) -> DataFrame:
    """Per micro-batch and key: failures in a row, kept as state, and whether the breaker is open. Rows: key, ts, failed."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        for failed in rows["failed"]:
            n = n + 1 if failed else 0
        state.update((int(n),))
        yield pd.DataFrame({key: [k[0]], "failures": [n], "open": [n >= opens]})

    return stream.groupBy(key).applyInPandasWithState(step, f"{key} string, failures long, open boolean", "failures long", "append", GroupStateTimeout.NoTimeout)
