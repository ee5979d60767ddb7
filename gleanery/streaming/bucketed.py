"""An archive in buckets, of which a batch rewrites only those that it touches.

    root/data/v<n>/bucket=<b>       rows of a bucket of url_key, as version n wrote them
    root/index/v<n>/bucket=<b>      (canonical, url_key, first_seen) by bucket of canonical, by which twins are found
    root/outcomes/v<n>              what became of each key of the batch
    root/manifests/<n>-<run>-<batch>.json   where each bucket stands as of version n; a version is complete once its manifest is there

One writer at a time, as of a stream. What a failed attempt wrote has no manifest and is written over by the next.
"""

from __future__ import annotations

import hashlib
import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators.archive import STATE, oldest_twins, upsert


class BucketedArchive:
    """Versions of an archive under `root`; the number of buckets is that of its first version."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = 64):
        self.spark, self.root = spark, root.rstrip("/")
        self.jvm = spark._jvm
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())
        self.buckets = (self.manifest() or {}).get("n", buckets)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _listed(self, name: str) -> list[str]:
        return [s.getPath().getName() for s in self.fs.listStatus(self._path(name))] if self.fs.exists(self._path(name)) else []

    def versions(self) -> list[tuple[int, str, int, str]]:
        """(version, run, batch, name of the manifest), ascending."""
        return sorted((int(m[1]), m[2], int(m[3]), n) for n in self._listed("manifests") if (m := re.fullmatch(r"(\d+)-(\w*)-(\d+)\.json", n)))

    def manifest(self) -> dict | None:
        """The latest complete version's: version, n, runs (the last batch of each), schema, data and index (bucket -> version that wrote it)."""
        found = self.versions()
        if not found:
            return None
        return json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/manifests/{found[-1][3]}").collect()))

    def _write_manifest(self, name: str, about: dict) -> None:
        out = self.fs.create(self._path(f"manifests/_{name}"), True)
        out.write(json.dumps(about).encode())
        out.close()
        if not self.fs.rename(self._path(f"manifests/_{name}"), self._path(f"manifests/{name}")):
            raise RuntimeError(f"manifest {name} is there already")

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def _read(self, kind: str, at: dict[str, int], schema: str, only: set[int] | None = None) -> DataFrame:
        places = [f"{self.root}/{kind}/v{v}/bucket={b}" for b, v in at.items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*places) if places else self.spark.createDataFrame([], schema)

    def current(self) -> DataFrame | None:
        """The archive as of the latest version. Marks of change are those of its batch alone: older ones have had their turn."""
        about = self.manifest()
        if about is None:
            return None
        rows, now = self._read("data", about["data"], about["schema"]), F.col("version") == about["version"]
        return rows.withColumns({"change_type": F.when(now, F.col("change_type")), "changed": now & F.col("changed")}).drop("version")

    def outcomes(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/outcomes/v{version or self.manifest()['version']}")

    def apply(self, batch: DataFrame, run: str = "", batch_id: int = 0) -> None:
        """Merges a batch as the next version; one that this run has merged before changes nothing."""
        about = self.manifest() or {"version": 0, "n": self.buckets, "runs": {}, "schema": None, "data": {}, "index": {}}
        if about["runs"].get(run, -1) >= batch_id:
            return
        version = about["version"] + 1
        index_schema = "canonical string, url_key string, first_seen timestamp"
        keys = batch.where("url_key IS NOT NULL").select("url_key", F.coalesce("canonical", "url_key").alias("canonical"))
        touched, asked = ({r[0] for r in keys.select(self.bucket(F.col(c))).distinct().collect()} for c in ("url_key", "canonical"))  # no more than buckets
        index = self._read("index", about["index"], index_schema, asked)
        twins = oldest_twins(index.join(keys.select("canonical").distinct(), "canonical", "left_semi"))
        touched |= {r[0] for r in twins.select(self.bucket(F.col("twin"))).distinct().collect()}
        fields = [f"`{c}` {t}" for c, t in batch.dtypes if c not in ("url_key", "canonical", "seen_in", "seen_at")]
        schema = about["schema"] or ", ".join(["url_key string", "canonical string", *fields, *(f"{k} {t}" for k, t in STATE.items()), "version long"])
        old = self._read("data", about["data"], schema, touched)
        rows, outcomes = upsert(batch, old, twins)
        place = f"{self.root}/data/v{version}"
        # a row that the batch left alone keeps the version that last changed it
        came = outcomes.where("outcome <> 'rejected' AND outcome <> 'duplicate'").select("url_key", F.lit(version).cast("long").alias("now"))
        rows = rows.join(came, "url_key", "left").withColumn("version", F.coalesce("now", "version")).drop("now").withColumn("bucket", self.bucket(F.col("url_key")))
        rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(place)
        new_schema = ", ".join(f"`{c}` {t}" for c, t in rows.drop("bucket").dtypes)
        written = self.spark.read.schema(f"{new_schema}, bucket int").parquet(place)
        outcomes.write.mode("overwrite").parquet(f"{self.root}/outcomes/v{version}")
        fresh = written.where((F.col("version") == version) & (F.col("change_type") == "new")).select("canonical", "url_key", "first_seen")
        entries = index.unionByName(fresh).withColumn("bucket", self.bucket(F.col("canonical")))
        entries.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/index/v{version}")
        at = lambda kind: {n.split("=")[1]: version for n in self._listed(f"{kind}/v{version}") if n.startswith("bucket=")}
        self._write_manifest(f"{version}-{run}-{batch_id}.json", about | {"version": version, "schema": new_schema, "runs": about["runs"] | {run: batch_id}, "data": about["data"] | at("data"), "index": about["index"] | at("index")})

    def compact(self, keep: int = 2) -> int:
        """Deletes what none of the last `keep` versions refers to, and their manifests; the number of buckets deleted."""
        found = self.versions()
        kept = [json.loads("".join(r[0] for r in self.spark.read.text(f"{self.root}/manifests/{n}").collect())) for *_, n in found[-keep:]]
        gone = 0
        for kind in ("data", "index"):
            used = {(v, int(b)) for m in kept for b, v in m[kind].items()}
            for v in self._listed(kind):
                for b in self._listed(f"{kind}/{v}"):
                    if b.startswith("bucket=") and (int(v[1:]), int(b[7:])) not in used and int(v[1:]) <= found[-1][0]:
                        self.fs.delete(self._path(f"{kind}/{v}/{b}"), True)
                        gone += 1
        for v, _, _, name in found[:-keep]:
            self.fs.delete(self._path(f"manifests/{name}"), False)
            self.fs.delete(self._path(f"outcomes/v{v}"), True)
        return gone


def run_bucketed(stream: DataFrame, root: str, checkpoint: str, buckets: int = 64, keep: int = 2):
    """Works off a stream of batches into a bucketed archive and stops; run again with its checkpoint it goes on where it stopped."""
    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:16]

    def step(batch: DataFrame, i: int) -> None:
        archive = BucketedArchive(batch.sparkSession, root, buckets)
        archive.apply(batch, run, i)
        archive.compact(keep)

    return stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(step).start()
