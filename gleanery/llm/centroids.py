"""Centroid clustering by Lloyd's rounds on integers, computed by differences.

Assignments with their distances are kept in a table, and the clusters' exact sums with the centroids. In each round a vector whose own
centroid did not move is compared with the moved centroids alone, as its other distances are as before; the others are compared with all. The sums
then change by what vectors that went over to another cluster take along: a signed integer for each cluster and component, summed across tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import dropped, small_batches, written

#: Integers are held within this bound, so that every squared distance of up to 64 components fits a long exactly.
LIMIT = 1 << 26
MOST_LONG = (1 << 63) - 1

_ASSIGNED = "vec_id {id}, v binary, cluster int, distance long, was int, moved boolean"


def integers(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), within LIMIT, as int64."""
    return np.clip(np.floor(x.astype(np.float64) * scale), -LIMIT, LIMIT).astype(np.int64)


def squared(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of `v` to all rows of `c`, in integers."""
    return (v * v).sum(1)[:, None] - 2 * (v @ c.T) + (c * c).sum(1)[None, :]


def reassigned(v: np.ndarray, owner: np.ndarray, distance: np.ndarray, centroids: np.ndarray, moved: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """New (owner, distance) of vectors with their former ones, where the centroids flagged in `moved` have new places. Ties go to the smaller number."""
    owner, distance = owner.copy(), distance.copy()
    anew = moved[owner]
    if anew.any():
        d = squared(v[anew], centroids)
        owner[anew] = best = d.argmin(1)
        distance[anew] = d[np.arange(len(best)), best]
    rest, some = np.flatnonzero(~anew), np.flatnonzero(moved)
    if len(rest) and len(some):
        d = squared(v[rest], centroids[some])
        best = d.argmin(1)
        near, number = d[np.arange(len(rest)), best], some[best]
        goes = (near < distance[rest]) | (near == distance[rest]) & (number < owner[rest])
        owner[rest[goes]], distance[rest[goes]] = number[goes], near[goes]
    return owner, distance


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("v").to_pylist()), "<i4").reshape(-1, dim).astype(np.int64)


def _packed(ids: pa.Array, v: np.ndarray | pa.Array, owner: np.ndarray, distance: np.ndarray, was: np.ndarray) -> pa.RecordBatch:
    blobs = pa.array([r.tobytes() for r in v.astype("<i4")], pa.binary()) if isinstance(v, np.ndarray) else v
    return pa.record_batch([ids, blobs, pa.array(owner, pa.int32()), pa.array(distance, pa.int64()), pa.array(was, pa.int32()), pa.array(owner != was)],
                           names=["vec_id", "v", "cluster", "distance", "was", "moved"])


def _first(centroids: np.ndarray, scale: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            v = integers(batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim), scale)
            d = squared(v, centroids)
            owner = d.argmin(1)
            yield _packed(batch.column("vec_id"), v, owner, d[np.arange(len(owner)), owner], np.full(len(owner), -1))

    return assign


def _again(centroids: np.ndarray, moved: np.ndarray, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b for b in batches if b.num_rows):
            was = batch.column("cluster").to_numpy(zero_copy_only=False)
            owner, distance = reassigned(_vectors(batch, dim), was, batch.column("distance").to_numpy(zero_copy_only=False), centroids, moved)
            yield _packed(batch.column("vec_id"), batch.column("v"), owner, distance, was)

    return assign


def _transfers(k: int, dim: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task's vectors bring to their cluster and take from the one before: (cluster, component, amount), component -1 for their number."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, dim + 1), dtype=np.int64)
        for batch in batches:
            v = np.concatenate([np.ones((batch.num_rows, 1), np.int64), _vectors(batch, dim)], 1)
            was = batch.column("was").to_numpy(zero_copy_only=False)
            np.add.at(total, batch.column("cluster").to_numpy(zero_copy_only=False), v)
            np.subtract.at(total, was[was >= 0], v[was >= 0])
        c, i = np.nonzero(total)
        yield pa.record_batch([pa.array(c, pa.int32()), pa.array(i - 1, pa.int32()), pa.array(total[c, i], pa.int64())], names=["cluster", "component", "amount"])

    return add_up


def delta_lloyd(df: DataFrame, k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: str = "1") -> DataFrame:
    """Clusters the rows (vec_id, embedding) of `df` whose embedding has exactly `dim` components, none null or non-finite: vec_id, cluster
    (int), distance (squared), cluster_inertia, inertia (longs), centroid_sha256.

    Components become floor(scale * x), held within 2^26 so that all arithmetic is exact; sums beyond a long are given as the largest
    long. The first centroids are the `k` vectors with the least sha256 of `seed:vec_id`; equal hashes, as of repeated identifiers, go by embedding. A null
    identifier hashes as an empty one. With fewer vectors there are fewer centroids; an empty table gives an empty table. Further columns are ignored.

    Each round is one pass without a shuffle of vectors; k * (dim + 1) sums come to the driver. The former round's table is deleted once the next is written.
    """
    if dim > 64:
        raise ValueError("squared distances of more than 64 components may not fit a long")
    small_batches(df.sparkSession, 4096)
    kind = df.schema["vec_id"].dataType.simpleString()
    kept = df.where(F.size("embedding") == dim).select("vec_id", F.col("embedding").cast("array<double>").alias("x")).where(
        "forall(x, e -> e IS NOT NULL AND NOT isnan(e) AND abs(e) < double('infinity'))")
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    heads = [r["x"] for r in kept.withColumn("h", named).orderBy("h", "x").limit(k).collect()]
    centroids, n = integers(np.array(heads).reshape(-1, dim), scale), len(heads)
    schema = _ASSIGNED.format(id=kind)
    now = written(kept.mapInArrow(_first(centroids, scale, dim), schema), "assigned")
    sums = np.zeros((n, dim + 1), dtype=object)
    for _ in range(rounds):
        carried = now.where("moved").select("v", "cluster", "was").mapInArrow(_transfers(n, dim), "cluster int, component int, amount long")
        for r in carried.groupBy("cluster", "component").agg(F.sum("amount").alias("amount")).collect():
            sums[r["cluster"], r["component"] + 1] += r["amount"]
        new = np.array([[s // row[0] for s in row[1:]] if row[0] else list(old) for row, old in zip(sums, centroids, strict=True)], dtype=np.int64).reshape(-1, dim)
        moved, centroids = (new != centroids).any(1), new
        if not moved.any():
            break
        then, now = now, written(now.mapInArrow(_again(centroids, moved, dim), schema), "assigned")
        dropped(then)
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    inertia = {r["cluster"]: int(r["s"]) for r in now.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    table = [(c, min(s, MOST_LONG), min(sum(inertia.values()), MOST_LONG), names[c]) for c, s in inertia.items()]
    about = df.sparkSession.createDataFrame(table, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return now.select("vec_id", "cluster", "distance").join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle(k: int = 16, rounds: int = 3, scale: int = 64, dim: int = 64, seed: str = "1") -> str:
    """The same in DuckDB's SQL, with every vector compared with every centroid in each round."""
    parts = [f"""own AS (SELECT row_number() OVER () AS n, vec_id, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
             f"part AS (SELECT n, unnest(range(1, {dim + 1})) AS i, unnest(v) AS x FROM own)",
             f"""c0 AS (SELECT k, unnest(range(1, {dim + 1})) AS i, unnest(v) AS c FROM (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), v) - 1 AS k, v FROM own) WHERE k < {k})"""]
    for r in range(rounds + 1):
        parts.append(f"d{r} AS (SELECT n, k, sum((x - c) * (x - c)) AS d FROM part JOIN c{r} USING (i) GROUP BY n, k)")
        parts.append(f"a{r} AS (SELECT n, arg_min(k, (d, k)) AS k, min(d) AS d FROM d{r} GROUP BY n)")
        if r < rounds:
            parts.append(f"s{r} AS (SELECT k, i, sum(x) AS s, count(*) AS m FROM part JOIN a{r} USING (n) GROUP BY k, i)")
            parts.append(f"c{r + 1} AS (SELECT k, i, CASE WHEN m IS NULL THEN c ELSE ((s - ((s % m) + m) % m) // m)::BIGINT END AS c FROM c{r} LEFT JOIN s{r} USING (k, i))")
    return "WITH " + ",\n".join(parts) + f"""
SELECT vec_id, a.k::INT AS cluster, a.d::BIGINT AS distance, (sum(a.d) OVER (PARTITION BY a.k))::BIGINT AS cluster_inertia, (sum(a.d) OVER ())::BIGINT AS inertia, h AS centroid_sha256
FROM own JOIN a{rounds} a USING (n) JOIN (SELECT k, sha256(string_agg(c::VARCHAR, ',' ORDER BY i)) AS h FROM c{rounds} GROUP BY k) USING (k)"""


ORACLE_SQL = _oracle()
