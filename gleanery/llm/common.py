"""What the operators of this subpackage share: written tables, word patterns and connected components."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"

#: A table of at most so many rows of a few numbers each may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where it is unset, a session on one machine, as in tests, gets
    a temporary one; on a cluster that is an error, as executors could not read each other's tables."""
    place = spark.conf.get("spark.checkpoint.dir", None) or getattr(spark, "_gleanery_dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = spark._gleanery_dir = tempfile.mkdtemp(prefix="gleanery-")
    return place.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` as a table written in the shared folder and read again: lineage is cut, and a lost executor costs no more than a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/gleanery-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._gleanery_path = path
    return out


def dropped(table: DataFrame) -> None:
    """Deletes what `written` wrote for `table`, which nothing may read any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._gleanery_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Bounds what a Python worker holds at once: batches of at most `rows` texts and about 16 MB."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def free_name(df: DataFrame, wish: str) -> str:
    """A column name near `wish` that `df` does not have, whatever the case of its letters."""
    taken, name = {c.lower() for c in df.columns}, f"_{wish}"
    while name.lower() in taken:
        name += "_"
    return name


def maybe_broadcast(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """`df`, marked for broadcast if its counted `rows` are few enough."""
    return F.broadcast(df) if rows <= most else df


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of `edges` (a, b: long) as rows (id, component_id), the smallest id of each.

    Alternates large-star and small-star steps, each one shuffle over the edges, until nothing changes; the
    number of rounds grows with the logarithm of the longest path. Self-loops, nulls and repeated edges are
    harmless, ids without an edge are not returned, and an empty table gives an empty table.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    pairs = written(edges.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").distinct(), "edges")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u moves to the smallest of u and its neighbours
        both = pairs.select("u", "v").unionByName(pairs.selectExpr("v AS u", "u AS v"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").selectExpr("v AS u", "m AS v").where("u <> v").distinct()
        # small star: u and its smaller neighbours move to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").selectExpr("CASE WHEN v = m THEN u ELSE v END AS u", "m AS v").where("u <> v").distinct()
        new = written(small, "edges")
        state = [x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first() for x in (pairs, new)]
        dropped(pairs)
        pairs = new
        if state[0] == state[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return pairs.selectExpr("u AS id", "v AS component_id").unionByName(
        pairs.selectExpr("v AS id", "v AS component_id")).distinct()
