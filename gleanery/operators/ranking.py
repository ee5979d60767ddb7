"""Policies of ranking: the notification pool with its chained quotas, digests and budgets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BEST = [F.desc_nulls_last, F.asc_nulls_last]


def best_first() -> list:
    return [F.col("score").desc_nulls_last(), F.col("deadline").asc_nulls_last(), F.col("id")]


def first_n(df: DataFrame, key: str, n: int, order: list) -> DataFrame:
    """The first `n` rows of each key; the row_number filter becomes a per-partition group limit before the shuffle."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def pool(scored: DataFrame, least: float, per_source: int, per_tier: dict[str, int], force: bool = False, other: int = 99) -> DataFrame:
    """Rows to notify: eligible, not hidden, new or changed or never notified; at most `per_source` of a source, best first, and
    then, among the survivors alone, each tier's quota."""
    fresh = F.lit(True) if force else F.coalesce("is_new", F.lit(False)) | F.coalesce("changed", F.lit(False)) | ~F.coalesce("notified", F.lit(False))
    rows = scored.where(F.col("gate_pass") & (F.col("score") >= least) & ~F.col("hidden").eqNullSafe(True) & fresh)
    capped = first_n(rows, "source", per_source, best_first())
    quota = F.lit(other)
    for tier, n in per_tier.items():
        quota = F.when(F.col("tier") == tier, n).otherwise(quota)
    rank = F.row_number().over(Window.partitionBy("tier").orderBy(*best_first()))
    return capped.withColumn("_rank", rank).where(F.col("_rank") <= quota).drop("_rank")


def digest_rows(scored: DataFrame, least: float, most: int) -> DataFrame:
    return scored.where(F.col("gate_pass") & (F.col("score") >= least)).orderBy(F.col("score").desc(), F.coalesce("days_left", F.lit(9999)), "id").limit(most)


def digest_key(rows: DataFrame, key: str | None = None) -> DataFrame:
    """digest_key, n: a hash of the set of rows and their changes, in any order; per `key` if given."""
    item = F.concat(F.col("id").cast("string"), F.lit(":"), F.coalesce("change_type", F.lit("new")))
    aggregated = (rows.groupBy(key) if key else rows.groupBy()).agg(F.array_join(F.array_sort(F.collect_list(item)), "|").alias("items"), F.count("*").alias("n"))
    return aggregated.select(*([key] if key else []), F.substring(F.sha2("items", 256), 1, 32).alias("digest_key"), "n")


def within_budget(df: DataFrame, cost: str, order: str, budget: float, chunk: int, key: str) -> DataFrame:
    """Rows, per `key`, of the chunks that start before `budget` is spent; chunks are runs of `chunk` rows by `order`."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    chunked = df.withColumn("chunk", F.floor(n / chunk).cast("long"))
    spent = F.coalesce(F.sum(cost).over(Window.partitionBy(key).orderBy("chunk").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return chunked.withColumn("spent", spent).where(F.col("spent") < budget)
