"""The query surface over the archive: filters, sorts, pages, facets, statistics and lookups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYWORD_COLUMNS = ("title", "country", "field", "eligibility", "description", "amount_text", "source")
STATUSES = {"active": ("active",), "expiring": ("active",), "expired": ("expired",), "closed": ("expired", "stale", "outdated")}


def keyword(q: str | None, columns: tuple[str, ...] = KEYWORD_COLUMNS) -> Column:
    """Whether any column contains `q`, whatever the case; % and _ in it are wildcards, and a blank one is no filter."""
    q = (q or "").strip()
    return reduce(lambda a, b: a | b, [F.coalesce(F.ilike(F.col(c), F.lit(f"%{q}%")), F.lit(False)) for c in columns]) if q else F.lit(True)


def visible(hidden: bool = False, starred: bool = False) -> Column:
    """Null-safe flags."""
    shown = F.lit(True) if hidden else ~F.col("hidden").eqNullSafe(True)
    return shown & F.col("starred").eqNullSafe(True) if starred else shown


def in_status(status: str | None, as_of: str, horizon: int = 45) -> Column:
    wanted = STATUSES.get(status or "")
    cond = F.col("status").isin(*wanted) if wanted else F.lit(True)
    if status == "expiring":
        now = F.lit(as_of).cast("timestamp_ntz")
        cond = cond & F.col("deadline").between(now, now + F.make_dt_interval(F.lit(horizon)))
    return cond


def equal(**wanted: str | None) -> Column:
    """Exact matches; an empty or 'any' value is no filter."""
    return reduce(lambda a, b: a & b, [F.col(k) == v for k, v in wanted.items() if v not in (None, "", "any")], F.lit(True))


def from_source(source: str, exact: bool = True) -> Column:
    """Rows of a source or seen in it; not exact: as a substring of the list."""
    seen = F.array_contains(F.split("seen_in", ","), source) if exact else F.ilike(F.col("seen_in"), F.lit(f"%{source}%"))
    return (F.col("source") == source) | F.coalesce(seen, F.lit(False))


def at_least(amount: float | None) -> Column:
    return F.col("amount_usd") >= amount if amount else F.lit(True)


def order_of(name: str) -> list[Column]:
    """The columns of a named sort; nulls stand last and `id` breaks ties."""
    d = F.col("deadline").asc_nulls_last()
    sorts = {
        "score": [F.col("score").desc_nulls_last(), d], "-score": [F.col("score").asc_nulls_last(), d], "deadline": [d], "-deadline": [F.col("deadline").desc_nulls_last()],
        "amount": [F.col("amount_usd").desc_nulls_last()], "-amount": [F.col("amount_usd").asc_nulls_last()], "seen": [F.col("first_seen").desc_nulls_last()],
        "title": [F.lower("title").asc_nulls_last()], "days": [F.col("days_left").asc_nulls_last(), d],
    }
    return [*sorts.get(name, sorts["score"]), F.col("id")]


def page(df: DataFrame, sort: str = "score", limit: int = 50, offset: int = 0) -> DataFrame:
    """One page: 1 to 500 rows from an offset of at least 0."""
    return df.orderBy(*order_of(sort)).offset(max(0, offset)).limit(min(500, max(1, limit)))


def facets(df: DataFrame, dims: tuple[str, ...] = ("country", "degree_level", "funding_type", "source", "tier"), top: int = 60) -> DataFrame:
    """dim, value, n: the `top` most frequent values of each dimension, without nulls and blanks, in one pass."""
    long = df.select(F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.col(d).cast("string").alias("value")) for d in dims])).alias("x")).select("x.*")
    counted = long.where("value IS NOT NULL AND value <> ''").groupBy("dim", "value").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("dim").orderBy(F.desc("n"), "value"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= top).select("dim", "value", "n")


def statistics(df: DataFrame, as_of: str) -> DataFrame:
    """One row of counts and extremes over the archive."""
    live = F.col("status") == "active"
    return df.agg(F.count("*").alias("total"), F.count_if(live).alias("active"), F.count_if(F.coalesce("gate_pass", F.lit(False)) & live).alias("eligible"),
                  F.count_if(F.coalesce("is_new", F.lit(False))).alias("fresh"), F.count_if(F.coalesce("starred", F.lit(False))).alias("starred"),
                  F.max("amount_usd").alias("max_amount"), F.min(F.when(live & (F.col("deadline") >= F.lit(as_of).cast("timestamp_ntz")), F.col("deadline"))).alias("next_deadline"))


def by_tier(df: DataFrame) -> DataFrame:
    return df.where("status = 'active'").groupBy(F.coalesce("tier", F.lit("?")).alias("tier")).agg(F.count("*").alias("n"))


def lookup(df: DataFrame, key: str) -> DataFrame:
    """The row whose title is `key`, else the best that contains it, highest score first."""
    exact = F.col("title") == key
    near = F.contains(F.lower("title"), F.lit(key.lower()))
    return df.where(exact | near).orderBy(F.when(exact, 0).otherwise(1), F.col("score").desc_nulls_last(), "id").limit(1)


def quality_flags() -> Column:
    """The array of what a row lacks."""
    funding, amount = F.col("funding_type"), F.col("amount_usd")
    return F.array_compact(F.array(
        F.when(F.coalesce("deadline_estimated", F.lit(False)), F.lit("deadline_estimated")), F.when(amount.isNull(), F.lit("no_amount")),
        F.when(funding.isNull() | (funding == "Unknown"), F.lit("no_funding_type")), F.when(F.col("eligible").isNull(), F.lit("eligibility_unlisted")),
        F.when(F.col("confidence") < 0.55, F.lit("low_confidence"))))


#: The columns of a listing, in order.
LIST_COLUMNS = ("id", "title", "url", "source", "provider", "university", "country", "scope", "degree_level", "field", "funding_type", "amount_text", "amount_usd", "currency",
                "application_fee_usd", "intake", "round_label", "deadline", "deadline_text", "deadline_rolling", "deadline_estimated", "score", "tier", "confidence", "gate_pass", "status",
                "starred", "hidden", "notes", "is_new", "changed", "notified", "times_seen", "first_seen", "last_seen")
#: Times of a listing that are given as text.
SHOWN_TIMES = {"deadline": "yyyy-MM-dd", "first_seen": "yyyy-MM-dd", "last_seen": "yyyy-MM-dd HH:mm"}


def listing(df: DataFrame, sort: str = "score", limit: int = 50, offset: int = 0) -> DataFrame:
    """One row: total (rows of `df`), limit, offset (as granted) and rows, an array of one page (place from 1, LIST_COLUMNS, days_left, reasons).

    `df` is filtered already. The page comes by a top-k over its sort, the total by a count that reads the filters' columns alone; beyond the
    last page rows is empty and the total stays. Columns that `df` lacks are null.
    """
    limit, offset = min(500, max(1, limit)), max(0, offset)
    shown = [F.date_format(c, SHOWN_TIMES[c]).alias(c) if c in SHOWN_TIMES and c in df.columns else F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in (*LIST_COLUMNS, "days_left", "reasons")]
    place = F.row_number().over(Window.orderBy(*order_of(sort)))  # of one page
    rows = page(df, sort, limit, offset).withColumn("place", place).select("place", *shown)
    return rows.agg(F.array_sort(F.collect_list(F.struct("*")), lambda a, b: a["place"] - b["place"]).alias("rows")).select(
        df.agg(F.count("*")).scalar().alias("total"), F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), "rows")


def overview(df: DataFrame, runs: DataFrame, log: DataFrame) -> DataFrame:
    """One row of headline numbers: total, active and eligible (both without hidden rows), starred, hidden, max_award, soonest (deadline of an active
    row), tiers (a map of active rows by tier, '?' without one), last_run (of `runs` by id: source, status, started_at) and last_notice (of `log` by
    id: channel, recipient, count, status, created_at, detail). One pass over each table; empty tables give zeros, an empty map and nulls.
    """
    live, seen = F.col("status").eqNullSafe("active"), ~F.col("hidden").eqNullSafe(True)
    by_tier = df.groupBy(F.coalesce("tier", F.lit("?")).alias("tier")).agg(
        F.count("*").alias("total"), F.count_if(live).alias("live"), F.count_if(live & seen).alias("active"), F.count_if(live & seen & F.col("gate_pass").eqNullSafe(True)).alias("eligible"),
        F.count_if(F.col("starred").eqNullSafe(True)).alias("starred"), F.count_if(F.col("hidden").eqNullSafe(True)).alias("hidden"),
        F.max("amount_usd").alias("max_award"), F.min(F.when(live, F.col("deadline"))).alias("soonest"))
    tiers = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("live") > 0, F.struct("tier", "live")))))
    last = lambda t, *cols: t.agg(F.max_by(F.struct(*cols), "id")).scalar()
    return by_tier.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "active", "eligible", "starred", "hidden")], F.max("max_award").alias("max_award"), F.min("soonest").alias("soonest"), tiers.alias("tiers")).select(
        "*", last(runs, "source", "status", "started_at").alias("last_run"),
        last(log, "channel", "recipient", "count", "status", "created_at", F.left("detail", F.lit(300)).alias("detail")).alias("last_notice"))
