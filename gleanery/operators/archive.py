"""Identity, upsert, change detection and lifecycle of the archive."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields whose change counts, by the name of the change.
FUNDING_FIELDS = ("amount_text", "funding_type", "amount_usd")
CONTENT_FIELDS = ("title", "country", "degree_level", "field", "eligibility", "description")


def deduplicated(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by `order`, as a deterministic dropDuplicates."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def merged_sources(a: Column, b: Column) -> Column:
    """The union of two comma-separated sets, sorted."""
    parts = lambda c: F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")
    return F.array_join(F.array_sort(F.array_union(parts(a), parts(b))), ",")


def changed_fields(new: str, old: str, fields: tuple[str, ...]) -> Column:
    """Whether a field present in the new row differs; an absent one never counts as removed."""
    return reduce(lambda a, b: a | b, [F.col(f"{new}.{c}").isNotNull() & ~F.col(f"{new}.{c}").eqNullSafe(F.col(f"{old}.{c}")) for c in fields], F.lit(False))


def upsert_outcomes(batch: DataFrame, archive: DataFrame, key: str = "url_key", canonical: str = "canonical") -> DataFrame:
    """Per row of `batch` (reduced to the first per key): id, outcome, change_type, times_seen, sources.

    Outcomes: rejected (no key or title), unchanged or changed (the key is known), duplicate (another key with the same
    canonical key is known, the oldest wins), new. Both sides meet in one equi-join per lookup.
    """
    good = batch.where(F.col(key).isNotNull() & (F.col("title") != ""))
    bad = batch.where(F.col(key).isNull() | F.col("title").isNull() | (F.col("title") == ""))
    first = deduplicated(good, [key], ["id"])
    oldest = archive.groupBy(canonical).agg(F.min_by(F.struct(F.col(key).alias("k"), "times_seen", "seen_in"), F.struct("first_seen", "id")).alias("twin"))
    n, o = first.alias("n"), archive.alias("o")
    met = (n.join(o, F.col(f"n.{key}") == F.col(f"o.{key}"), "left")
           .join(oldest.alias("t"), F.col(f"n.{canonical}") == F.col(f"t.{canonical}"), "left"))
    known, twin = F.col(f"o.{key}").isNotNull(), F.col("t.twin.k").isNotNull()
    moved = F.col("n.deadline").isNotNull() & F.col("o.deadline").isNotNull() & (F.col("n.deadline") != F.col("o.deadline"))
    added = F.col("n.deadline").isNotNull() & F.col("o.deadline").isNull()
    change = (F.when(moved, "deadline_moved").when(added, "deadline_added").when(changed_fields("n", "o", FUNDING_FIELDS), "funding_changed")
              .when(changed_fields("n", "o", CONTENT_FIELDS), "content_changed"))
    out = met.select(
        F.col("n.id").alias("id"),
        F.when(known & change.isNull(), "unchanged").when(known, "changed").when(twin, "duplicate").otherwise("new").alias("outcome"),
        F.when(known, change).when(~twin, "new").alias("change_type"),
        (F.coalesce(F.when(known, F.col("o.times_seen")).otherwise(F.col("t.twin.times_seen")), F.lit(0)) + 1).cast("long").alias("times_seen"),
        merged_sources(F.col("n.seen_in"), F.when(known, F.col("o.seen_in")).otherwise(F.col("t.twin.seen_in"))).alias("sources"))
    return out.unionByName(bad.select("id", F.lit("rejected").alias("outcome"), F.lit(None).cast("string").alias("change_type"), F.lit(0).cast("long").alias("times_seen"), F.lit("").alias("sources")))


def pages_to_read(candidates: DataFrame, archive: DataFrame, url: str = "url", page_hash: str = "page_hash") -> DataFrame:
    """The rows of `candidates` (source, url, page_hash) whose page says something new.

    A page is known if the archive has a row of that hash (`content_hash`) at that address, which may be its own or one of its `alt_urls`, and the
    candidate's source has published that row (as `source` or in `seen_in`). Rows without a hash, on either side, know nothing; addresses are
    compared as given. One anti join by source, address and hash, for which each archive row is spread over its few addresses and publishers.
    """
    spread = archive.where("content_hash IS NOT NULL").select(
        F.col("content_hash").alias("_h"), F.explode(F.array_distinct(F.array_union(F.array(url), F.coalesce("alt_urls", F.array().cast("array<string>"))))).alias("_u"), "source", "seen_in")
    known = spread.select("_h", "_u", F.explode(F.array_distinct(F.array_append(F.split(F.coalesce("seen_in", F.lit("")), ","), F.col("source")))).alias("_s"))
    return candidates.join(known, (F.col(page_hash) == F.col("_h")) & (candidates[url] == F.col("_u")) & (candidates["source"] == F.col("_s")), "left_anti")


#: What an archive keeps of a row besides what its batches say.
STATE = {"seen_in": "string", "first_seen": "timestamp", "last_seen": "timestamp", "times_seen": "long", "change_type": "string", "changed": "boolean",
         "is_new": "boolean", "notified": "boolean", "alt_urls": "array<string>"}
#: Changes after which a row is worth another notice.
RENOTIFIED = ("deadline_moved", "funding_changed")
MOST_ALIASES = 8


def oldest_twins(rows: DataFrame) -> DataFrame:
    """Per canonical key the row (twin: its url_key) that was seen first."""
    return rows.where("canonical IS NOT NULL").groupBy("canonical").agg(F.min_by("url_key", F.struct("first_seen", "url_key")).alias("twin"))


def upsert(batch: DataFrame, old: DataFrame, twins: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, outcomes) of a batch (url_key, canonical, seen_in, seen_at, title, further fields) that comes to the archive `old` (url_key,
    canonical, fields, STATE). `rows` has all of `old`, merged, and the new ones; `outcomes` has url_key, outcome and change_type per key of the batch.

    Within a batch the earliest row of a key counts, and its sources are joined. Outcomes: rejected (no key or title), unchanged or changed (the key is known), duplicate
    (another key of the same canonical key is known, or came earlier in the batch; the oldest gets the source, one more sighting and the alias, of which eight are
    kept), new. A null field keeps what the archive has and is never a change. Rows that the batch does not touch stay as they are, marks of change included.
    A moved deadline or changed funding makes a row worth another notice; any other change ends its being new. Every step is an equi-join or an aggregation
    with a map-side part; a canonical key that very many rows share is ranked by a window that keeps eight rows a task before it shuffles.
    """
    inner = ("url_key", "canonical", "seen_in", "seen_at")
    fields = [c for c in batch.columns if c not in inner]
    kinds = dict(batch.dtypes) | {f"{c}": t for c, t in STATE.items() if c != "seen_in"}
    for c in [*fields, *STATE]:
        if c not in old.columns:
            old = old.withColumn(c, F.lit(None).cast(kinds[c]))
    fine = F.col("url_key").isNotNull() & (F.coalesce("title", F.lit("")) != "")
    first = (batch.where(fine).groupBy("url_key").agg(F.min(F.struct("seen_at", F.coalesce("canonical", "url_key").alias("canonical"), *fields)).alias("n"), F.array_sort(F.collect_set("seen_in")).alias("from"))
             .select("url_key", "n", F.array_join("from", ",").alias("from")))
    met = first.join(old.select("url_key", F.lit(True).alias("known")), "url_key", "left")
    fresh = met.where("known IS NULL").select("url_key", "n", "from", F.col("n.canonical").alias("canonical"))
    told = (oldest_twins(old) if twins is None else twins).select("canonical", "twin")
    leaders = fresh.groupBy("canonical").agg(F.min(F.struct("n.seen_at", "url_key"))["url_key"].alias("leader"))
    placed = fresh.join(told, "canonical", "left").join(leaders, "canonical").withColumn("target", F.coalesce("twin", "leader"))
    again = placed.where("target <> url_key")
    sums = again.groupBy("target").agg(F.count("*").alias("more"), F.max("n.seen_at").alias("late"), F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.split("from", ","))))), ",").alias("others"))
    ranked = again.withColumn("rank", F.row_number().over(Window.partitionBy("target").orderBy("n.seen_at", "url_key"))).where(f"rank <= {MOST_ALIASES}")
    aliases = ranked.groupBy("target").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "url_key"))), lambda x: x["url_key"]).alias("aliases"))
    bumps = sums.join(aliases, "target")
    came = met.where("known").select("url_key", "n", "from").unionByName(placed.where("target = url_key").select("url_key", "n", "from"))
    both = old.join(came, "url_key", "full_outer").join(bumps, F.col("url_key") == F.col("target"), "left")
    here, known = F.col("n").isNotNull(), F.col("times_seen").isNotNull()
    moved = {c: here & known & F.col(f"n.{c}").isNotNull() & ~F.col(f"n.{c}").eqNullSafe(F.col(c)) for c in fields}
    any_of = lambda cs: reduce(Column.__or__, [moved[c] for c in cs], F.lit(False))
    change = F.when(any_of([c for c in fields if c in FUNDING_FIELDS]), "funding_changed").when(any_of([c for c in fields if c not in FUNDING_FIELDS]), "content_changed")
    if "deadline" in fields:
        change = F.when(moved["deadline"] & F.col("deadline").isNotNull(), "deadline_moved").when(moved["deadline"], "deadline_added").otherwise(change)
    change = F.when(here & ~known, "new").when(here, change)
    renotified = change.isin(*RENOTIFIED)
    state = {
        "seen_in": merged_sources(merged_sources(F.col("seen_in"), F.col("from")), F.col("others")),
        "first_seen": F.coalesce("first_seen", "n.seen_at"), "last_seen": F.greatest(F.coalesce("n.seen_at", "last_seen"), F.col("late")),
        "times_seen": (F.coalesce("times_seen", F.lit(0)) + here.cast("int") + F.coalesce("more", F.lit(0))).cast("long"),
        "change_type": F.when(here, change).otherwise(F.col("change_type")), "changed": F.when(here, change.isNotNull()).otherwise(F.col("changed")),
        "is_new": F.when(here & ~known, True).when(here & change.isNotNull() & ~renotified, False).otherwise(F.col("is_new")),
        "notified": F.when(here & (~known | F.coalesce(renotified, F.lit(False))), False).otherwise(F.col("notified")),
        "alt_urls": F.slice(F.array_distinct(F.concat(F.coalesce("alt_urls", F.array().cast("array<string>")), F.coalesce("aliases", F.array().cast("array<string>")))), 1, MOST_ALIASES),
    }
    rest = [c for c in old.columns if c not in (*inner, *fields, *STATE)]
    rows = both.select("url_key", F.coalesce("canonical", "n.canonical").alias("canonical"), *[F.coalesce(F.col(f"n.{c}"), F.col(c)).alias(c) for c in fields], *rest, *[c.alias(k) for k, c in state.items()],
                       F.when(here, F.when(~known, "new").when(change.isNull(), "unchanged").otherwise("changed")).alias("outcome"))
    outcomes = (rows.where("outcome IS NOT NULL").select("url_key", "outcome", "change_type")
                .unionByName(again.select("url_key", F.lit("duplicate").alias("outcome"), F.lit(None).cast("string").alias("change_type")))
                .unionByName(batch.where(~fine).select("url_key", F.lit("rejected").alias("outcome"), F.lit(None).cast("string").alias("change_type"))))
    return rows.drop("outcome"), outcomes


def swept(as_of: str, stale_days: int = 45, outdated_days: int = 400) -> Column:
    """The status after ageing: of active rows, past ones expire, unseen ones go stale, old ones are outdated."""
    age = lambda c: F.floor(F.timestamp_diff("SECOND", F.col(c), F.lit(as_of).cast("timestamp_ntz")) / 86400)
    return (F.when(F.col("status") != "active", F.col("status")).when(F.col("deadline") < F.lit(as_of).cast("timestamp_ntz"), "expired")
            .when(age("last_seen") > stale_days, "stale").when(age("first_seen") > outdated_days, "outdated").otherwise("active"))


def rolled_forward(deadline: Column, recurring: Column, today: str, years: int = 4) -> Column:
    """A recurring deadline that is past, moved by whole years, at most four, until it is after `today`; 29 February moves to the 28th and stays."""
    date = deadline.cast("date")
    later = [F.add_months(date, 12 * k) for k in range(1, years + 1)]
    later = [F.when((F.month(x) == 2) & (F.dayofmonth(x) == 29), F.date_sub(x, 1)).otherwise(x) for x in later]
    moved = F.coalesce(*[F.when(x > F.lit(today).cast("date"), x) for x in later], later[-1])
    return F.when(recurring & (date < F.lit(today).cast("date")), moved).otherwise(date)


def reset_flags(df: DataFrame) -> DataFrame:
    """After a cycle: rows that were marked as changed lose the mark."""
    return df.withColumn("change_type", F.when(F.coalesce("changed", F.lit(False)), F.lit(None)).otherwise(F.col("change_type"))).withColumn("changed", F.lit(False))


def marked(df: DataFrame, edits: DataFrame) -> DataFrame:
    """`df` with the flags of `edits` (id, starred, hidden, notes); hiding clears the star, a blank note is none and notes end at 2000."""
    e = edits.select("id", F.col("starred").alias("_s"), F.col("hidden").alias("_h"), F.col("notes").alias("_n"))
    out = df.join(e, "id", "left").withColumn("hidden", F.coalesce("_h", "hidden"))
    out = out.withColumn("starred", F.when(F.col("_h").eqNullSafe(True), False).otherwise(F.coalesce("_s", "starred")))
    return out.withColumn("notes", F.nullif(F.substring(F.trim("_n"), 1, 2000), F.lit(""))).drop("_s", "_h", "_n")


def candidate_outcome(skip: Column, text: Column, title: Column, least_text: int = 40, least_title: int = 6) -> Column:
    """unchanged for a candidate whose page is known, rejected for too short a text or title (null: none), else kept."""
    short = lambda c, n: F.length(F.coalesce(c, F.lit(""))) < n
    return F.when(F.coalesce(skip, F.lit(False)), "unchanged").when(short(text, least_text) | short(title, least_title), "rejected").otherwise("kept")
