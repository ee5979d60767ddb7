"""Registered queries on the merged archive, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.operators import archive
from gleanery.plans.opportunities import opportunities
from gleanery.plans.registry import query

FIELDS = ("title", "deadline", "amount_usd", "funding_type", "field")
KEYED = """keyed AS (SELECT *, title || '|' || coalesce(strftime(deadline, '%Y-%m-%d'), '') AS canonical, country || '/' || CAST(id // 2 AS VARCHAR) AS url_key, TIMESTAMP '1998-08-02' + to_seconds(id) AS seen_at FROM opps),
old AS (SELECT *, id % 4 = 0 AS was_notified FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY id) AS n FROM keyed WHERE id % 2 = 0 AND url_key IS NOT NULL) WHERE n = 1),
fresh AS (SELECT * FROM keyed WHERE (id % 2 = 1 OR id % 10 = 0) AND url_key IS NOT NULL AND title <> ''),
firsts AS (SELECT *, array_to_string(all_from, ',') AS came_from FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY seen_at) AS n, list_sort(list_distinct(list(source) OVER (PARTITION BY url_key))) AS all_from FROM fresh) WHERE n = 1),
twins AS (SELECT canonical, url_key AS twin FROM (SELECT canonical, url_key, row_number() OVER (PARTITION BY canonical ORDER BY first_seen, url_key) AS n FROM old) WHERE n = 1),
placed AS (SELECT f.*, coalesce(twin, first_value(f.url_key) OVER (PARTITION BY f.canonical ORDER BY f.seen_at, f.url_key)) AS target FROM firsts f LEFT JOIN twins USING (canonical) WHERE f.url_key NOT IN (SELECT url_key FROM old)),
again AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY seen_at, url_key) AS place FROM placed WHERE target <> url_key),
bumps AS (SELECT target, count(*) AS more, max(seen_at) AS late, list_distinct(flatten(list(all_from))) AS others, string_agg(url_key, '|' ORDER BY place) FILTER (place <= 8) AS aliases FROM again GROUP BY target),
came AS (SELECT * FROM firsts WHERE url_key IN (SELECT url_key FROM old) UNION ALL BY NAME SELECT * EXCLUDE (target) FROM placed WHERE target = url_key),
met AS (SELECT coalesce(o.url_key, c.url_key) AS url_key, o.url_key IS NOT NULL AS known, c.url_key IS NOT NULL AS here, o.seen_in AS o_from, c.all_from, o.first_seen, o.last_seen, c.seen_at, o.was_notified,
    coalesce(c.title, o.title) AS title, coalesce(c.deadline, o.deadline) AS deadline, coalesce(c.amount_usd, o.amount_usd) AS amount_usd, coalesce(c.field, o.field) AS field,
    CASE WHEN c.deadline <> o.deadline THEN 'deadline_moved' WHEN c.deadline IS NOT NULL AND o.deadline IS NULL THEN 'deadline_added'
        WHEN (c.amount_usd IS NOT NULL AND c.amount_usd IS DISTINCT FROM o.amount_usd) OR c.funding_type IS DISTINCT FROM o.funding_type THEN 'funding_changed'
        WHEN c.title IS DISTINCT FROM o.title OR (c.field IS NOT NULL AND c.field IS DISTINCT FROM o.field) THEN 'content_changed' END AS change FROM old o FULL JOIN came c ON o.url_key = c.url_key)"""


def _merged(spark, sf_dir):
    o = opportunities(spark, sf_dir).withColumn("canonical", F.concat("title", F.lit("|"), F.coalesce(F.date_format("deadline", "yyyy-MM-dd"), F.lit(""))))
    o = o.withColumn("url_key", F.concat("country", F.lit("/"), F.floor(F.col("id") / 2).cast("string"))).withColumn("seen_at", F.expr("TIMESTAMP_NTZ '1998-08-02 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, id)"))
    old = archive.deduplicated(o.where("id % 2 = 0 AND url_key IS NOT NULL"), ["url_key"], ["id"])
    old = old.select("url_key", "canonical", *FIELDS, "seen_in", "first_seen", "last_seen", F.lit(1).cast("long").alias("times_seen"), F.lit(None).cast("string").alias("change_type"), F.lit(False).alias("changed"),
                     F.lit(False).alias("is_new"), (F.col("id") % 4 == 0).alias("notified"), F.array().cast("array<string>").alias("alt_urls"))
    batch = o.where("id % 2 = 1 OR id % 10 = 0").select("url_key", "canonical", F.col("source").alias("seen_in"), "seen_at", *FIELDS)
    return archive.upsert(batch, old)


@query(f"""WITH {KEYED} SELECT url_key, title, deadline, amount_usd, field, array_to_string(list_sort(list_distinct(list_concat(coalesce(string_split(o_from, ','), []), coalesce(all_from, []), coalesce(others, [])))), ',') AS sources,
coalesce(first_seen, seen_at) AS first_seen, greatest(coalesce(seen_at, last_seen), late) AS last_seen, known::BIGINT + here::BIGINT + coalesce(more, 0) AS times_seen, CASE WHEN here AND NOT known THEN 'new' WHEN here THEN change END AS change_type,
here AND (NOT known OR change IS NOT NULL) AS changed, here AND NOT known AS is_new, CASE WHEN here AND (NOT known OR coalesce(change IN ('deadline_moved', 'funding_changed'), FALSE)) THEN FALSE ELSE was_notified END AS notified, coalesce(aliases, '') AS aliases
FROM met LEFT JOIN bumps ON target = url_key""")
def upsert_rows(spark, sf_dir):
    """The archive after a batch: merged rows, new ones, and those that other pages of theirs have found."""
    rows, _ = _merged(spark, sf_dir)
    return rows.select("url_key", "title", "deadline", "amount_usd", "field", F.col("seen_in").alias("sources"), "first_seen", "last_seen", "times_seen", "change_type", "changed", "is_new", "notified", F.array_join("alt_urls", "|").alias("aliases"))


@query(f"""WITH {KEYED} SELECT outcome, change_type, count(*) AS n FROM (
    SELECT CASE WHEN NOT known THEN 'new' WHEN change IS NULL THEN 'unchanged' ELSE 'changed' END AS outcome, CASE WHEN known THEN change ELSE 'new' END AS change_type FROM met WHERE here
    UNION ALL SELECT 'duplicate', NULL FROM again UNION ALL SELECT 'rejected', NULL FROM keyed WHERE (id % 2 = 1 OR id % 10 = 0) AND (url_key IS NULL OR title = '')) GROUP BY ALL""")
def upsert_counts(spark, sf_dir):
    """What became of the rows of the batch, twins within the batch included."""
    return _merged(spark, sf_dir)[1].groupBy("outcome", "change_type").agg(F.count("*").alias("n"))


ALT, HASH = "'https://alt.example.org/' || id", "sha256(title || CASE WHEN id % 4 = 0 THEN '!' ELSE '' END)"


@query(f"""WITH a AS (SELECT [url, {ALT}] AS urls, list_append(string_split(seen_in, ','), source) AS publishers, sha256(title) AS h FROM opps WHERE status = 'active' AND id % 5 <> 0),
c AS (SELECT id, CASE WHEN id % 7 = 0 THEN '1-URGENT' ELSE source END AS source, CASE WHEN id % 3 = 0 THEN {ALT} ELSE url END AS url, {HASH} AS h FROM opps)
SELECT id, source, url FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.h = c.h AND list_contains(a.urls, c.url) AND list_contains(a.publishers, c.source))""")
def pages_to_read(spark, sf_dir):
    """Candidates whose page isn't stored already: by address or alternative address, hash and publisher."""
    o = opportunities(spark, sf_dir)
    stored = o.where("status = 'active'").select("url", "source", "seen_in", F.expr("IF(id % 5 <> 0, sha2(title, 256), NULL)").alias("content_hash"), F.array(F.expr(ALT)).alias("alt_urls"))
    found = o.select("id", F.expr("IF(id % 7 = 0, '1-URGENT', source)").alias("source"), F.expr(f"IF(id % 3 = 0, {ALT}, url)").alias("url"), F.expr(HASH.replace("sha256(", "sha2(")[:-1] + ", 256)").alias("page_hash"))
    return archive.pages_to_read(found, stored).select("id", "source", "url")
