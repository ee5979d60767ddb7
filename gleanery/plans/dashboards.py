"""Registered queries on listings, headline numbers, deliveries and the HTML digest, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import notices
from gleanery.operators import browse, delivery, ranking, telemetry
from gleanery.plans.notices import DIGEST
from gleanery.plans.registry import S, query, scored
from gleanery.session import table
from gleanery.sources import writers

#: Columns of a listing that the opportunity view lacks, in both dialects.
MORE = {
    "provider": "'Foundation of ' || scope",
    "university": "CASE WHEN id % 4 = 1 THEN 'University of ' || country END",
    "currency": "CASE WHEN amount_text IS NOT NULL THEN 'USD' END",
    "intake": "CASE WHEN month(deadline) >= 7 THEN 'Autumn ' || year(deadline) END",
    "deadline_text": "CASE WHEN deadline_rolling THEN 'open all year' END",
    "notes": "CASE WHEN starred THEN 'see ' || source END",
    "times_seen": "id % 5 + 1",
}
SHOWN = ", ".join(f"strftime({c}, '{'%Y-%m-%d %H:%M' if c == 'last_seen' else '%Y-%m-%d'}') AS {c}" if c in browse.SHOWN_TIMES else c for c in browse.LIST_COLUMNS)


def listed(spark, sf_dir):
    return scored(spark, sf_dir).withColumns({k: F.expr(v) for k, v in MORE.items()})


@query(S + f""", v AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in MORE.items())} FROM scored WHERE status = 'active' AND hidden IS NOT TRUE AND funding_type = 'Full' AND amount_usd >= 9000)
SELECT (SELECT count(*) FROM v) AS total, place, {SHOWN}, days_left, reasons FROM (SELECT *, row_number() OVER (ORDER BY amount_usd DESC NULLS LAST, id) - 30 AS place FROM v) WHERE place BETWEEN 1 AND 40""")
def listing_page(spark, sf_dir):
    """A page of the list with all of its columns, and the number of all rows that pass the filters."""
    rows = listed(spark, sf_dir).where(browse.visible() & browse.in_status("active", "") & browse.equal(funding_type="Full", country="any") & browse.at_least(9000)).withColumn("reasons", F.array_join("reasons", ","))
    return browse.listing(rows, "amount", 40, 30).select("total", F.explode("rows").alias("r")).select("total", "r.*")


@query(S + """, t AS (SELECT coalesce(tier, '?') AS tier, count(*) AS n FROM scored WHERE status = 'active' GROUP BY 1),
r AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 1), l AS (SELECT * FROM events WHERE event_type = 'purchase' ORDER BY event_id DESC LIMIT 1)
SELECT count(*) AS total, count_if(status = 'active' AND hidden IS NOT TRUE) AS active, count_if(status = 'active' AND hidden IS NOT TRUE AND gate_pass) AS eligible, count_if(starred) AS starred, count_if(hidden) AS hidden,
    max(amount_usd) AS max_award, min(deadline) FILTER (status = 'active') AS soonest, (SELECT string_agg(tier || ' ' || n, ', ' ORDER BY tier) FROM t) AS tiers,
    (SELECT 's' || user_id % 10 || ' ' || event_type || ' ' || strftime(ts, '%Y-%m-%d %H:%M') FROM r) AS last_run, (SELECT 'webhook sent ' || event_id % 40 || ' ' || strftime(ts, '%Y-%m-%d %H:%M') FROM l) AS last_notice FROM scored""")
def overview(spark, sf_dir):
    """Headline numbers with the last run and the last notification."""
    e = table(spark, sf_dir, "events").withColumnRenamed("event_id", "id")
    runs = e.select("id", F.expr("'s' || user_id % 10").alias("source"), F.col("event_type").alias("status"), F.col("ts").alias("started_at"))
    log = e.where("event_type = 'purchase'").select("id", F.lit("webhook").alias("channel"), F.lit(None).cast("string").alias("recipient"), F.expr("id % 40").alias("count"), F.lit("sent").alias("status"), F.col("ts").alias("created_at"), F.lit("").alias("detail"))
    out = browse.overview(scored(spark, sf_dir), runs, log)
    tiers = F.array_join(F.transform(F.map_entries("tiers"), lambda x: F.concat(x["key"], F.lit(" "), x["value"].cast("string"))), ", ")
    at = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm")
    return out.select("total", "active", "eligible", "starred", "hidden", "max_award", "soonest", tiers.alias("tiers"), F.concat_ws(" ", "last_run.source", "last_run.status", at("last_run.started_at")).alias("last_run"),
                      F.concat_ws(" ", "last_notice.channel", "last_notice.status", F.col("last_notice.count").cast("string"), at("last_notice.created_at")).alias("last_notice"))


@query("""WITH l AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 120), r AS (SELECT user_id % 10 AS source, arg_max(event_type, event_id) AS status, arg_max(value, event_id) AS cost, max(event_id) AS run FROM l GROUP BY 1)
SELECT source, run, status, cost, CAST(floor((SELECT sum(cost) FROM r) * 100 + 0.5) AS BIGINT) AS cents FROM r""", opps=False)
def source_costs(spark, sf_dir):
    """What each source's last run among the latest 120 cost, and all of them in cents."""
    runs = table(spark, sf_dir, "events").select("event_id", F.expr("user_id % 10").alias("source"), F.col("event_type").alias("status"), F.col("value").alias("cost"))
    last = telemetry.recent_per(runs.withColumn("run", F.col("event_id")), "source", "event_id")
    total = F.sum("cost").over(Window.partitionBy())  # of one row a source, 120 at most
    return last.select("source", "run", "status", "cost", F.floor(total * 100 + 0.5).alias("cents"))


@query("""WITH k AS (SELECT *, 'd' || user_id % 200 AS digest_key FROM events), d AS (SELECT * FROM k WHERE event_type <> 'purchase'), s AS (SELECT digest_key, ts FROM k WHERE event_type = 'purchase' AND event_id % 4 <> 0),
j AS (SELECT *, event_id % 40 AS rows, CASE WHEN event_id % 40 = 0 THEN 'nothing' WHEN EXISTS (SELECT 1 FROM s WHERE s.digest_key = d.digest_key AND s.ts BETWEEN d.ts - INTERVAL 20 HOUR AND d.ts) THEN 'duplicate' END AS stop FROM d),
c AS (SELECT *, unnest(CASE WHEN stop IS NULL THEN ['console', 'email', 'pager'] ELSE ['all'] END) AS channel FROM j)
SELECT event_id, channel, least(rows, 25) AS rows, coalesce(stop, CASE WHEN channel = 'pager' THEN 'unknown' WHEN channel <> 'console' AND (hour(ts) >= 22 OR hour(ts) < 7) THEN 'quiet' ELSE 'send' END) AS outcome,
    stop IS NULL AND channel <> 'pager' AND (channel = 'console' OR hour(ts) BETWEEN 7 AND 21) AS logged FROM c""", opps=False)
def deliveries(spark, sf_dir):
    """Which digest goes out on which channel: repeats, empty ones, quiet hours, unknown channels, the daily cap."""
    e = table(spark, sf_dir, "events").withColumn("digest_key", F.expr("'d' || user_id % 200"))
    log = e.where("event_type = 'purchase'").select("digest_key", F.col("ts").alias("created_at"), F.expr("IF(event_id % 4 = 0, 'failed', 'sent')").alias("status"))
    digests = e.where("event_type <> 'purchase'").select("event_id", "digest_key", F.col("ts").alias("at"), F.expr("event_id % 40").alias("rows"))
    return delivery.deliveries(digests, log, delivery.Policy(("console", "email", "pager"), 25, (22, 7))).select("event_id", "channel", "rows", "outcome", "logged")


@query(DIGEST + """ SELECT b.id, CAST(b.place AS INT) AS place, '<article><p>#' || b.place || ' · ' || replace(tier, '_', ' ') || ' · score ' || CAST(round_even(score, 0) AS INT) || '/100</p><h3>' || title || '</h3><p>'
    || coalesce(country, '?') || ' · ' || coalesce(degree_level, '?') || ' · ' || coalesce(funding_type, 'funding ?') || ' · <b>' || coalesce(strftime(deadline, '%d %b %Y'), 'rolling') || '</b></p><p>'
    || split_part(split_part(markdown, '💰 ', 2), '  ' || chr(10), 1) || '</p><p><span>' || replace(split_part(split_part(markdown, '▸ ', 2), chr(10), 1), ', ', '</span> <span>') || '</span></p>'
    || CASE WHEN warnings <> '' THEN '<p>⚠ ' || array_to_string(string_split(warnings, ',')[1:3], '; ') || '</p>' ELSE '' END || '<a href="' || replace(url, '&', '&amp;') || '">Apply</a></article>' AS html FROM best b JOIN texts t USING (id)""")
def digest_html(spark, sf_dir):
    """The digest's best 25 rows in HTML."""
    best = ranking.digest_rows(scored(spark, sf_dir), 45, 25)
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.coalesce("days_left", F.lit(9999)), "id"))  # of 25 rows
    return best.withColumn("place", place).select("id", "place", notices.digest_html(F.col("place").cast("string")).alias("html"))


@query(S + """ SELECT id, '<tr data-tier="' || tier || '" data-country="' || coalesce(country, '') || '" data-fundingtype="' || funding_type || '" data-source="' || source || '"><td>' || format('{:.1f}', floor(score * 10 + 0.5000001) / 10) || '</td><td>' || tier
    || '</td><td><a href="' || replace(url, '&', '&amp;') || '">' || title || '</a></td><td>' || coalesce(country, '') || '</td><td>' || coalesce(degree_level, '') || '</td><td>' || coalesce(field, '') || '</td><td>' || funding_type || '</td><td>'
    || coalesce(amount_text, '') || '</td><td>' || coalesce(strftime(deadline, '%Y-%m-%d'), 'rolling') || '</td><td>' || source || '</td><td>' || status || '</td></tr>' AS html FROM scored WHERE status = 'active'""")
def report_rows_html(spark, sf_dir):
    """Every active row as the HTML report shows it."""
    rows = scored(spark, sf_dir).where("status = 'active'")
    return rows.select("id", writers.html_row(rows.columns).alias("html"))
