"""Registered queries on notices: digests, amounts as shown, sections, links and model answers, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import coerce, notices
from gleanery.operators import archive, ranking
from gleanery.plans.opportunities import AS_OF, opportunities
from gleanery.plans.registry import S, TS, query, r2, scored

spark_sql = lambda sql: sql.replace("VARCHAR", "STRING")


def texts(spark, sf_dir, sql):
    """id and a text that varies with the row, which the SQL makes alike and reads anew."""
    return opportunities(spark, sf_dir).select("id", F.expr(spark_sql(sql)).alias("t"))


FEE = "CASE id % 5 WHEN 0 THEN 'The application fee is US$' || CAST(1 + id % 90 AS VARCHAR) || '.50 in all' WHEN 1 THEN 'Registration charge: EUR 1,0' || lpad(CAST(id % 100 AS VARCHAR), 2, '0') WHEN 2 THEN 'pay £' || CAST(5 + id % 40 AS VARCHAR) || ' as application fee' WHEN 3 THEN 'Application fee: none' ELSE 'Application charge €' || CAST(1 + id % 50 AS VARCHAR) || '.' END"


@query(rf"WITH f AS (SELECT id, {FEE} AS t FROM opps) SELECT id, round(TRY_CAST(replace(regexp_extract(t, '[0-9][0-9,]*(?:\.[0-9]+)?'), ',', '') AS DOUBLE) * CASE WHEN contains(t, '€') THEN CAST(1.09 AS DOUBLE) WHEN contains(t, '£') THEN CAST(1.27 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END, 2) AS fee FROM f")
def application_fee(spark, sf_dir):
    return texts(spark, sf_dir, FEE).select("id", notices.application_fee(F.col("t")).alias("fee"))


STATED = "CASE id % 4 WHEN 0 THEN '€' || CAST(100 + id % 900 AS VARCHAR) || ' per month' WHEN 1 THEN 'a full award' WHEN 2 THEN ' $' || CAST(100 + id % 900 AS VARCHAR) || ' /month ' ELSE amount_text END"
PAID = "CASE id % 4 WHEN 2 THEN CAST((100 + id % 900) * 10 + id % 2000 AS DOUBLE) ELSE amount_usd END"
LINE = """CASE WHEN coalesce(s, '') = '' THEN 'amount not stated' WHEN u IS NULL OR u = 0 THEN s
    WHEN abs(TRY_CAST(regexp_extract(s, '[0-9]{3,}') AS DOUBLE) * CASE WHEN contains(s, 'month') THEN 10 ELSE 1 END - u) / greatest(u, 1) < CAST(0.06 AS DOUBLE) THEN s
    ELSE s || '  ·  ≈ US$' || format('{:,}', CAST(round_even(u, 0) AS BIGINT)) || '/yr' END"""


@query(f"WITH m AS (SELECT id, trim({STATED}) AS s, {PAID} AS u FROM opps) SELECT id, {LINE} AS line FROM m")
def money_line(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", notices.money_line(F.expr(spark_sql(STATED)), F.expr(PAID)).alias("line"))


SECTION = "'Award ' || CAST(id AS VARCHAR) || chr(10) || CASE id % 3 WHEN 0 THEN 'Eligibility:' WHEN 1 THEN ' Who can apply' ELSE 'Costs' END || chr(10) || 'Citizens of ' || coalesce(country, '?') || '.' || chr(10) || chr(10) || 'Aged ' || CAST(id % 40 AS VARCHAR) || ' or less. ' || CASE id % 2 WHEN 0 THEN chr(10) || 'How to apply:' || chr(10) || 'Write to us.' ELSE '' END"


@query(rf"WITH p AS (SELECT id, {SECTION} AS t FROM opps) SELECT id, CASE WHEN id % 3 < 2 THEN trim(regexp_replace(split_part(split_part(t, chr(10) || 'How to', 1), CASE id % 3 WHEN 0 THEN 'Eligibility:' ELSE 'Who can apply' END, 2), '\s*\n\s*', ' ', 'g')) END AS body FROM p")
def section_text(spark, sf_dir):
    return texts(spark, sf_dir, SECTION).select("id", notices.section(F.col("t"), ("eligibility", "who can apply")).alias("body"))


LEVELS = "CASE id % 6 WHEN 0 THEN 'Any, also Master''s of ' || source WHEN 1 THEN 'Undergraduate / MBA' WHEN 2 THEN 'All levels' WHEN 3 THEN 'DPhil and post-doc' WHEN 4 THEN 'staff of ' || source END"


@query(f"WITH v AS (SELECT id, {LEVELS} AS t FROM opps) SELECT id, CASE WHEN contains(t, 'Master') THEN 'Master' WHEN contains(t, 'MBA') THEN 'Bachelor,Master' WHEN contains(t, 'All') THEN 'Any' WHEN contains(t, 'DPhil') THEN 'PhD,Postdoc' END AS levels FROM v")
def label_levels(spark, sf_dir):
    return texts(spark, sf_dir, LEVELS.replace("Master''s", "Masters")).select("id", notices.label_levels(F.col("t")).alias("levels"))


@query("SELECT id, ((country IS NOT NULL)::INT + (degree_level IS NOT NULL)::INT + (funding_type IS NOT NULL)::INT + (amount_text IS NOT NULL)::INT + (deadline IS NOT NULL)::INT + (field IS NOT NULL)::INT) / CAST(6 AS DOUBLE) AS share FROM opps")
def completeness(spark, sf_dir):
    fields = [F.col(c) for c in ("country", "degree_level", "funding_type", "amount_text", "deadline", "field")]
    return opportunities(spark, sf_dir).select("id", notices.completeness(*fields).alias("share"))


LINK = "CASE id % 5 WHEN 0 THEN 'https://t.me/c/' || CAST(100000 + id AS VARCHAR) || '?x=1' WHEN 1 THEN ' -100' || CAST(1000 + id AS VARCHAR) WHEN 2 THEN 'https://api.example.org/bot' || CAST(1000000 + id AS VARCHAR) || ':' || md5(CAST(id AS VARCHAR)) || '/send' WHEN 3 THEN CAST(2000000 + id AS VARCHAR) || ':' || md5(CAST(id AS VARCHAR)) ELSE 'none at ' || source END"


@query(f"""WITH l AS (SELECT id, {LINK} AS t FROM opps), k AS (SELECT *, CASE WHEN id % 5 IN (2, 3) THEN regexp_extract(t, '[0-9]{{7,12}}:[0-9a-f]{{32}}') END AS token FROM l)
SELECT id, CASE WHEN id % 5 < 2 THEN regexp_extract(t, '-?[0-9]{{4,}}') END AS chat, token, split_part(token, ':', 1) || ':' || substr(split_part(token, ':', 2), 1, 2) || '…' || right(token, 2) AS shown FROM k""")
def chat_links(spark, sf_dir):
    token = notices.bot_token(F.col("t"))
    return texts(spark, sf_dir, LINK).select("id", notices.chat_id(F.col("t")).alias("chat"), token.alias("token"), notices.token_shown(token).alias("shown"))


OBJECT = """'{"country": "' || coalesce(country, 'N/A') || '", "n": ' || CAST(id % 100 AS VARCHAR) || '}'"""
ANSWER = f"CASE id % 5 WHEN 0 THEN {OBJECT} WHEN 1 THEN '```json' || chr(10) || {OBJECT} || chr(10) || '```' WHEN 2 THEN 'Here it is: ' || {OBJECT} || ' as asked' WHEN 3 THEN 'I can not tell.' ELSE {OBJECT} || '}}' END"


@query("SELECT id, CASE WHEN id % 5 < 3 THEN country END AS country, CASE WHEN id % 5 < 3 THEN id % 100 END AS n FROM opps")
def model_answers(spark, sf_dir):
    """The fields of a model's answers, in fences, in prose or as they are; what can't be parsed says nothing."""
    told = texts(spark, sf_dir, ANSWER).select("id", F.from_json(notices.answer_json(F.col("t")), "country string, n long").alias("a"))
    return told.select("id", notices.answer_field(F.col("a.country")).alias("country"), F.col("a.n").alias("n"))


STAGED = "CASE WHEN id % 3 = 0 THEN NULL ELSE degree_level END"


@query(f"""WITH told AS (SELECT title, min(degree_level) AS degree_level, max(field) AS field FROM opps WHERE status <> 'active' GROUP BY title)
SELECT o.id, coalesce(t.degree_level, o.own) AS degree_level, coalesce(t.field, o.field) AS field, t.title IS NOT NULL AS used FROM (SELECT *, {STAGED} AS own FROM opps) o LEFT JOIN told t USING (title)""")
def staged_results(spark, sf_dir):
    """Staged records with the model's results for their key, which win where they say something."""
    o = opportunities(spark, sf_dir)
    told = o.where("status <> 'active'").groupBy("title").agg(F.min("degree_level").alias("told_level"), F.max("field").alias("told_field")).withColumn("t", F.lit(True))
    both = o.withColumn("own", F.expr(STAGED)).join(told, "title", "left")
    return both.select("id", coerce.filled(F.col("told_level"), F.col("own"), "string").alias("degree_level"), coerce.filled(F.col("told_field"), F.col("field"), "string").alias("field"), F.col("t").isNotNull().alias("used"))


@query("""SELECT id, CASE WHEN id % 7 = 0 THEN 'unchanged' WHEN coalesce(length(source || description), 0) < 40 THEN 'rejected' WHEN length(coalesce(field, '')) < 6 THEN 'rejected' ELSE 'kept' END AS outcome FROM opps""")
def candidate_outcomes(spark, sf_dir):
    """A candidate that is marked as known is unchanged; one with a text under 40 or a title under 6 characters is rejected."""
    rows = opportunities(spark, sf_dir).select("id", (F.col("id") % 7 == 0).alias("skip"), F.concat("source", "description").alias("text"), F.col("field").alias("title"))
    return rows.select("id", archive.candidate_outcome(F.col("skip"), F.col("text"), F.col("title")).alias("outcome"))


@query(f"""WITH s AS (SELECT CASE WHEN status <> 'active' THEN status WHEN deadline < {TS} THEN 'expired' WHEN date_diff('second', last_seen, {TS}) // 86400 > 45 THEN 'stale' WHEN date_diff('second', first_seen, {TS}) // 86400 > 400 THEN 'outdated' ELSE 'active' END AS new_status, status FROM opps)
SELECT count_if(new_status = 'expired') AS expired, count_if(new_status = 'stale') AS stale, count_if(new_status = 'outdated') AS outdated FROM s WHERE status = 'active'""")
def lifecycle_counts(spark, sf_dir):
    """How many active rows the sweep moves to each status."""
    moved = opportunities(spark, sf_dir).where("status = 'active'").select(archive.swept(AS_OF).alias("s"))
    return moved.agg(*[F.count_if(F.col("s") == k).alias(k) for k in ("expired", "stale", "outdated")])


PARTS = {"country": "country", "field": "field", "funding": "funding", "amount": "amount", "degree": "degree", "competition": "competition", "english_ready": "english", "research": "research"}
TOP = "list_sort([" + ", ".join(f"{{'a': -({r2('p_' + c)}), 'n': '{k}'}}" for k, c in PARTS.items()) + "])[1:4]"
DIGEST = S + f""", best AS (SELECT *, row_number() OVER (ORDER BY score DESC, coalesce(days_left, 9999), id) AS place FROM scored WHERE gate_pass AND score >= 45),
texts AS (SELECT id, place, '**' || place || '. ' || title || '**  ' || chr(10) || coalesce(country, '?') || ' · ' || coalesce(degree_level, '?') || ' · ' || coalesce(funding_type, 'funding ?') || ' · **' || coalesce(strftime(deadline, '%d %b %Y'), 'rolling') || '**  ' || chr(10)
    || '💰 ' || ({LINE.replace("(s, ", "(amount_text, ").replace("coalesce(s", "coalesce(amount_text").replace("THEN s", "THEN amount_text").replace("ELSE s ", "ELSE amount_text ").replace("u IS NULL OR u", "amount_usd IS NULL OR amount_usd").replace("- u)", "- amount_usd)").replace("greatest(u", "greatest(amount_usd").replace("round_even(u", "round_even(amount_usd")}) || '  ' || chr(10)
    || '`' || replace(tier, '_', ' ') || ' · score ' || CAST(round_even(score, 0) AS INT) || ' · conf ' || CAST(round_even(confidence * CAST(100 AS DOUBLE), 0) AS INT) || '%`' || chr(10)
    || '▸ ' || array_to_string(list_transform({TOP}, lambda e: e.n || ' ' || CAST(round_even(-e.a, 0) AS INT)), ', ') || chr(10)
    || CASE WHEN warnings <> '' THEN '⚠ ' || array_to_string(string_split(warnings, ',')[1:2], '; ') || chr(10) ELSE '' END || '[Apply / details](' || url || ')' AS markdown FROM best WHERE place <= 25)"""


@query(DIGEST + " SELECT id, CAST(place AS INT) AS place, markdown, replace(replace(replace(replace(replace(markdown, '**', ''), '`', ''), '[Apply / details](', 'Apply / details — '), '.html)', '.html'), '#top)', '#top') AS plain FROM (SELECT id, place, markdown FROM texts)")
def digest_entries(spark, sf_dir):
    """The digest's best 25 rows, each in Markdown and in plain text."""
    best = ranking.digest_rows(scored(spark, sf_dir), 45, 25)
    place = F.row_number().over(Window.orderBy(F.desc("score"), F.coalesce("days_left", F.lit(9999)), "id"))  # of 25 rows
    out = best.withColumn("place", place).select("id", "place", notices.digest_entry(F.col("place").cast("string")).alias("markdown"))
    return out.withColumn("plain", notices.unmarked(F.col("markdown")))
