"""Registered queries on raw records, countries, runs and caches, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gleanery.functions import coerce, countries
from gleanery.functions.identity import clean_title
from gleanery.plans.opportunities import opportunities
from gleanery.plans.registry import S, query, scored
from gleanery.session import table

# ---- raw values: the texts vary with the row, the SQL reads them anew
RAW = {
    "day": "CASE id % 6 WHEN 0 THEN '1999-' || CAST(1 + id % 13 AS VARCHAR) || '-' || CAST(1 + id % 31 AS VARCHAR) WHEN 1 THEN lpad(CAST(1 + id % 31 AS VARCHAR), 2, '0') || '/' || lpad(CAST(1 + id % 12 AS VARCHAR), 2, '0') || '/1999' WHEN 2 THEN CAST(1 + id % 28 AS VARCHAR) || ' Mar 2001' WHEN 3 THEN CAST(1 + id % 31 AS VARCHAR) || ' June 2002' WHEN 4 THEN 'N/A' ELSE 'soon' END",
    "number": "CASE id % 5 WHEN 0 THEN 'about ' || CAST(id % 90 AS VARCHAR) || ',5 points' WHEN 1 THEN 'USD ' || CAST(id AS VARCHAR) WHEN 2 THEN CAST(id % 10 AS VARCHAR) || '.25/10' WHEN 3 THEN 'none' END",
    "level": "CASE id % 7 WHEN 0 THEN 'Undergraduate or Master''s' WHEN 1 THEN 'PhD, post-doc' WHEN 2 THEN 'any' WHEN 3 THEN 'Foundation course' WHEN 4 THEN 'null' WHEN 5 THEN 'MSc / M.Sc' ELSE 'staff' END",
    "funding": "CASE id % 6 WHEN 0 THEN 'Fully funded' WHEN 1 THEN 'Tuition-only' WHEN 2 THEN 'a fee waiver' WHEN 3 THEN 'Partial' WHEN 4 THEN '' ELSE 'varies' END",
    "items": "coalesce(country, 'n/a') || '; ' || lower(coalesce(country, '')) || ' ,-' || coalesce(degree_level, 'unknown') || '.| item ' || CAST(id % 9 AS VARCHAR) || '|'",
    "heading": "'  ' || title || '  ' || CAST(id AS VARCHAR) || CASE id % 3 WHEN 0 THEN ' | Read more here' WHEN 1 THEN ' • apply NOW' ELSE ' | Site' END",
}
VIEW = "WITH raw AS (SELECT id, source, country, " + ", ".join(f"{sql} AS r_{k}" for k, sql in RAW.items()) + " FROM opps)"


def raw(spark, sf_dir):
    cols = [F.expr(sql.replace("VARCHAR", "STRING").replace("''", "\\'") if k == "level" else sql.replace("VARCHAR", "STRING")).alias(f"r_{k}") for k, sql in RAW.items()]
    return opportunities(spark, sf_dir).select("id", "source", "country", *cols)


DAY = "CAST(coalesce(try_strptime(r_day, '%Y-%m-%d'), try_strptime(r_day, '%d/%m/%Y'), try_strptime(r_day, '%m/%d/%Y'), try_strptime(r_day, '%d %b %Y'), try_strptime(r_day, '%d %B %Y')) AS DATE)"
NUMBER = "TRY_CAST(replace(regexp_extract(r_number, '[0-9]+(?:[.,][0-9]+)?'), ',', '.') AS DOUBLE)"


@query(f"{VIEW} SELECT id, {DAY} AS day FROM raw")
def coerce_dates(spark, sf_dir):
    return raw(spark, sf_dir).select("id", coerce.date_of(F.col("r_day")).alias("day"))


@query(f"{VIEW} SELECT id, {NUMBER} AS number, TRY_CAST(regexp_extract(r_number, '[0-9]{{1,3}}') AS INT) AS n FROM raw")
def coerce_numbers(spark, sf_dir):
    return raw(spark, sf_dir).select("id", coerce.number_in(F.col("r_number")).alias("number"), coerce.count_in(F.col("r_number")).alias("n"))


LEVEL = "CASE r_level WHEN 'Undergraduate or Master''s' THEN 'Bachelor,Master' WHEN 'PhD, post-doc' THEN 'PhD,Postdoc' WHEN 'Foundation course' THEN 'Diploma' WHEN 'MSc / M.Sc' THEN 'Master' WHEN 'null' THEN NULL ELSE 'Any' END"
FUNDING = "CASE WHEN r_funding = '' THEN NULL WHEN r_funding ILIKE '%full%' THEN 'Full' WHEN r_funding ILIKE '%tuition only%' OR r_funding ILIKE '%tuition-only%' OR r_funding ILIKE '%waiver%' THEN 'Tuition-only' WHEN r_funding ILIKE '%partial%' THEN 'Partial' ELSE 'Unknown' END"


@query(f"{VIEW} SELECT id, {LEVEL} AS level, {FUNDING} AS funding FROM raw")
def coerce_classes(spark, sf_dir):
    return raw(spark, sf_dir).select("id", coerce.level(F.col("r_level")).alias("level"), coerce.funding(F.col("r_funding")).alias("funding"))


ITEMS = """parts AS (SELECT id, list_filter(list_transform(regexp_split_to_array(r_items, '[,;|]'), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'), ' .-')), lambda x: x <> '' AND lower(x) NOT IN ('null', 'n/a', 'none', 'unknown')) AS xs FROM raw),
firsts AS (SELECT id, list_filter(xs, lambda x, i: list_position(list_transform(xs, lambda y: lower(y)), lower(x)) = i) AS xs FROM parts)"""


@query(f"{VIEW}, {ITEMS} SELECT id, array_to_string(xs, '|') AS items FROM firsts")
def coerce_lists(spark, sf_dir):
    return raw(spark, sf_dir).select("id", F.array_join(coerce.listed(F.col("r_items")), "|").alias("items"))


TITLE = r"substr(regexp_replace(trim(regexp_replace(r_heading, '\s+', ' ', 'g')), '(?i)\s*[|•]\s*(Read more|Apply now).*', ''), 1, 400)"


@query(f"{VIEW} SELECT id, {TITLE} AS title, {DAY} AS deadline, {NUMBER} AS amount, {LEVEL} AS level, {FUNDING} AS funding, ({DAY} IS NULL AND r_day <> 'N/A')::INT + ({NUMBER} IS NULL AND r_number IS NOT NULL)::INT AS dropped FROM raw")
def record_repair(spark, sf_dir):
    """A raw record as a typed one: fields that can't be read become null, and are counted, instead of costing the row."""
    day, number = coerce.date_of(F.col("r_day")), coerce.number_in(F.col("r_number"))
    lost = (day.isNull() & (F.col("r_day") != "N/A")).cast("int") + (number.isNull() & F.col("r_number").isNotNull()).cast("int")
    return raw(spark, sf_dir).select("id", coerce.record_title(F.col("r_heading")).alias("title"), day.alias("deadline"), number.alias("amount"), coerce.level(F.col("r_level")).alias("level"),
                                     coerce.funding(F.col("r_funding")).alias("funding"), lost.alias("dropped"))


@query(r"SELECT id, trim(regexp_replace(t, '\s+[|·•]\s+[A-Z][^|·•]*$', '')) AS title FROM (SELECT id, trim(regexp_replace(title || ' | Site ' || CAST(id % 7 AS VARCHAR), '\s+[|·•]\s+[A-Z][^|·•]*$', '')) AS t FROM opps)")
def title_clean(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", clean_title(F.concat("title", F.lit(" | Site "), (F.col("id") % 7).cast("string"))).alias("title"))


OWN = {"country": "CASE WHEN id % 2 = 0 THEN country END", "field": "CASE WHEN id % 3 = 0 THEN '' ELSE field END", "amount_usd": "CASE WHEN id % 5 = 0 THEN NULL ELSE amount_usd END", "starred": "id % 7 = 0"}
OTHER = {"country": "'OTHER'", "field": "title", "amount_usd": "CAST(id AS DOUBLE)", "starred": "CAST(id % 4 = 0 AS BOOLEAN)"}


@query("SELECT id, coalesce(" + OWN["country"] + ", 'OTHER') AS country, coalesce(nullif(" + OWN["field"] + ", ''), title) AS field, coalesce(" + OWN["amount_usd"] + ", CAST(id AS DOUBLE)) AS amount_usd, id % 7 = 0 OR id % 4 = 0 AS starred FROM opps")
def merged_over(spark, sf_dir):
    """A record with what it does not say taken from one that is trusted less."""
    kinds = {"country": "string", "field": "string", "amount_usd": "double", "starred": "boolean"}
    o = opportunities(spark, sf_dir)
    return o.select("id", *[coerce.filled(F.expr(OWN[k]), F.expr(OTHER[k]), kind).alias(k) for k, kind in kinds.items()])


NAMED = "translate(coalesce(country, 'Peru'), '_0123456789', ' ABCDEFGHIJ') || CASE id % 4 WHEN 0 THEN ', New  Zealand and ' || source || ' for all nationals || Read more' WHEN 1 THEN '; Oman - and the Cook Islands.' WHEN 2 THEN ' intended for women, ' || CAST(id AS VARCHAR) || ' of them' ELSE '' END"


@query(rf"""WITH v AS (SELECT id, {NAMED} AS t FROM opps), i AS (SELECT id, list_transform(regexp_split_to_array(split_part(t, '||', 1), '[,;]|\band\b'), lambda p: trim(regexp_replace(regexp_replace(p, '\b(for|intended)\b.*$', ''), '\s+', ' ', 'g'), ' .-')) AS xs FROM v),
k AS (SELECT id, list_filter(xs, lambda p: length(p) BETWEEN 3 AND 64 AND NOT regexp_matches(p, '[0-9]')) AS xs FROM i) SELECT id, xs[1] AS host, array_to_string(xs, '|') AS named FROM k""")
def label_countries(spark, sf_dir):
    found = coerce.label_countries(F.expr(NAMED.replace("VARCHAR", "STRING")))
    return opportunities(spark, sf_dir).select("id", found[0].alias("host"), F.array_join(found, "|").alias("named"))


OPEN = "CASE id % 4 WHEN 0 THEN 'Open to any Subject at ' || source WHEN 1 THEN coalesce(field, 'Any') WHEN 2 THEN 'All disciplines, ' || title ELSE 'Some topics at company ' || source END"


@query(rf"WITH v AS (SELECT id, ' ' || regexp_replace(lower({OPEN}), '[^a-z0-9]+', ' ', 'g') || ' ' AS t FROM opps) SELECT id, contains(t, ' any subject ') OR contains(t, ' any field ') OR contains(t, ' all disciplines ') OR t = ' any ' AS every FROM v")
def any_field_signal(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", coerce.any_field(F.expr(OPEN)).alias("every"))


@query(r"SELECT id, substr(sha256(source || '|' || url), 1, 24) AS candidate, substr(sha256(source), 1, 10) AS token, substr(sha256(lower(trim(regexp_replace(title || '  X ', '\s+', ' ', 'g')))), 1, 32) AS prompt, CASE WHEN length(source) > 4 THEN '…' || right(source, 4) ELSE '…' END AS shown FROM opps")
def short_keys(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", coerce.hash_key(F.concat("source", F.lit("|"), "url"), 24).alias("candidate"), coerce.hash_key(F.col("source"), 10).alias("token"),
                                               coerce.prompt_key(F.concat("title", F.lit("  X "))).alias("prompt"), coerce.masked(F.col("source")).alias("shown"))


# ---- countries; what is right is written down here, not computed
NAMES = [n.replace("_", " ") for n in (
    "ALGERIA ARGENTINA BRAZIL CANADA EGYPT ETHIOPIA FRANCE GERMANY INDIA INDONESIA IRAN IRAQ JAPAN JORDAN KENYA MOROCCO MOZAMBIQUE PERU CHINA ROMANIA "
    "SAUDI_ARABIA VIETNAM RUSSIA UNITED_KINGDOM UNITED_STATES").split()]
NATION = f"WITH n AS (SELECT n_nationkey, [{', '.join(map(repr, NAMES))}][CAST(n_nationkey % 25 + 1 AS INT)] AS name FROM nation)"
INSIDE = {
    "Developing Countries": "ALGERIA ARGENTINA BRAZIL EGYPT ETHIOPIA INDIA INDONESIA IRAN IRAQ JORDAN KENYA MOROCCO MOZAMBIQUE PERU CHINA VIETNAM",
    "Latin America and others": "ARGENTINA BRAZIL PERU", "ASEAN member states": "INDONESIA VIETNAM", "European Union (27)": "FRANCE GERMANY ROMANIA",
    "Arab League": "ALGERIA EGYPT IRAQ JORDAN MOROCCO SAUDI_ARABIA",
}


def nations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array(*map(F.lit, NAMES))[(F.col("n_nationkey") % 25).cast("int")].alias("name"))


@query(f"{NATION} " + " UNION ALL ".join("SELECT n_nationkey, '{}' AS phrase, name IN ({}) AS inside FROM n".format(p, ", ".join(repr(m.replace("_", " ")) for m in m_.split())) for p, m_ in INSIDE.items()), opps=False)
def group_expand(spark, sf_dir):
    """Whether each nation belongs to the group that a phrase names."""
    n = nations(spark, sf_dir).withColumn("phrase", F.explode(F.array(*map(F.lit, INSIDE))))
    return n.select("n_nationkey", "phrase", F.array_contains(countries.members(countries.group_of(F.col("phrase"))), countries.canon(F.col("name"))).alias("inside"))


# ---- runs, caches, policies
@query(S + " SELECT count(*) AS total FROM scored WHERE status = 'active' AND gate_pass IS TRUE AND hidden IS NOT TRUE AND country = 'NATION_4'")
def total_filtered(spark, sf_dir):
    return scored(spark, sf_dir).where("status = 'active' AND gate_pass IS TRUE AND hidden IS NOT TRUE AND country = 'NATION_4'").agg(F.count("*").alias("total"))


@query(S + " SELECT id, score FROM (SELECT * FROM scored WHERE gate_pass AND score >= 45 ORDER BY score DESC, coalesce(days_left, 9999), id LIMIT 25) ORDER BY score DESC, coalesce(days_left, 9999), id LIMIT 10")
def daily_cap(spark, sf_dir):
    """The digest's rows up to the day's limit of ten."""
    from gleanery.operators import ranking

    return ranking.digest_rows(scored(spark, sf_dir), 45, 25).limit(10).select("id", "score")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id DESC LIMIT 120", opps=False)
def runs_latest(spark, sf_dir):
    return table(spark, sf_dir, "events").orderBy(F.desc("event_id")).limit(120).select("event_id", "user_id", "event_type")


@query("""WITH enabled AS (SELECT DISTINCT source FROM opps), asked AS (SELECT * FROM (VALUES ('1-URGENT'), ('5-LOW'), ('7-NONE')) t(source))
SELECT a.source, e.source IS NOT NULL AS runs FROM asked a LEFT JOIN enabled e USING (source)""")
def requested_sources(spark, sf_dir):
    """Of the sources asked for, which run and which are unknown, to be warned about."""
    asked = F.broadcast(spark.createDataFrame([("1-URGENT",), ("5-LOW",), ("7-NONE",)], "source string"))  # what a user asks for
    enabled = opportunities(spark, sf_dir).select("source").distinct().withColumn("runs", F.lit(True))
    return asked.join(enabled, "source", "left").select("source", F.coalesce("runs", F.lit(False)).alias("runs"))


@query("""WITH latest AS (SELECT user_id, max(event_id) AS event_id FROM events GROUP BY user_id)
SELECT c_custkey AS source, l.event_id, e.event_type FROM customer LEFT JOIN latest l ON c_custkey = l.user_id LEFT JOIN events e ON l.event_id = e.event_id""", opps=False)
def sources_last_run(spark, sf_dir):
    """Every source with its last run, if it has had one."""
    latest = table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("event_type"))
    return table(spark, sf_dir, "customer").join(latest, F.expr("c_custkey = user_id"), "left").select(F.col("c_custkey").alias("source"), "event_id", "event_type")


@query("SELECT user_id % 10 AS source, count(*) AS n, CAST(sum(CASE WHEN event_type = 'view' THEN least(value, 40) ELSE 0 END) * 1000 AS BIGINT) // 1000 AS most_fetches FROM events GROUP BY 1", opps=False)
def detail_bound(spark, sf_dir):
    """The most detail pages that a night may fetch: the listings' limits added up."""
    bound = (F.sum(F.expr("CASE WHEN event_type = 'view' THEN least(value, 40) ELSE 0 END")) * 1000).cast("long")
    e = table(spark, sf_dir, "events").groupBy((F.col("user_id") % 10).alias("source")).agg(F.count("*").alias("n"), bound.alias("b"))
    return e.select("source", "n", F.expr("b DIV 1000").alias("most_fetches"))


@query("""WITH r AS (SELECT CAST(ts AS DATE) AS day, user_id, count_if(event_type = 'view') AS found, count_if(event_type = 'error') AS errors FROM events GROUP BY 1, 2)
SELECT day, count(*) AS sources, bool_and(found = 0) AS all_failed, coalesce(string_agg(CASE WHEN found = 0 AND errors > 0 THEN CAST(user_id AS VARCHAR) END, ',' ORDER BY user_id), '') AS failed, CASE WHEN bool_and(found = 0) THEN 1 ELSE 0 END AS exit_code FROM r GROUP BY day""", opps=False)
def ci_summary(spark, sf_dir):
    """Per run: its sources, those that failed, and whether all did, which fails the run."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.count_if(F.col("event_type") == "view").alias("found"), F.count_if(F.col("event_type") == "error").alias("errors"))
    failed = F.array_sort(F.collect_list(F.expr("IF(found = 0 AND errors > 0, user_id, NULL)")))  # of one run's sources
    out = e.groupBy("day").agg(F.count("*").alias("sources"), F.bool_and(F.col("found") == 0).alias("all_failed"), failed.alias("f"))
    return out.select("day", "sources", "all_failed", F.array_join("f", ",").alias("failed"), F.col("all_failed").cast("int").alias("exit_code"))


CACHE = "cache AS (SELECT substr(sha256(lower(title)), 1, 32) AS key, min(id) AS answer FROM opps WHERE status <> 'active' GROUP BY 1)"


@query(f"WITH {CACHE} SELECT o.id, c.answer, c.key IS NULL AS asked FROM opps o LEFT JOIN cache c ON substr(sha256(lower(title)), 1, 32) = c.key")
def parse_cache(spark, sf_dir):
    """Every row with the remembered answer to its text; those without one go on to be asked."""
    o = opportunities(spark, sf_dir).withColumn("key", coerce.hash_key(F.lower("title"), 32))
    cache = o.where("status <> 'active'").groupBy("key").agg(F.min("id").alias("answer"))
    return o.join(cache, "key", "left").select("id", "answer", F.col("answer").isNull().alias("asked"))


@query("""WITH f AS (SELECT *, concat_ws('|', title, country, CAST(amount_usd AS VARCHAR)) AS facts FROM opps), prior AS (SELECT country, title, max(facts) AS facts FROM f WHERE status <> 'active' GROUP BY country, title)
SELECT f.id, coalesce(p.facts = f.facts, FALSE) AS skipped FROM f LEFT JOIN prior p ON f.country = p.country AND f.title = p.title""")
def facts_skip(spark, sf_dir):
    """Rows whose facts are those of the archive's row, which need no comparison field by field."""
    f = opportunities(spark, sf_dir).withColumn("facts", F.concat_ws("|", "title", "country", F.col("amount_usd").cast("string")))
    prior = f.where("status <> 'active'").groupBy("country", "title").agg(F.max("facts").alias("prior"))
    return f.join(prior, ["country", "title"], "left").select("id", F.coalesce(F.col("prior") == F.col("facts"), F.lit(False)).alias("skipped"))


@query("""SELECT page_id, ts AS fetched_at, ts + INTERVAL 36 HOUR >= TIMESTAMP '1998-08-02 00:00:00' AND ts <= TIMESTAMP '1998-08-02 00:00:00' AS fresh FROM
(SELECT page_id, TIMESTAMP '1998-08-02 00:00:00' - INTERVAL 1 HOUR * (page_id % 60) AS ts FROM pages)""", opps=False)
def cache_fresh(spark, sf_dir):
    """Whether a cached page is young enough to serve, 36 hours at most."""
    now = "TIMESTAMP_NTZ '1998-08-02 00:00:00'"
    p = table(spark, sf_dir, "pages").select("page_id", F.expr(f"{now} - make_dt_interval(0, CAST(page_id % 60 AS INT))").alias("fetched_at"))
    return p.withColumn("fresh", F.expr(f"fetched_at + INTERVAL '36' HOUR >= {now} AND fetched_at <= {now}"))


@query("""WITH touched AS (SELECT DISTINCT url FROM opps WHERE is_new)
SELECT o.id, 1 + CAST(t.url IS NOT NULL AS INT) AS times_seen FROM opps o LEFT JOIN touched t USING (url)""")
def touch_merge(spark, sf_dir):
    """Rows of pages that were skipped as known are seen once more, and nothing else of them changes."""
    o = opportunities(spark, sf_dir)
    touched = o.where("is_new").select("url").distinct().withColumn("t", F.lit(1))
    return o.join(touched, "url", "left").select("id", (1 + F.coalesce("t", F.lit(0))).alias("times_seen"))


@query("""SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY last_seen DESC, id) AS place FROM opps QUALIFY place <= 4""")
def latest_seen(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    place = F.row_number().over(Window.partitionBy("source").orderBy(F.desc("last_seen"), "id")).cast("long")
    return o.select("id", "source", place.alias("place")).where("place <= 4")
