"""The registered queries, with the same in DuckDB's SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import dates, facts, identity, money, pages, record
from gleanery.functions import labels as labelled
from gleanery.operators import archive, browse, match, ranking, telemetry
from gleanery.plans.opportunities import AS_OF, OPPS, opportunities
from gleanery.session import dealt, table
from gleanery.sources import readers, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
TS = f"TIMESTAMP '{AS_OF}'"
P = match.Profile()


def query(sql: str | None = None, opps: bool = True):
    """Registers a function under its name; `sql` follows the opportunity view if `opps`."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            ORACLE_SQL[f.__name__] = (f"WITH {OPPS}" + (", " + body[5:] if body[:5].upper() == "WITH " else " " + body)) if opps else body
        return f

    return add


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match.evaluate(opportunities(spark, sf_dir), P, AS_OF)


# ---- the score, as SQL
RND = "floor(({0}) * {1} + 0.5000001) / {1}"
r2 = lambda x: RND.format(x, "100.0")
DAYS = f"CAST(floor(date_diff('second', {TS}, deadline) / 86400.0) AS INT)"
SCALE = "(CASE WHEN TRY_CAST(regexp_extract(coalesce(gpa_scale, ''), '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) BETWEEN 1 AND 10 THEN TRY_CAST(regexp_extract(coalesce(gpa_scale, ''), '([0-9]+(?:\\.[0-9]+)?)', 1) AS DOUBLE) ELSE 4.0 END)"
RULES = {
    "excluded": ("h", "coalesce(list_contains(string_split(excluded, ','), 'NATION_3'), FALSE)"),
    "not_listed": ("h", "NOT coalesce(list_contains(string_split(excluded, ','), 'NATION_3'), FALSE) AND eligible IS NOT NULL AND NOT list_contains(string_split(eligible, ','), 'NATION_3')"),
    "list_unclear": ("w", "NOT coalesce(list_contains(string_split(excluded, ','), 'NATION_3'), FALSE) AND eligible IS NULL AND excluded IS NOT NULL"),
    "blocked": ("h", "country = 'NATION_9'"),
    "degree": ("h", "NOT list_has_any(string_split(lower(degree_level), ','), ['master', 'any', 'all'])"),
    "degree_unknown": ("w", "degree_level IS NULL"),
    "funding_short": ("w", "lower(funding_type) IN ('partial', 'tuition-only') AND coalesce(amount_usd, 0) < 12000"),
    "fee": ("w", "application_fee_usd > 50"),
    "tuition_only": ("w", "lower(funding_type) = 'tuition-only' AND coalesce(amount_usd, 0) <= 0"),
    "gpa": ("h", f"(CASE WHEN abs({SCALE} - 4.0) < 0.01 THEN 3.5 ELSE 3.5 * {SCALE} / 4.0 END) + 1e-9 < min_gpa"),
    "ielts": ("h", "7.5 + 1e-9 < min_ielts"),
    "toefl": ("h", "100 < min_toefl"),
    "age": ("h", "24 > max_age"),
    "experience": ("h", "1.5 + 1e-9 < min_work_experience_years"),
    "degree_age": ("h", "1998 - 1995 > max_years_since_degree"),
    "gre": ("w", "requires_gre"),
    "past": ("h", f"{DAYS} < 0"),
    "far_out": ("w", f"{DAYS} > 240"),
    "no_deadline": ("w", "deadline IS NULL AND NOT coalesce(deadline_rolling, FALSE)"),
}
named = lambda kind: "concat_ws(',', " + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, (k, c) in RULES.items() if k == kind) + ")"
SHARE = "((CASE WHEN title <> '' THEN 1 ELSE 0 END + CASE WHEN deadline IS NOT NULL OR deadline_rolling THEN 1 ELSE 0 END + CASE WHEN country <> '' THEN 1 ELSE 0 END + CASE WHEN degree_level <> '' THEN 1 ELSE 0 END + CASE WHEN funding_type <> '' THEN 1 ELSE 0 END) / CAST(5 AS DOUBLE))"
SCORED = f"""
gated AS (SELECT *, {named('h')} AS reasons, {named('w')} AS warnings, {DAYS} AS days_left,
    {RND.format(f"least(1.0, greatest(0.2, 0.45 + 0.45 * {SHARE} + (CAST(0.06 AS DOUBLE) * CASE WHEN amount_text <> '' THEN 1 ELSE 0 END + CAST(0.06 AS DOUBLE) * CASE WHEN eligibility <> '' THEN 1 ELSE 0 END + CAST(0.04 AS DOUBLE) * CASE WHEN field <> '' THEN 1 ELSE 0 END + CASE WHEN contains(coalesce(parse_method, ''), 'regex') AND {SHARE} >= 1.0 THEN CAST(0.08 AS DOUBLE) WHEN coalesce(parse_method, '') IN ('', 'none') THEN CAST(-0.05 AS DOUBLE) ELSE 0 END)))", "CAST(1000 AS DOUBLE)")} AS confidence FROM opps),
parted AS (SELECT *, reasons = '' AS gate_pass,
    CASE WHEN country IN ('NATION_5', 'NATION_7', 'NATION_11') THEN CAST(1.0 AS DOUBLE) WHEN country IS NOT NULL THEN 0.25 ELSE 0.4 END * 22 AS p_country,
    CASE WHEN contains(lower(field), 'law') THEN CAST(0.0 AS DOUBLE) WHEN field IS NULL THEN 0.4 WHEN contains(lower(field), 'data') OR contains(lower(field), 'machine learning') OR contains(lower(field), 'ml') THEN 1.0 WHEN contains(lower(field), 'any') THEN 0.85
        WHEN contains(lower(field), 'stem') OR contains(lower(field), 'engineering') OR contains(lower(field), 'comput') OR contains(lower(field), 'science') THEN 0.5 ELSE 0.05 END * 16 AS p_field,
    CASE lower(funding_type) WHEN 'full' THEN CAST(1.0 AS DOUBLE) WHEN 'tuition-only' THEN 0.45 WHEN 'partial' THEN 0.35 ELSE 0.2 END * 18 AS p_funding,
    CASE WHEN coalesce(amount_usd, 0) > 0 THEN CAST(0.35 AS DOUBLE) + CAST(0.65 AS DOUBLE) * least(CAST(1.0 AS DOUBLE), amount_usd / CAST(25000 AS DOUBLE)) WHEN funding_type = 'Full' THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END * 12 AS p_amount,
    CASE WHEN degree_level IS NULL OR contains(lower(degree_level), 'any') THEN CAST(0.9 AS DOUBLE) WHEN list_contains(string_split(lower(degree_level), ','), 'master') THEN 1.0 ELSE 0.2 END * 10 AS p_degree,
    CASE WHEN n_awards < 30 THEN CAST(0.35 AS DOUBLE) WHEN n_awards < 200 THEN 0.65 WHEN n_awards IS NOT NULL THEN 0.95 ELSE 0.5 END * 8 AS p_competition,
    CASE WHEN min_ielts IS NULL AND min_toefl IS NULL THEN CAST(1.0 AS DOUBLE) WHEN 7.5 >= min_ielts + 0.5 THEN 0.85 ELSE 0.4 END * 6 AS p_english,
    CASE WHEN regexp_matches(description || coalesce(field, ''), '(?i)research|thesis|phd|publication') THEN CASE WHEN funding_type = 'Full' THEN CAST(1.0 AS DOUBLE) ELSE 0.8 END WHEN funding_type = 'Full' THEN 0.2 ELSE 0.3 END * 8 AS p_research
    FROM gated),
rawed AS (SELECT *, {r2('p_country + p_field + p_funding + p_amount + p_degree + p_competition + p_english + p_research')} AS raw FROM parted),
lifted AS (SELECT *, CASE WHEN gate_pass THEN {r2("least(100.0, (" + r2('raw * (0.7 + CAST(0.3 AS DOUBLE) * confidence)') + ") * CASE WHEN days_left IS NULL OR days_left < 0 THEN CAST(1.0 AS DOUBLE) WHEN days_left <= 14 THEN 1.12 WHEN days_left <= 45 THEN 1.05 WHEN days_left > 240 THEN 0.97 ELSE 1.0 END)")}
    ELSE {r2('least(40.0, raw * CAST(0.4 AS DOUBLE))')} END AS score FROM rawed),
scored AS (SELECT *, CASE WHEN NOT gate_pass THEN 'ineligible' WHEN score >= 78 THEN 'must_apply' WHEN score >= 62 THEN 'strong' WHEN score >= 45 THEN 'worth_a_look' ELSE 'low' END AS tier FROM lifted)"""
S = f"WITH {SCORED.strip()}"


@query(S + " SELECT id, raw, confidence, days_left, score, tier, gate_pass, reasons, warnings FROM scored")
def evaluate(spark, sf_dir):
    return scored(spark, sf_dir).select("id", "raw", "confidence", "days_left", "score", "tier", "gate_pass", F.array_join("reasons", ",").alias("reasons"), F.array_join("warnings", ",").alias("warnings"))


@query(S + " SELECT id, score, tier, deadline FROM scored WHERE gate_pass AND score >= 45 AND (days_left IS NULL OR days_left >= 0)")
def shortlist(spark, sf_dir):
    return match.shortlist(scored(spark, sf_dir)).orderBy(*ranking.best_first()).select("id", "score", "tier", "deadline")


@query(S + " SELECT id, gate_pass FROM scored")
def gates(spark, sf_dir):
    return match.with_gates(opportunities(spark, sf_dir), P, AS_OF).select("id", "gate_pass")


@query(S + ", r AS (SELECT unnest(string_split(concat_ws(',', nullif(reasons, ''), nullif(warnings, '')), ',')) AS rule FROM scored) SELECT rule, count(*) AS n FROM r WHERE rule <> '' GROUP BY rule")
def gate_reason_counts(spark, sf_dir):
    rows = match.with_gates(opportunities(spark, sf_dir), P, AS_OF)
    return rows.select(F.explode(F.concat("reasons", "warnings")).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


@query(S + f" SELECT id, {r2('p_country')} AS country, {r2('p_field')} AS field, {r2('p_funding')} AS funding, {r2('p_amount')} AS amount, {r2('p_degree')} AS degree, {r2('p_competition')} AS competition, {r2('p_english')} AS english_ready, {r2('p_research')} AS research FROM scored")
def soft_score(spark, sf_dir):
    return scored(spark, sf_dir).select("id", *[F.col("breakdown")[k].alias(k) for k in match.WEIGHTS])


@query(S + " SELECT id, confidence FROM scored")
def confidence(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", match.confidence().alias("confidence"))


@query(S + " SELECT tier, count(*) AS n, min(score) AS least, max(score) AS most FROM scored GROUP BY tier")
def urgency_tier(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("tier").agg(F.count("*").alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(S + " SELECT id, concat_ws(', ', x[1], x[2], x[3], x[4]) AS top FROM (SELECT id, list_transform(list_sort([{'a': -p_country, 'n': 'country'}, {'a': -p_field, 'n': 'field'}, {'a': -p_funding, 'n': 'funding'}, {'a': -p_amount, 'n': 'amount'}, {'a': -p_degree, 'n': 'degree'}, {'a': -p_competition, 'n': 'competition'}, {'a': -p_english, 'n': 'english_ready'}, {'a': -p_research, 'n': 'research'}]), lambda e: e.n) AS x FROM (SELECT id, "
       + ", ".join(f"{r2(c)} AS {c}" for c in ("p_country", "p_field", "p_funding", "p_amount", "p_degree", "p_competition", "p_english", "p_research")) + " FROM scored))")
def breakdown_top4(spark, sf_dir):
    items = F.transform(F.map_entries("breakdown"), lambda e: F.struct((-e["value"]).alias("a"), e["key"].alias("n")))
    return scored(spark, sf_dir).select("id", F.array_join(F.transform(F.slice(F.array_sort(items), 1, 4), lambda e: e["n"]), ", ").alias("top"))


@query("SELECT id, (degree_level IS NULL)::INT + (deadline IS NULL)::INT + (country IS NULL)::INT + (amount_usd IS NULL)::INT + (eligible IS NULL)::INT AS missing FROM opps WHERE (degree_level IS NULL)::INT + (deadline IS NULL)::INT + (country IS NULL)::INT + (amount_usd IS NULL)::INT + (eligible IS NULL)::INT >= 2")
def needs_triage(spark, sf_dir):
    lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("degree_level", "deadline", "country", "amount_usd", "eligible")]))
    return opportunities(spark, sf_dir).select("id", F.size(lacks).alias("missing")).where("missing >= 2")


# ---- filters, sorts, pages
@query("SELECT id, title FROM opps WHERE title ILIKE '%auto%' OR country ILIKE '%auto%' OR field ILIKE '%auto%' OR eligibility ILIKE '%auto%' OR description ILIKE '%auto%' OR amount_text ILIKE '%auto%' OR source ILIKE '%auto%'")
def list_keyword(spark, sf_dir):
    return opportunities(spark, sf_dir).where(browse.keyword(" auto ")).select("id", "title")


@query(f"SELECT id, deadline FROM opps WHERE status = 'active' AND deadline BETWEEN {TS} AND {TS} + INTERVAL 45 DAY")
def list_status_window(spark, sf_dir):
    return opportunities(spark, sf_dir).where(browse.in_status("expiring", AS_OF)).select("id", "deadline")


@query("SELECT id, amount_usd FROM opps WHERE country = 'NATION_4' AND funding_type = 'Full' AND amount_usd >= 20000")
def list_equality(spark, sf_dir):
    return opportunities(spark, sf_dir).where(browse.equal(country="NATION_4", funding_type="Full", degree_level="any") & browse.at_least(20000)).select("id", "amount_usd")


@query("SELECT id, source FROM opps WHERE source = '1-URGENT' OR list_contains(string_split(seen_in, ','), '1-URGENT')")
def list_source_member(spark, sf_dir):
    return opportunities(spark, sf_dir).where(browse.from_source("1-URGENT")).select("id", "source")


@query("SELECT id FROM opps WHERE source = '1-UR' OR seen_in ILIKE '%1-UR%'")
def list_source_substring(spark, sf_dir):
    return opportunities(spark, sf_dir).where(browse.from_source("1-UR", exact=False)).select("id")


@query(S + " SELECT id, score FROM scored WHERE gate_pass IS TRUE")
def list_gate(spark, sf_dir):
    return scored(spark, sf_dir).where(F.col("gate_pass").eqNullSafe(True)).select("id", "score")


@query("SELECT id, hidden, starred FROM opps WHERE hidden IS NOT TRUE AND starred IS TRUE")
def null_safe_flags(spark, sf_dir):
    return opportunities(spark, sf_dir).where(browse.visible(starred=True)).select("id", "hidden", "starred")


@query(S + " SELECT id, score FROM scored WHERE status = 'active' AND tier = 'strong' AND country ILIKE '%nation_1%' AND score >= 60 AND (title ILIKE '%award%' OR field ILIKE '%award%')")
def cli_filter(spark, sf_dir):
    cond = browse.in_status("active", AS_OF) & (F.col("tier") == "strong") & F.ilike(F.col("country"), F.lit("%nation_1%")) & (F.col("score") >= 60) & browse.keyword("award", ("title", "field"))
    return scored(spark, sf_dir).where(cond).select("id", "score")


@query(S + f" SELECT id, deadline, score FROM scored WHERE status = 'active' AND score >= 45 AND deadline BETWEEN {TS} AND {TS} + INTERVAL 30 DAY")
def deadlines_soon(spark, sf_dir):
    return scored(spark, sf_dir).where(browse.in_status("expiring", AS_OF, 30) & (F.col("score") >= 45)).orderBy("deadline", "id").select("id", "deadline", "score")


@query(S + " SELECT id, title, score FROM scored WHERE title = 'Award BUILDING 1998' OR contains(lower(title), 'award building 1998') ORDER BY CASE WHEN title = 'Award BUILDING 1998' THEN 0 ELSE 1 END, score DESC, id LIMIT 1")
def detail_lookup(spark, sf_dir):
    return browse.lookup(scored(spark, sf_dir), "Award BUILDING 1998").select("id", "title", "score")


@query(S + " SELECT id, score FROM scored WHERE status = 'active' AND (title ILIKE '%machinery%' OR country ILIKE '%machinery%' OR field ILIKE '%machinery%' OR description ILIKE '%machinery%') ORDER BY score DESC, id LIMIT 15")
def agent_search(spark, sf_dir):
    return scored(spark, sf_dir).where((F.col("status") == "active") & browse.keyword("machinery", ("title", "country", "field", "description"))).orderBy(F.desc("score"), "id").limit(15).select("id", "score")


@query(S + " SELECT id, score, deadline FROM scored ORDER BY score DESC, deadline ASC NULLS LAST, id LIMIT 50 OFFSET 100")
def page_offset(spark, sf_dir):
    return browse.page(scored(spark, sf_dir), "score", 50, 100).select("id", "score", "deadline")


SORTS = {"score": "score DESC, deadline ASC NULLS LAST", "-score": "score ASC, deadline ASC NULLS LAST", "deadline": "deadline ASC NULLS LAST", "-deadline": "deadline DESC NULLS LAST", "amount": "amount_usd DESC NULLS LAST",
         "-amount": "amount_usd ASC NULLS LAST", "seen": "first_seen DESC", "title": "lower(title)", "days": "days_left ASC NULLS LAST, deadline ASC NULLS LAST"}


@query(S + " " + " UNION ALL ".join(f"(SELECT '{k}' AS sort, id, row_number() OVER (ORDER BY {v}, id) AS place FROM scored ORDER BY {v}, id LIMIT 20)" for k, v in SORTS.items()))
def sort_variants(spark, sf_dir):
    from functools import reduce

    from pyspark.sql import Window

    rows = scored(spark, sf_dir)
    tops = [rows.orderBy(*browse.order_of(k)).limit(20).withColumn("place", F.row_number().over(Window.orderBy(*browse.order_of(k))).cast("long")).select(F.lit(k).alias("sort"), "id", "place")
            for k in SORTS]  # the window sees 20 rows
    return reduce(DataFrame.unionByName, tops)


@query(S + " SELECT id, score, tier FROM scored ORDER BY score DESC, deadline ASC NULLS LAST, id LIMIT 400")
def report_topn(spark, sf_dir):
    return scored(spark, sf_dir).orderBy(*ranking.best_first()).limit(400).select("id", "score", "tier")


# ---- rank
@query(S + """, a AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, deadline ASC NULLS LAST, id) AS r FROM scored
    WHERE gate_pass AND score >= 45 AND hidden IS NOT TRUE AND (is_new OR changed OR NOT notified)),
b AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY score DESC, deadline ASC NULLS LAST, id) AS q FROM a WHERE r <= 40)
SELECT id, source, tier, score FROM b WHERE q <= CASE tier WHEN 'must_apply' THEN 10 WHEN 'strong' THEN 25 WHEN 'worth_a_look' THEN 15 ELSE 99 END""")
def pool_quota(spark, sf_dir):
    return ranking.pool(scored(spark, sf_dir), 45, 40, {"must_apply": 10, "strong": 25, "worth_a_look": 15}).select("id", "source", "tier", "score")


@query(S + " SELECT id, score, days_left FROM scored WHERE gate_pass AND score >= 45 ORDER BY score DESC, coalesce(days_left, 9999), id LIMIT 25")
def digest_topk(spark, sf_dir):
    return ranking.digest_rows(scored(spark, sf_dir), 45, 25).select("id", "score", "days_left")


@query(S + ", best AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY score DESC, deadline ASC NULLS LAST, id) AS r FROM scored WHERE tier = 'must_apply') SELECT source, substr(sha256(string_agg(CAST(id AS VARCHAR) || ':' || coalesce(change_type, 'new'), '|' ORDER BY CAST(id AS VARCHAR) || ':' || coalesce(change_type, 'new'))), 1, 32) AS digest_key, count(*) AS n FROM best WHERE r <= 40 GROUP BY source")
def digest_key(spark, sf_dir):
    return ranking.digest_key(ranking.first_n(scored(spark, sf_dir).where("tier = 'must_apply'"), "source", 40, ranking.best_first()), "source")


@query("""WITH c AS (SELECT user_id, event_id, value, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 5 AS chunk FROM events),
s AS (SELECT *, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY chunk RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c)
SELECT user_id, event_id, chunk, round(spent, 4) AS spent FROM s WHERE spent < 300""", opps=False)
def budget_prefix(spark, sf_dir):
    out = ranking.within_budget(table(spark, sf_dir, "events"), "value", "event_id", 300.0, 5, "user_id")
    return out.select("user_id", "event_id", "chunk", F.round("spent", 4).alias("spent"))


# ---- aggregates
@query(S + " SELECT dim, value, n FROM (SELECT *, row_number() OVER (PARTITION BY dim ORDER BY n DESC, value) AS r FROM (SELECT dim, value, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT '{d}' AS dim, {d} AS value FROM scored" for d in ("country", "degree_level", "funding_type", "source", "tier")) + ") WHERE value IS NOT NULL AND value <> '' GROUP BY dim, value)) WHERE r <= 60")
def facets(spark, sf_dir):
    return browse.facets(scored(spark, sf_dir))


@query(S + f" SELECT count(*) AS total, count_if(status = 'active') AS active, count_if(gate_pass AND status = 'active') AS eligible, count_if(is_new) AS fresh, count_if(starred) AS starred, max(amount_usd) AS max_amount, min(deadline) FILTER (status = 'active' AND deadline >= {TS}) AS next_deadline FROM scored")
def archive_stats(spark, sf_dir):
    return browse.statistics(scored(spark, sf_dir), AS_OF)


@query(S + " SELECT coalesce(tier, '?') AS tier, count(*) AS n FROM scored WHERE status = 'active' GROUP BY 1")
def tier_counts(spark, sf_dir):
    return browse.by_tier(scored(spark, sf_dir))


@query(S + f" SELECT count(*) AS tracked, count_if(tier = 'must_apply') AS must_apply, count_if(funding_type = 'Full') AS full_funding, count_if(days_left BETWEEN 0 AND 29) AS closing, count(DISTINCT source) AS sources FROM scored")
def kpis(spark, sf_dir):
    return scored(spark, sf_dir).agg(F.count("*").alias("tracked"), F.count_if(F.col("tier") == "must_apply").alias("must_apply"), F.count_if(F.col("funding_type") == "Full").alias("full_funding"),
                                     F.count_if(F.col("days_left").between(0, 29)).alias("closing"), F.countDistinct("source").alias("sources"))


@query(S + " SELECT id, concat_ws(',', CASE WHEN deadline_estimated THEN 'deadline_estimated' END, CASE WHEN amount_usd IS NULL THEN 'no_amount' END, CASE WHEN funding_type IS NULL OR funding_type = 'Unknown' THEN 'no_funding_type' END, CASE WHEN eligible IS NULL THEN 'eligibility_unlisted' END, CASE WHEN confidence < 0.55 THEN 'low_confidence' END) AS flags FROM scored")
def quality_flags(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.array_join(browse.quality_flags(), ",").alias("flags"))


@query("SELECT DISTINCT trim(v) AS value FROM (SELECT unnest(string_split(degree_level, ',')) AS v FROM opps)")
def facet_values_split(spark, sf_dir):
    return opportunities(spark, sf_dir).select(F.explode(F.split("degree_level", ",")).alias("v")).select(F.trim("v").alias("value")).distinct()


@query("SELECT user_id, arg_max(event_id, event_id) AS event_id, arg_max(event_type, event_id) AS event_type, arg_max(value, event_id) AS value FROM events GROUP BY user_id", opps=False)
def latest_per_source(spark, sf_dir):
    return telemetry.latest_per(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("""WITH e AS (SELECT CAST(ts AS DATE) AS day, user_id, event_type FROM events), last AS (SELECT max(day) AS day FROM e)
SELECT user_id, count(*) AS n, count_if(event_type = 'error') AS errors, count_if(event_type = 'error') * 2 > count(*) AS unhealthy FROM e JOIN last USING (day) GROUP BY user_id""", opps=False)
def health_latest_run(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), "user_id", "event_type")
    last = e.agg(F.max("day").alias("day"))
    rows = e.join(F.broadcast(last), "day")  # one row
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), (F.count_if(F.col("event_type") == "error") * 2 > F.count("*")).alias("unhealthy"))


@query("""WITH r AS (SELECT user_id, count_if(event_type = 'view') AS found, count_if(event_type = 'error') AS errors FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN found > 0 AND errors = 0 THEN 'ok' WHEN errors > 0 AND found = 0 THEN 'blocked' WHEN found = 0 THEN 'empty' ELSE 'ok' END AS status FROM r""", opps=False)
def run_status(spark, sf_dir):
    r = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "view").alias("found"), F.count_if(F.col("event_type") == "error").alias("errors"))
    return r.select("user_id", telemetry.run_status(F.col("found"), F.col("errors")).alias("status"))


@query("""WITH k AS (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value FROM events), p AS (SELECT * FROM (VALUES ('click', 0.5), ('view', 0.1), ('purchase', 2.0)) t(event_type, price))
SELECT event_type, count(*) AS calls, CAST(sum(k) AS BIGINT) AS tokens, CAST(sum(k) AS DOUBLE) * max(coalesce(CAST(price AS DOUBLE), 0)) AS cost FROM k LEFT JOIN p USING (event_type) GROUP BY event_type""", opps=False)
def usage_cost(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").try_cast("long").alias("k"))
    price = F.coalesce(F.create_map(*[F.lit(x) for x in ("click", 0.5, "view", 0.1, "purchase", 2.0)])[F.col("event_type")], F.lit(0.0))
    return e.groupBy("event_type").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), (F.sum("k").cast("double") * F.max(price)).alias("cost"))


# ---- identity, upsert, lifecycle
NORM = r"""CASE WHEN regexp_matches(u, '(?i)^https?://[^/?#]+') THEN 'https://' || regexp_replace(lower(regexp_extract(u, '(?i)^https?://([^/?#]+)([^?#]*)(?:\?([^#]*))?', 1)), '^www\.', '')
    || coalesce(nullif(regexp_replace(regexp_replace(regexp_extract(u, '(?i)^https?://([^/?#]+)([^?#]*)(?:\?([^#]*))?', 2), '(?i)/index\.html?$', '/'), '/+$', ''), ''), '/')
    || coalesce('?' || nullif(array_to_string(list_sort(list_filter(string_split(regexp_extract(u, '(?i)^https?://([^/?#]+)([^?#]*)(?:\?([^#]*))?', 3), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_|ga_|ref|source|mc_|igshid|fbclid)'))), '&'), ''), '')
    ELSE regexp_replace(lower(u), '/+$', '') END"""
TITLE = rf"""trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(lower(t), '&amp;', ' and '), '\b20[0-9]{{2}}(\s*[-/–]\s*([0-9]{{2}}|20[0-9]{{2}}))?\b', ' ', 'g'), '[’'']', '', 'g'), '[^a-z0-9 ]', ' ', 'g'), '\b{identity.STOP_WORDS}\b', ' ', 'g'), '\s+', ' ', 'g'))"""


@query(f"SELECT page_id AS id, {NORM} AS url_key FROM (SELECT page_id, trim(url) AS u FROM pages) UNION ALL SELECT o_orderkey AS id, {NORM} AS url_key FROM (SELECT id AS o_orderkey, trim(url) AS u FROM opps)")
def url_normalize(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), identity.normalize_url(F.col("url")).alias("url_key"))
    return pages.unionByName(opportunities(spark, sf_dir).select("id", identity.normalize_url(F.col("url")).alias("url_key")))


@query(f"SELECT id, {TITLE} AS title_key FROM (SELECT id, title || ' of the International Students &amp; Programme 2026-27' AS t FROM opps)")
def title_normalize(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", identity.normalize_title(F.concat("title", F.lit(" of the International Students &amp; Programme 2026-27"))).alias("title_key"))


@query(f"SELECT id, substr(sha256({TITLE} || '|' || coalesce(strftime(deadline, '%Y-%m-%d'), '')), 1, 24) AS canonical FROM (SELECT *, title AS t FROM opps)")
def canonical_key(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", identity.canonical_key(F.col("title"), F.col("deadline"), F.col("url")).alias("canonical"))


@query(r"SELECT page_id, CASE WHEN t <> '' THEN substr(sha256(t), 1, 32) END AS text_key FROM (SELECT page_id, lower(trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \t\n\r\f]+', ' ', 'g'))) AS t FROM pages)", opps=False)
def text_hash(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.text_hash(F.col("html")).alias("text_key"))


FACTS = {"title": "title", "country": "country", "day": "CAST(CAST(deadline AS DATE) AS VARCHAR)", "cents": "CAST(round(amount_usd * 100, 0) AS BIGINT)"}
as_json = lambda name, sql: f"""'"{name}":' || coalesce({f"CAST({sql} AS VARCHAR)" if name == "cents" else f"'{chr(34)}' || {sql} || '{chr(34)}'"}, 'null')"""


@query(f"SELECT id, substr(sha256('{{' || {" || ',' || ".join(as_json(k, FACTS[k]) for k in sorted(FACTS))} || '}}'), 1, 32) AS facts FROM opps")
def facts_hash(spark, sf_dir):
    rows = opportunities(spark, sf_dir).select("id", *[F.expr(sql.replace("VARCHAR", "STRING")).alias(k) for k, sql in FACTS.items()])
    return rows.select("id", identity.facts_hash(list(FACTS)).alias("facts"))


@query("SELECT id, array_to_string(list_sort(list_distinct(list_concat(string_split(source, ','), string_split(seen_in, ',')))), ',') AS sources FROM opps")
def merge_sources(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", archive.merged_sources(F.col("source"), F.col("seen_in")).alias("sources"))


@query("SELECT id, url FROM opps WHERE url NOT IN (SELECT url FROM opps WHERE status = 'active')")
def known_page_anti(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    return o.join(o.where("status = 'active'").select("url").distinct(), "url", "left_anti").select("id", "url")


@query("WITH d AS (SELECT title, CAST(deadline AS DATE) AS day, count(*) AS n, min(id) AS oldest, count(DISTINCT source) AS sources FROM opps GROUP BY 1, 2) SELECT * FROM d WHERE n > 1")
def cross_source_dupes(spark, sf_dir):
    grouped = opportunities(spark, sf_dir).groupBy("title", F.to_date("deadline").alias("day"))
    return grouped.agg(F.count("*").alias("n"), F.min("id").alias("oldest"), F.countDistinct("source").alias("sources")).where("n > 1")


UPSERT = f"""WITH keyed AS (SELECT *, title || '|' || coalesce(strftime(deadline, '%Y-%m-%d'), '') AS canonical, country || '/' || CAST(id // 2 AS VARCHAR) AS url_key FROM opps),
old AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY id) AS n FROM keyed WHERE id % 2 = 0 AND url_key IS NOT NULL) WHERE n = 1),
fresh AS (SELECT * FROM keyed WHERE id % 2 = 1 OR id % 10 = 0),
firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY url_key ORDER BY id) AS n FROM fresh WHERE url_key IS NOT NULL) WHERE n = 1),
twins AS (SELECT * FROM (SELECT canonical, url_key, seen_in, row_number() OVER (PARTITION BY canonical ORDER BY first_seen, id) AS n FROM old) WHERE n = 1),
met AS (SELECT f.id, o.url_key IS NOT NULL AS known, t.url_key IS NOT NULL AS twin, CASE WHEN o.url_key IS NOT NULL THEN o.seen_in ELSE t.seen_in END AS other, f.seen_in,
    CASE WHEN f.deadline <> o.deadline THEN 'deadline_moved' WHEN f.deadline IS NOT NULL AND o.deadline IS NULL THEN 'deadline_added'
        WHEN (f.amount_text IS NOT NULL AND f.amount_text IS DISTINCT FROM o.amount_text) OR (f.funding_type IS NOT NULL AND f.funding_type IS DISTINCT FROM o.funding_type) OR (f.amount_usd IS NOT NULL AND f.amount_usd IS DISTINCT FROM o.amount_usd) THEN 'funding_changed'
        WHEN (f.title IS DISTINCT FROM o.title) OR (f.country IS NOT NULL AND f.country IS DISTINCT FROM o.country) OR (f.degree_level IS NOT NULL AND f.degree_level IS DISTINCT FROM o.degree_level) OR (f.field IS NOT NULL AND f.field IS DISTINCT FROM o.field)
            OR (f.eligibility IS NOT NULL AND f.eligibility IS DISTINCT FROM o.eligibility) OR (f.description IS DISTINCT FROM o.description) THEN 'content_changed' END AS change
    FROM firsts f LEFT JOIN old o ON f.url_key = o.url_key LEFT JOIN twins t ON f.canonical = t.canonical),
outcomes AS (SELECT id, CASE WHEN known AND change IS NULL THEN 'unchanged' WHEN known THEN 'changed' WHEN twin THEN 'duplicate' ELSE 'new' END AS outcome,
    CASE WHEN known THEN change WHEN NOT twin THEN 'new' END AS change_type, CAST(CASE WHEN known OR twin THEN 2 ELSE 1 END AS BIGINT) AS times_seen,
    array_to_string(list_sort(list_distinct(list_concat(string_split(seen_in, ','), coalesce(string_split(other, ','), [])))), ',') AS sources FROM met
    UNION ALL SELECT id, 'rejected', NULL, 0, '' FROM fresh WHERE url_key IS NULL)"""


def _upsert(spark, sf_dir):
    o = opportunities(spark, sf_dir).withColumn("canonical", F.concat("title", F.lit("|"), F.coalesce(F.date_format("deadline", "yyyy-MM-dd"), F.lit(""))))
    o = o.withColumn("url_key", F.concat("country", F.lit("/"), F.floor(F.col("id") / 2).cast("string"))).withColumn("times_seen", F.lit(1))
    old = archive.deduplicated(o.where("id % 2 = 0 AND url_key IS NOT NULL"), ["url_key"], ["id"])
    return archive.upsert_outcomes(o.where("id % 2 = 1 OR id % 10 = 0"), old)


@query(UPSERT + " SELECT * FROM outcomes")
def upsert_outcomes(spark, sf_dir):
    return _upsert(spark, sf_dir)


@query(UPSERT + " SELECT outcome, coalesce(change_type, '') AS change_type, count(*) AS n FROM outcomes GROUP BY 1, 2")
def upsert_change_type(spark, sf_dir):
    return _upsert(spark, sf_dir).groupBy("outcome", F.coalesce("change_type", F.lit("")).alias("change_type")).agg(F.count("*").alias("n"))


@query(f"SELECT id, CASE WHEN status <> 'active' THEN status WHEN deadline < {TS} THEN 'expired' WHEN date_diff('second', last_seen, {TS}) // 86400 > 45 THEN 'stale' WHEN date_diff('second', first_seen, {TS}) // 86400 > 400 THEN 'outdated' ELSE 'active' END AS new_status FROM opps")
def lifecycle_sweep(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", archive.swept(AS_OF).alias("new_status"))


@query("""WITH d AS (SELECT id, CAST(deadline AS DATE) AS d, deadline_rolling OR coalesce(round_label = 'Annual', FALSE) AS rec FROM opps),
m AS (SELECT id, d, rec, list_transform([1, 2, 3, 4], lambda k: CASE WHEN month(d) = 2 AND day(d) = 29 THEN make_date(year(d) + k, 2, 28) ELSE make_date(year(d) + k, month(d), day(d)) END) AS later FROM d)
SELECT id, CASE WHEN rec AND d < DATE '1998-08-02' THEN coalesce(list_filter(later, lambda x: x > DATE '1998-08-02')[1], later[4]) ELSE d END AS rolled FROM m""")
def recurring_rollforward(spark, sf_dir):
    recurring = F.coalesce("deadline_rolling", F.lit(False)) | F.coalesce(F.col("round_label") == "Annual", F.lit(False))
    return opportunities(spark, sf_dir).select("id", archive.rolled_forward(F.col("deadline"), recurring, "1998-08-02").alias("rolled"))


@query(f"SELECT id, is_new AND NOT (deadline < {TS} AND NOT deadline_rolling) IS TRUE AS still_new FROM opps")
def expired_on_arrival(spark, sf_dir):
    past = F.coalesce((F.col("deadline") < F.lit(AS_OF).cast("timestamp_ntz")) & ~F.col("deadline_rolling"), F.lit(False))
    return opportunities(spark, sf_dir).select("id", (F.col("is_new") & ~past).alias("still_new"))


@query("SELECT id, CASE WHEN changed THEN NULL ELSE change_type END AS change_type, FALSE AS changed FROM opps")
def flag_reset(spark, sf_dir):
    return archive.reset_flags(opportunities(spark, sf_dir)).select("id", "change_type", "changed")


@query("SELECT id, CASE WHEN id % 6 = 0 THEN TRUE ELSE hidden END AS hidden, CASE WHEN id % 6 = 0 THEN FALSE WHEN id % 2 = 0 THEN TRUE ELSE starred END AS starred, CASE WHEN id % 4 = 0 THEN 'note ' || CAST(id AS VARCHAR) END AS notes FROM opps")
def mark_rows(spark, sf_dir):
    o = opportunities(spark, sf_dir)
    edits = o.where("id % 2 = 0").selectExpr("id", "TRUE AS starred", "IF(id % 6 = 0, TRUE, NULL) AS hidden", "IF(id % 4 = 0, concat(' note ', CAST(id AS STRING), ' '), '  ') AS notes")
    return archive.marked(o, edits).select("id", "hidden", "starred", "notes")


# ---- scans
@query("SELECT source, count(*) AS n FROM (SELECT l_returnflag AS source FROM lineitem UNION ALL SELECT o_orderstatus FROM orders UNION ALL SELECT event_type FROM events) GROUP BY source", opps=False)
def scan_union_sources(spark, sf_dir):
    parts = [table(spark, sf_dir, t).select(F.col(c).alias("source")) for t, c in (("lineitem", "l_returnflag"), ("orders", "o_orderstatus"), ("events", "event_type"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count("*").alias("n"))


@query("SELECT id, source FROM (SELECT id, source, row_number() OVER (PARTITION BY source ORDER BY id) AS r FROM opps) WHERE r <= 120")
def scan_source_cap(spark, sf_dir):
    return ranking.first_n(opportunities(spark, sf_dir), "source", 120, ["id"]).select("id", "source")


@query("SELECT source, title, min(id) AS id FROM opps WHERE title <> '' GROUP BY source, title")
def scan_dedupe_first(spark, sf_dir):
    return archive.deduplicated(opportunities(spark, sf_dir).where("title <> ''"), ["source", "title"], ["id"]).select("source", "title", "id")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events", opps=False)
def json_path_map(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query(r"""SELECT page_id, length(html) <= 200000 AND (contains(lower(html), 'id="root"') OR contains(lower(html), 'id="app"') OR contains(lower(html), '__next_data__') OR contains(lower(html), 'ng-app') OR contains(lower(html), 'data-reactroot') OR contains(lower(html), 'enable javascript'))
    AND length(regexp_replace(regexp_extract(html, '(?is)<body[^>]*>(.*)', 1), '(?is)<script.*?</script>', '', 'g')) < 4000 AS shell FROM pages""", opps=False)
def shell_detect(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", identity.looks_like_shell(F.col("html")).alias("shell"))


# ---- text facts
PROSE = "'GPA ' || CAST(2 + id % 3 AS VARCHAR) || '.' || CAST(id % 10 AS VARCHAR) || CASE WHEN id % 4 = 0 THEN '/5' ELSE '' END || '. IELTS score of ' || CAST(4 + id % 5 AS VARCHAR) || '.5, TOEFL ' || CAST(60 + id % 80 AS VARCHAR) || '. ' || CASE id % 4 WHEN 0 THEN 'Fully funded master''s award in machine learning with tuition and stipend' WHEN 1 THEN 'Tuition waiver for PhD students of data science and statistics' WHEN 2 THEN 'Tuition, housing, flight and health insurance for an undergraduate engineering degree' ELSE 'A diploma in public health, nursing and medicine' END || '. Maximum age ' || CAST(15 + id % 50 AS VARCHAR) || '. ' || CAST(id % 9 AS VARCHAR) || ' years of work experience. GRE is ' || CASE WHEN id % 2 = 0 THEN 'required' ELSE 'optional' END || ' by 2027-' || lpad(CAST(id % 14 AS VARCHAR), 2, '0') || '-' || lpad(CAST(id % 32 AS VARCHAR), 2, '0')"


def _prose(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", "title", F.expr(PROSE.replace("VARCHAR", "STRING").replace("master''s", "master\\'s")).alias("text"))


W = f"WITH prose AS (SELECT id, title, {PROSE} AS text FROM opps)"


@query(W + r", g AS (SELECT id, TRY_CAST(regexp_extract(text, '(?i)\b(?:c?gpa)\b[^0-9]{0,30}([0-9](?:\.[0-9]{1,2})?)(?:\s*(?:/|out of|on a scale of)\s*([0-9]{1,2}(?:\.[0-9])?))?', 1) AS DOUBLE) AS v, TRY_CAST(regexp_extract(text, '(?i)\b(?:c?gpa)\b[^0-9]{0,30}([0-9](?:\.[0-9]{1,2})?)(?:\s*(?:/|out of|on a scale of)\s*([0-9]{1,2}(?:\.[0-9])?))?', 2) AS DOUBLE) AS s FROM prose) SELECT id, floor(v * 4 / coalesce(s, CASE WHEN v > 4 THEN 5.0 ELSE 4.0 END) * 100 + 0.5000001) / 100 AS gpa FROM g")
def gpa_parse(spark, sf_dir):
    return _prose(spark, sf_dir).select("id", facts.gpa(F.col("text")).alias("gpa"))


@query(W + r" SELECT id, TRY_CAST(regexp_extract(text, '(?i)\bielts\b[^0-9]{0,40}([3-9](?:\.[05])?)\b', 1) AS DOUBLE) AS ielts, CASE WHEN TRY_CAST(regexp_extract(text, '(?i)\btoefl\b[^0-9]{0,40}([0-9]{2,3})\b', 1) AS INT) BETWEEN 40 AND 120 THEN TRY_CAST(regexp_extract(text, '(?i)\btoefl\b[^0-9]{0,40}([0-9]{2,3})\b', 1) AS INT) END AS toefl FROM prose")
def ielts_parse(spark, sf_dir):
    band, points = facts.english(F.col("text"))
    return _prose(spark, sf_dir).select("id", band.alias("ielts"), points.alias("toefl"))


#: What the texts say, by a phrase of each, written down by hand.
MEANT = W + """, meant(mark, degrees, coverage, funding, fields) AS (VALUES ('Fully funded master''s award in machine learning', 'Master', 'tuition,stipend', 'Full', 'AI/ML'), ('Tuition waiver for PhD students', 'PhD', 'tuition', 'Partial', 'Data Science'),
    ('housing, flight and health insurance', 'Bachelor', 'tuition,airfare,health_insurance,accommodation', 'Full', 'Engineering'), ('A diploma in public health', 'Diploma', '', 'Unknown', 'Health')) SELECT id, {0} FROM prose JOIN meant ON contains(text, mark)"""


@query(MEANT.replace("{0}", "degrees"))
def degree_levels(spark, sf_dir):
    return _prose(spark, sf_dir).select("id", facts.classes(F.col("text"), facts.DEGREES).alias("degrees"))


@query(MEANT.replace("{0}", "coverage"))
def coverage(spark, sf_dir):
    return _prose(spark, sf_dir).select("id", facts.classes(F.col("text"), facts.COVERAGE).alias("coverage"))


@query(MEANT.replace("{0}", "funding"))
def funding_type(spark, sf_dir):
    return _prose(spark, sf_dir).select("id", facts.funding_type(F.col("text")).alias("funding"))


@query(MEANT.replace("{0}", "fields"))
def field_classify(spark, sf_dir):
    """The text stands for its title as well, whose words count four times."""
    return _prose(spark, sf_dir).select("id", facts.fields(F.col("text"), F.col("text")).alias("fields"))


@query(W + r""", c AS (SELECT id, text, TRY_CAST(regexp_extract(text, '(?i)(?:under|below|not (?:older|more) than|maximum age(?: of)?|up to)\s+([0-9]{2})\s*(?:years|\b)', 1) AS INT) AS a FROM prose)
SELECT id, CASE WHEN a BETWEEN 18 AND 55 THEN a END AS max_age, TRY_CAST(regexp_extract(text, '(?i)([0-9]{1,2})\+?\s*years?(?:''| of)?\s*(?:relevant |professional |full-time )?(?:work|professional)?\s*experience', 1) AS DOUBLE) AS min_experience, regexp_matches(text, '(?i)\bgre\b[^.]{0,30}(required|mandatory)') AS gre FROM c""")
def constraints(spark, sf_dir):
    c = facts.constraints(F.col("text"))
    return _prose(spark, sf_dir).select("id", c["max_age"].alias("max_age"), c["min_experience"].alias("min_experience"), c["gre"].alias("gre"))


@query(W + r" SELECT id, TRY_CAST(nullif(regexp_extract(text, '\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b', 1), '') AS DATE) AS day FROM prose")
def iso_date_parse(spark, sf_dir):
    return _prose(spark, sf_dir).select("id", facts.iso_date(F.col("text")).alias("day"))


NUMBER = "CASE id % 5 WHEN 0 THEN '1.234,56' WHEN 1 THEN '12,' || lpad(CAST(id % 1000 AS VARCHAR), 3, '0') WHEN 2 THEN CAST(id AS VARCHAR) || '.50' WHEN 3 THEN '5,00,000' ELSE 'n/a' END"


@query(rf"""WITH n AS (SELECT id, {NUMBER} AS t FROM opps) SELECT id, CASE WHEN regexp_matches(t, '^[0-9][0-9.,]*$') THEN TRY_CAST(CASE WHEN regexp_matches(t, '^[0-9]{{1,3}}(\.[0-9]{{3}})+(,[0-9]{{1,2}})?$') OR regexp_matches(t, '^[0-9]+,[0-9]{{1,2}}$') THEN replace(replace(t, '.', ''), ',', '.') ELSE replace(t, ',', '') END AS DOUBLE) END AS number FROM n""")
def money_number(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", facts.money_number(F.expr(NUMBER.replace("VARCHAR", "STRING"))).alias("number"))


@query("SELECT id, amount_usd * CASE id % 4 WHEN 0 THEN CAST(1.09 AS DOUBLE) WHEN 1 THEN CAST(1.27 AS DOUBLE) WHEN 2 THEN CAST(0.0066 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS usd FROM opps")
def fx_convert(spark, sf_dir):
    return opportunities(spark, sf_dir).select("id", facts.in_usd(F.col("amount_usd"), F.expr("CASE id % 4 WHEN 0 THEN '€' WHEN 1 THEN 'gbp' WHEN 2 THEN '¥' ELSE 'XYZ' END")).alias("usd"))


# ---- policies and time
LOG = "SELECT event_id, CAST(user_id % 40 AS VARCHAR) AS digest_key, ts AS created_at, CASE WHEN event_type = 'purchase' THEN 'sent' ELSE 'dry-run' END AS status FROM events"


@query(f"WITH l AS ({LOG}) SELECT event_id, digest_key FROM l c WHERE EXISTS (SELECT 1 FROM l s WHERE s.status = 'sent' AND s.digest_key = c.digest_key AND s.created_at < c.created_at AND s.created_at >= c.created_at - INTERVAL 20 HOUR)", opps=False)
def digest_dedupe_window(spark, sf_dir):
    log = table(spark, sf_dir, "events").selectExpr("event_id", "CAST(user_id % 40 AS STRING) AS digest_key", "ts AS created_at", "IF(event_type = 'purchase', 'sent', 'dry-run') AS status")
    return telemetry.sent_before(log).select("event_id", "digest_key")


@query("SELECT event_id, hour(ts) >= 22 OR hour(ts) < 7 AS quiet FROM events", opps=False)
def quiet_hours(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", telemetry.is_quiet(F.col("ts"), 22, 7).alias("quiet"))


@query("""WITH g AS (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id % 20 ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run, user_id % 20 AS k FROM events),
n AS (SELECT *, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY k, run ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS failures FROM g)
SELECT event_id, failures, CAST(CASE WHEN failures >= 3 THEN least(21600, 600 * pow(2, least(failures - 3, 20))) ELSE 0 END AS BIGINT) AS open_s FROM n""", opps=False)
def breaker_states(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("k", F.col("user_id") % 20)
    return telemetry.breaker(e, "k", "ts", F.col("event_type") == "error").select("event_id", "failures", "open_s")


@query("SELECT event_id, greatest(0.0, coalesce(600.0 - date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id), ts) // 1000 / CAST(1000 AS DOUBLE), 0.0)) AS wait_s FROM events", opps=False)
def throttle_gaps(spark, sf_dir):
    return telemetry.throttle_gaps(table(spark, sf_dir, "events"), "user_id", "ts", 600.0).select("event_id", "wait_s")


# ---- extraction that needs state, readers, reports and streams: held against examples and brute force in the tests
PAGE = ("'Award no. ' || CAST(id AS VARCHAR) || chr(10) || 'Deadline: ' || CASE id % 4 WHEN 0 THEN CAST(1 + id % 28 AS VARCHAR) || ' March 1999' WHEN 1 THEN 'May 1999' WHEN 2 THEN '1999-0' || CAST(1 + id % 9 AS VARCHAR) || '-' || CAST(10 + id % 18 AS VARCHAR) ELSE '0' || CAST(1 + id % 9 AS VARCHAR) || '/04/1999' END"
        " || chr(10) || 'Study in: ' || coalesce(country, '?') || chr(10) || 'Value: ' || CASE id % 3 WHEN 0 THEN '€' || CAST(100 + id % 900 AS VARCHAR) || ' per month' WHEN 1 THEN 'GBP ' || CAST(1 + id % 40 AS VARCHAR) || ',500 per year' ELSE '$' || CAST(100 + id % 300 AS VARCHAR) || ' / week' END"
        " || chr(10) || 'Level:' || chr(10) || coalesce(degree_level, '?') || chr(10) || 'Number of awards: ' || CAST(id % 50 AS VARCHAR)")
PAGES = f"WITH page AS (SELECT id, {PAGE} AS text FROM opps), part AS (SELECT id, text, regexp_extract(text, 'Deadline: ([^\\n]*)', 1) AS d, regexp_extract(text, 'Value: ([^\\n]*)', 1) AS v FROM page)"
DEADLINE = "CAST(CASE WHEN regexp_matches(d, '^[0-9]{4}-') THEN strptime(d, '%Y-%m-%d') WHEN regexp_matches(d, '/') THEN strptime(d, '%d/%m/%Y') WHEN regexp_matches(d, '^[0-9]') THEN strptime(d, '%d %B %Y') ELSE last_day(strptime('1 ' || d, '%d %B %Y')) END AS DATE)"
USD = "round(TRY_CAST(replace(regexp_extract(v, '[0-9][0-9,]*'), ',', '') AS DOUBLE) * CASE WHEN contains(v, '€') THEN CAST(1.09 AS DOUBLE) WHEN contains(v, 'GBP') THEN CAST(1.27 AS DOUBLE) ELSE CAST(1 AS DOUBLE) END * CASE WHEN contains(v, 'month') THEN 10 WHEN contains(v, 'week') THEN 40 ELSE 1 END, 2)"
label_sql = lambda name, between=": ": f"regexp_extract(text, '{name}{between}([^\\n]*)', 1)"


def _pages(spark, sf_dir, deal=lambda rows, key: rows):
    return deal(opportunities(spark, sf_dir), "id").select("id", F.expr(PAGE.replace("VARCHAR", "STRING")).alias("text"))


@query(f"{PAGES} SELECT id, {DEADLINE} AS deadline, regexp_matches(d, '^[A-Z]') AS estimated, 'Deadline: ' || d AS said FROM part")
def deadline_parse(spark, sf_dir):
    """Numbers are day first and exact, a month alone is a guess at its end."""
    found = _pages(spark, sf_dir).select("id", dates.deadline(F.col("text"), AS_OF).alias("d")).select("id", "d.deadline", "d.estimated", "d.deadline_text")
    return found.select("id", "deadline", "estimated", F.regexp_extract("deadline_text", "^(.*?) Study in", 1).alias("said"))


@query(f"{PAGES} SELECT id, {USD} AS usd, regexp_extract(v, '(month|year|week)') AS unit FROM part")
def money_amounts(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", F.array_max(money.amounts(F.col("text"))).alias("m")).select("id", "m.usd", "m.unit")


@query(f"{PAGES} SELECT id, {label_sql('Study in')} AS country, " + label_sql("Level", ":\\n") + f" AS degree, {label_sql('Number of awards')} AS n_awards FROM part")
def labels(spark, sf_dir):
    names = {"country": "country", "degree": "level", "n_awards": "number_of_awards"}
    return _pages(spark, sf_dir).select("id", labelled.label_values(F.col("text")).alias("l")).select("id", *[F.try_element_at("l", F.lit(k)).alias(n) for n, k in names.items()])


@query(f"{PAGES} SELECT id, 'Award no. ' || CAST(id AS VARCHAR) AS title, nullif({label_sql('Study in')}, '?') AS country, {DEADLINE} AS deadline, regexp_matches(d, '^[A-Z]') AS estimated, {USD} AS amount_usd, "
       f"CASE WHEN contains(v, '€') THEN 'EUR' WHEN contains(v, 'GBP') THEN 'GBP' ELSE 'USD' END AS currency, CAST({label_sql('Number of awards')} AS INT) AS n_awards, nullif({label_sql('Level', ':' + chr(92) + 'n')}, '?') AS degree FROM part")
def extract_all(spark, sf_dir):
    made, said = record.stated(_pages(spark, sf_dir, dealt).withColumn("title", F.concat(F.lit("Award no. "), "id")), AS_OF)
    names = {"country": "country", "deadline": "deadline", "estimated": "deadline_estimated", "amount_usd": "amount_usd", "currency": "currency", "n_awards": "n_awards", "degree": "degree_level"}
    return made.select("id", "title", *[said[k].alias(n) for n, k in names.items()])


TYPED = ("'Deadline for applications: ' || CAST(1 + id % 28 AS VARCHAR) || '-Mar-' || CAST(1997 + id % 4 AS VARCHAR) || chr(10) || 'Host university: University of ' || coalesce(country, 'Peru') || chr(10) || 'Level of study - ' || coalesce(degree_level, 'any level') || chr(10) || 'Value of award:' || chr(10)"
         " || CASE id % 4 WHEN 0 THEN 'HK$ ' || CAST(1000 + id % 900 AS VARCHAR) || ' p.m.' WHEN 1 THEN 'NZ$' || CAST(100 + id % 900 AS VARCHAR) || ' a week' WHEN 2 THEN 'SG$' || CAST(5000 + id % 900 AS VARCHAR) || ' p.a.' ELSE CAST(100 + id % 900 AS VARCHAR) || ' EUR each month for twelve months' END || chr(10) || 'and books' || chr(10) || 'Official website: none' || chr(10) || 'not a value'"
         " || chr(10) || 'English requirements: IELTS ' || CAST(5 + id % 4 AS VARCHAR) || '.5, TOEFL ' || CAST(70 + id % 50 AS VARCHAR) || chr(10) || 'Open to: Kenya, Peru and ' || CAST(id AS VARCHAR) || ' more' || chr(10) || 'Course starts: Sep ' || CAST(1998 + id % 3 AS VARCHAR) || chr(10) || 'Subjects: ' || coalesce(field, 'any subject')")
PAID = r"TRY_CAST(regexp_extract(t, '([0-9]+)(?: p\.m| a week| p\.a| EUR)', 1) AS DOUBLE)"


@query(rf"""WITH v AS (SELECT id, field, degree_level, {TYPED} AS t FROM opps)
SELECT id, CAST(strptime(regexp_extract(t, 'applications: ([^
]*)', 1), '%d-%b-%Y') AS DATE) AS deadline, regexp_extract(t, 'university: ([^
]*)', 1) AS provider, CASE WHEN contains(t, 'any level') THEN 'Any' ELSE regexp_extract(t, 'study - ([^
]*)', 1) END AS degree,
round({PAID} * CASE WHEN contains(t, 'HK$') THEN 0.13::DOUBLE * 10 WHEN contains(t, 'NZ$') THEN 0.6::DOUBLE * 40 WHEN contains(t, 'SG$') THEN 0.74::DOUBLE ELSE 1.09::DOUBLE * 12 END, 2) AS usd,
TRY_CAST(regexp_extract(t, 'IELTS ([0-9.]+[0-9])', 1) AS DOUBLE) AS ielts, TRY_CAST(regexp_extract(t, 'TOEFL ([0-9]+)', 1) AS INT) AS toefl, 'Kenya|Peru' AS eligible, regexp_extract(t, 'starts: ([^
]*)', 1) AS intake, CASE WHEN contains(lower(t), 'any subject') OR contains(lower(t), 'any field') THEN 'Any' ELSE regexp_extract(t, 'Subjects: ([^
]*)', 1) END AS field FROM v""")
def labels_typed(spark, sf_dir):
    """What labels say, typed: other names of labels, prefixes, labels that only end a value, currencies and periods."""
    text = dealt(opportunities(spark, sf_dir), "id").select("id", F.expr(TYPED.replace("VARCHAR", "STRING")).alias("text"))
    made, said = labelled.typed_values(text, "text", AS_OF)
    names = {"deadline": "deadline", "provider": "provider", "degree": "degree", "usd": "amount_usd", "ielts": "min_ielts", "toefl": "min_toefl", "eligible": "eligible", "intake": "intake", "field": "field"}
    return made.select("id", *[(F.array_join(said[k], "|") if k == "eligible" else said[k]).alias(n) for n, k in names.items()])


@query()
def clean_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", pages.clean_text(F.col("html")).alias("text"))


@query()
def scan_html_list(spark, sf_dir):
    every = 2**31 - 1
    rows = readers.html_listing(table(spark, sf_dir, "pages"), "pages", "li, article", "a[href], h1", every)
    return readers.finished(rows.withColumn("source", F.coalesce(F.expr("try_parse_url(page_url, 'HOST')"), F.lit("pages"))), every)


@query("SELECT title, 'https://e.org/x/' || CAST(id AS VARCHAR) AS url, coalesce(country, '?') AS cell_country FROM opps")
def scan_html_table(spark, sf_dir):
    row = F.concat(F.lit("<table><tr><td><a href='/x/"), F.col("id"), F.lit("'>"), F.col("title"), F.lit("</a></td><td>"), F.coalesce("country", F.lit("?")), F.lit("</td></tr></table>"))
    pages = opportunities(spark, sf_dir).select(F.lit("https://e.org/list").alias("url"), row.alias("html"))
    return readers.html_table(pages, "table", columns={"title": 0, "country": 1}).select("title", "url", "cell_country")


@query(opps=False)
def chunk_messages(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.posexplode(writers.chunked(F.col("text"), 3500, 4)).alias("part", "chunk"))


@query(S + """, best AS (SELECT *, row_number() OVER (ORDER BY score DESC, deadline ASC NULLS LAST, id) AS place FROM scored WHERE gate_pass)
SELECT string_agg(place || '. **' || title || '** — ' || coalesce(country, '?') || ', ' || coalesce(strftime(deadline, '%Y-%m-%d'), 'rolling') || ', score ' || printf('%.1f', floor(score * 10 + 0.5000001) / 10) || ' (' || tier || ')', chr(10) ORDER BY place) AS markdown FROM best WHERE place <= 40""")
def summary_md(spark, sf_dir):
    return writers.markdown(scored(spark, sf_dir).where("gate_pass"), 40)


@query()
def export_json(spark, sf_dir):
    rows = scored(spark, sf_dir)
    return writers.json_report(rows.orderBy(*ranking.best_first()).limit(400), browse.statistics(rows, AS_OF), AS_OF)
