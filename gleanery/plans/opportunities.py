"""The opportunity view: the archive's columns derived from the star-schema tables, for queries and their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.session import table

#: The instant at which time-dependent queries are evaluated.
AS_OF = "1998-08-02 00:00:00"


def opportunities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order, joined with its customer, nation and region (dimension tables that AQE broadcasts by size)."""
    joined = (table(spark, sf_dir, "orders")
              .join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey"))
              .join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
              .join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")))
    cols = {
        "id": "o_orderkey",
        "title": "concat('Award ', c_mktsegment, ' ', CAST(year(o_orderdate) AS STRING))",
        "url": "concat(IF(o_orderkey % 3 = 0, 'http', 'https'), '://www.Site', CAST(c_nationkey AS STRING), '.example.org/a/', CAST(o_orderkey AS STRING), IF(o_orderkey % 2 = 0, '/?utm_source=x&b=2&a=1#top', '/index.html'))",
        "source": "o_orderpriority",
        "country": "IF(o_orderkey % 13 = 0, NULL, n_name)",
        "scope": "r_name",
        "degree_level": "CASE o_orderkey % 5 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'Master' WHEN 2 THEN 'PhD' WHEN 3 THEN 'Bachelor,Master' END",
        "field": "CASE o_custkey % 6 WHEN 0 THEN 'Data Science' WHEN 1 THEN 'Any field' WHEN 2 THEN 'Engineering' WHEN 3 THEN 'Law' WHEN 4 THEN 'Computer Science' END",
        "funding_type": "CASE o_orderstatus WHEN 'F' THEN 'Full' WHEN 'P' THEN 'Partial' ELSE 'Tuition-only' END",
        "amount_usd": "IF(o_orderkey % 17 = 0, NULL, o_totalprice / 10)",
        "amount_text": "IF(o_orderkey % 17 = 0, NULL, concat('US$', CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS STRING), ' per year'))",
        "deadline": "IF(o_orderkey % 11 = 0, NULL, CAST(o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 400 AS INT), 23, 59, 0) AS TIMESTAMP_NTZ))",
        "deadline_rolling": "o_orderkey % 22 = 0",
        "deadline_estimated": "o_orderkey % 9 = 0",
        "round_label": "IF(o_orderkey % 4 = 0, 'Annual', NULL)",
        "min_gpa": "CASE o_custkey % 4 WHEN 0 THEN 3.0D WHEN 1 THEN 3.7D WHEN 2 THEN 4.2D END",
        "gpa_scale": "CASE o_custkey % 4 WHEN 0 THEN '4.0' WHEN 1 THEN 'out of 4' WHEN 2 THEN '5' END",
        "min_ielts": "CASE o_custkey % 5 WHEN 0 THEN 6.5D WHEN 1 THEN 7.0D WHEN 2 THEN 8.0D END",
        "min_toefl": "CASE o_custkey % 7 WHEN 0 THEN 90 WHEN 1 THEN 110 END",
        "max_age": "CASE o_custkey % 8 WHEN 0 THEN 22 WHEN 1 THEN 35 END",
        "min_work_experience_years": "CASE o_custkey % 9 WHEN 0 THEN 2.0D WHEN 1 THEN 1.0D END",
        "max_years_since_degree": "CASE o_custkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 5 END",
        "requires_gre": "o_custkey % 12 = 0",
        "application_fee_usd": "CASE o_custkey % 6 WHEN 0 THEN 0.0D WHEN 1 THEN 75.0D END",
        "eligible": "CASE o_orderkey % 7 WHEN 0 THEN concat('NATION_3,', n_name) WHEN 1 THEN n_name WHEN 2 THEN 'NATION_3,NATION_5,NATION_7' END",
        "excluded": "CASE o_orderkey % 19 WHEN 0 THEN 'NATION_3' WHEN 1 THEN n_name END",
        "eligibility": "IF(o_orderkey % 3 = 0, NULL, concat('Open to ', r_name))",
        "description": "IF(o_orderkey % 6 = 0, 'A research award with a thesis.', 'An award for study.')",
        "parse_method": "CASE o_orderkey % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'regex+labels' ELSE '' END",
        "n_awards": "CASE o_custkey % 11 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 500 END",
        "status": "CASE WHEN o_orderkey % 10 < 8 THEN 'active' WHEN o_orderkey % 10 = 8 THEN 'expired' ELSE 'stale' END",
        "hidden": "CASE WHEN o_orderkey % 23 = 0 THEN TRUE WHEN o_orderkey % 23 < 12 THEN FALSE END",
        "starred": "CASE WHEN o_orderkey % 29 = 0 THEN TRUE WHEN o_orderkey % 29 < 15 THEN FALSE END",
        "seen_in": "concat(o_orderpriority, IF(o_orderkey % 4 = 1, ',1-URGENT', ''))",
        "is_new": "o_orderkey % 6 = 1",
        "changed": "o_orderkey % 8 = 1",
        "change_type": "CASE WHEN o_orderkey % 8 = 1 THEN 'deadline_moved' WHEN o_orderkey % 6 = 1 THEN 'new' END",
        "notified": "o_orderkey % 5 = 2",
        "first_seen": "CAST(o_orderdate AS TIMESTAMP_NTZ)",
        "last_seen": "CAST(o_orderdate + make_interval(0, 0, 0, CAST(o_orderkey % 90 AS INT)) AS TIMESTAMP_NTZ)",
    }
    return joined.select(*[F.expr(sql).alias(name) for name, sql in cols.items()])


#: The same in DuckDB's SQL.
OPPS = """opps AS (
    SELECT o_orderkey AS id, 'Award ' || c_mktsegment || ' ' || CAST(year(o_orderdate) AS VARCHAR) AS title,
        CASE WHEN o_orderkey % 3 = 0 THEN 'http' ELSE 'https' END || '://www.Site' || CAST(c_nationkey AS VARCHAR) || '.example.org/a/' || CAST(o_orderkey AS VARCHAR)
            || CASE WHEN o_orderkey % 2 = 0 THEN '/?utm_source=x&b=2&a=1#top' ELSE '/index.html' END AS url,
        o_orderpriority AS source, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE n_name END AS country, r_name AS scope,
        CASE o_orderkey % 5 WHEN 0 THEN 'Bachelor' WHEN 1 THEN 'Master' WHEN 2 THEN 'PhD' WHEN 3 THEN 'Bachelor,Master' END AS degree_level,
        CASE o_custkey % 6 WHEN 0 THEN 'Data Science' WHEN 1 THEN 'Any field' WHEN 2 THEN 'Engineering' WHEN 3 THEN 'Law' WHEN 4 THEN 'Computer Science' END AS field,
        CASE o_orderstatus WHEN 'F' THEN 'Full' WHEN 'P' THEN 'Partial' ELSE 'Tuition-only' END AS funding_type,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice / 10 END AS amount_usd,
        CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 'US$' || CAST(CAST(floor(o_totalprice / 10) AS BIGINT) AS VARCHAR) || ' per year' END AS amount_text,
        CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderdate + to_days(CAST(o_orderkey % 400 AS INT)) + INTERVAL 23 HOUR + INTERVAL 59 MINUTE END AS deadline,
        o_orderkey % 22 = 0 AS deadline_rolling, o_orderkey % 9 = 0 AS deadline_estimated, CASE WHEN o_orderkey % 4 = 0 THEN 'Annual' END AS round_label,
        CASE o_custkey % 4 WHEN 0 THEN CAST(3.0 AS DOUBLE) WHEN 1 THEN CAST(3.7 AS DOUBLE) WHEN 2 THEN CAST(4.2 AS DOUBLE) END AS min_gpa,
        CASE o_custkey % 4 WHEN 0 THEN '4.0' WHEN 1 THEN 'out of 4' WHEN 2 THEN '5' END AS gpa_scale,
        CASE o_custkey % 5 WHEN 0 THEN CAST(6.5 AS DOUBLE) WHEN 1 THEN CAST(7.0 AS DOUBLE) WHEN 2 THEN CAST(8.0 AS DOUBLE) END AS min_ielts,
        CASE o_custkey % 7 WHEN 0 THEN 90 WHEN 1 THEN 110 END AS min_toefl, CASE o_custkey % 8 WHEN 0 THEN 22 WHEN 1 THEN 35 END AS max_age,
        CASE o_custkey % 9 WHEN 0 THEN CAST(2.0 AS DOUBLE) WHEN 1 THEN CAST(1.0 AS DOUBLE) END AS min_work_experience_years,
        CASE o_custkey % 10 WHEN 0 THEN 1 WHEN 1 THEN 5 END AS max_years_since_degree, o_custkey % 12 = 0 AS requires_gre,
        CASE o_custkey % 6 WHEN 0 THEN CAST(0.0 AS DOUBLE) WHEN 1 THEN CAST(75.0 AS DOUBLE) END AS application_fee_usd,
        CASE o_orderkey % 7 WHEN 0 THEN 'NATION_3,' || n_name WHEN 1 THEN n_name WHEN 2 THEN 'NATION_3,NATION_5,NATION_7' END AS eligible,
        CASE o_orderkey % 19 WHEN 0 THEN 'NATION_3' WHEN 1 THEN n_name END AS excluded,
        CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'Open to ' || r_name END AS eligibility,
        CASE WHEN o_orderkey % 6 = 0 THEN 'A research award with a thesis.' ELSE 'An award for study.' END AS description,
        CASE o_orderkey % 3 WHEN 0 THEN 'regex' WHEN 1 THEN 'regex+labels' ELSE '' END AS parse_method,
        CASE o_custkey % 11 WHEN 0 THEN 10 WHEN 1 THEN 100 WHEN 2 THEN 500 END AS n_awards,
        CASE WHEN o_orderkey % 10 < 8 THEN 'active' WHEN o_orderkey % 10 = 8 THEN 'expired' ELSE 'stale' END AS status,
        CASE WHEN o_orderkey % 23 = 0 THEN TRUE WHEN o_orderkey % 23 < 12 THEN FALSE END AS hidden,
        CASE WHEN o_orderkey % 29 = 0 THEN TRUE WHEN o_orderkey % 29 < 15 THEN FALSE END AS starred,
        o_orderpriority || CASE WHEN o_orderkey % 4 = 1 THEN ',1-URGENT' ELSE '' END AS seen_in,
        o_orderkey % 6 = 1 AS is_new, o_orderkey % 8 = 1 AS changed,
        CASE WHEN o_orderkey % 8 = 1 THEN 'deadline_moved' WHEN o_orderkey % 6 = 1 THEN 'new' END AS change_type,
        o_orderkey % 5 = 2 AS notified, o_orderdate AS first_seen, o_orderdate + to_days(CAST(o_orderkey % 90 AS INT)) AS last_seen
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
