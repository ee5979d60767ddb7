"""Registered queries on paged and typed sources, with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleanery.plans.opportunities import AS_OF, opportunities
from gleanery.plans.registry import query
from gleanery.sources import paged, readers

#: Rows on a page, and the page that nobody fetched.
SIZE, GAP = 400, 20


def answers(spark, sf_dir):
    """Pages of JSON as an endpoint gives them, made from the orders."""
    item = F.struct(F.struct(F.col("title").alias("text")).alias("name"), F.array(F.struct(F.col("url").alias("href"))).alias("links"), F.array(F.struct(F.col("country").alias("code"))).alias("places"),
                    F.when(F.col("id") % 3 == 0, F.lit("n/a")).otherwise((F.col("id") % 97).cast("string")).alias("n"))
    pages = opportunities(spark, sf_dir).withColumn("page", F.floor(F.col("id") / SIZE)).where(f"page <> {GAP}")
    body = pages.groupBy("page").agg(F.to_json(F.struct(F.struct(F.collect_list(item).alias("content")).alias("data"))).alias("body"))
    return body.select(F.concat(F.lit("https://e.org/api?offset="), (F.col("page") * SIZE).cast("string")).alias("url"), "body")


@query(f"SELECT id // {SIZE} AS page, title, url, country, CASE WHEN id % 3 <> 0 THEN (id % 97)::DOUBLE END AS n FROM opps WHERE id // {SIZE} < {GAP}")
def scan_paged_json(spark, sf_dir):
    """Answers page by page, up to the first that is missing; fields by dotted paths with list indexes."""
    rows, _ = paged.paged_json(answers(spark, sf_dir), "https://e.org/api?offset={offset}", 10**4, "data.content", {"title": "name.text", "url": "links.0.href", "country": "places.0.code", "n": "n"}, ("n",), SIZE)
    return rows.select("page", "title", "url", "country", "n")


@query(f"""WITH p AS (SELECT id, id // 5 + 1 AS page, title, country, degree_level FROM opps), l AS (SELECT max(page) + 1 AS last FROM p),
rows AS (SELECT page, title || ' no. ' || id AS title, CASE id % 3 WHEN 0 THEN DATE '1999-03-01' + CAST(id % 28 AS INT) WHEN 1 THEN NULL ELSE DATE '2000-12-31' END AS deadline, CASE id % 2 WHEN 0 THEN 'United Kingdom' ELSE 'Netherlands' END AS country, coalesce(degree_level, 'Any') AS level, (id % 900 + 100) * CAST(10 AS DOUBLE) AS value FROM p WHERE page % 7 <> 3)
SELECT page, title, deadline, country, level, value, NULL AS error FROM rows UNION ALL SELECT page, NULL, NULL, NULL, NULL, NULL, 'not fetched' FROM (SELECT DISTINCT page FROM p WHERE page % 7 = 3 UNION SELECT last FROM l)""")
def scan_paged_tables(spark, sf_dir):
    """Tables of five rows on pages by template, with typed columns; pages that were not fetched are rows with an error."""
    o = opportunities(spark, sf_dir).withColumn("page", F.floor(F.col("id") / 5) + 1)
    due = F.expr("CASE id % 3 WHEN 0 THEN concat(CAST(1 + id % 28 AS STRING), ' March 1999') WHEN 1 THEN 'to be announced' ELSE '31/12/2000' END")
    due = F.when(due == "31/12/2000", "31 Dec 2000").otherwise(due)
    row = F.concat(F.lit("<tr><td><a href='/x/"), "id", F.lit("'>"), "title", F.lit(" no. "), "id", F.lit("</a></td><td>"), due, F.lit("</td><td>"), F.expr("IF(id % 2 = 0, 'the UK', 'Holland')"), F.lit("</td><td>"),
                   F.coalesce(F.replace("degree_level", F.lit(","), F.lit(" or ")), F.lit("open")), F.lit("</td><td>US$"), (F.col("id") % 900 + 100).cast("string"), F.lit(" per month</td></tr>"))
    html = o.where("page % 7 <> 3").groupBy("page").agg(F.concat(F.lit("<table><tr><th>Name</th><th>Due</th></tr>"), F.array_join(F.array_sort(F.collect_list(row)), ""), F.lit("</table>")).alias("html"))
    fetched = html.select(F.when(F.col("page") == 1, "https://e.org/list/").otherwise(F.concat(F.lit("https://e.org/list/page/"), F.col("page").cast("string"), F.lit("/"))).alias("url"), "html")
    last = o.agg(F.max("page")).first()[0] + 1
    parse = lambda pages: readers.html_table(pages, "e", columns={"title": 0, "deadline": 1, "country": 2, "level": 3, "value": 4})
    rows, errors = paged.paged_listing(fetched, "https://e.org/list/", last, parse)
    rows = paged.typed_cells(rows, AS_OF).select("page", "title", "pre.deadline", "pre.country", "pre.level", "pre.value", F.lit(None).cast("string").alias("error"))
    return rows.unionByName(errors.select("page", "error"), allowMissingColumns=True)
