"""Sources of several pages, read from a table of what was fetched: listings by a template of addresses, and JSON answers until one is empty."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import coerce, countries, dates, money, notices
from gleanery.sources.readers import json_path


def addresses(spark: SparkSession, template: str, first: int, last: int, url: str = "", size: int = 100) -> DataFrame:
    """(page, url) of the pages `first` to `last`: {url}, {page}, {size} and {offset} (pages before it times size) are filled in."""
    filled = F.lit(template.replace("{url}", url).replace("{size}", str(size)))
    for name, value in (("{page}", F.col("page")), ("{offset}", F.col("page") * size)):
        filled = F.replace(filled, F.lit(name), value.cast("string"))
    return spark.range(first, last + 1).select(F.col("id").alias("page"), filled.alias("url"))


def paged_listing(fetched: DataFrame, url: str, last: int, parse: Callable[[DataFrame], DataFrame], template: str = "{url}page/{page}/") -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of a listing: its address and the template's for the pages 2 to `last`, met with `fetched` (url, html). `parse` makes rows with page_url of
    (url, html), one page at a time and each by itself; rows get the number of their page. Errors are (page, url, error): a page that was not fetched
    costs none of the others. A page that came twice is read once."""
    spark = fetched.sparkSession
    wanted = addresses(spark, template, 2, last, url).unionByName(spark.range(1).select(F.lit(1).cast("long").alias("page"), F.lit(url).alias("url")))
    once = fetched.groupBy("url").agg(F.max("html").alias("html"))
    met = wanted.join(once, "url", "left")
    rows = parse(met.where("html <> ''").select("url", "html")).join(wanted.withColumnRenamed("url", "page_url"), "page_url")
    return rows, met.where("coalesce(html, '') = ''").select("page", "url", F.when(F.col("html").isNull(), "not fetched").otherwise("empty").alias("error"))


def first_of(item: Column, path: str, kind: str) -> Column:
    """The value at a dotted path of a variant, of a list its first; null where it is missing or of no such kind."""
    at = json_path(path)
    return F.coalesce(F.try_variant_get(item, f"{at}[0]", kind), F.try_variant_get(item, at, kind))


def paged_json(fetched: DataFrame, template: str, last: int, rows: str, fields: dict[str, str], numeric: tuple[str, ...] = (), size: int = 100) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of the JSON answers `fetched` (url, body) of the pages 0 to `last`. Each answer is parsed once; the list at the dotted path `rows`, or the one object
    there, is mapped by `fields` (name to dotted path, list indexes included; of a list the first). Fields named in `numeric` are doubles,
    numeric strings too, the others strings; rows that are no objects or lack a field `title` or `url` that is mapped go. Reading stops at the first page that is missing, no JSON or
    without a row there, which is an error row; later pages are not read. Rows have page and pos."""
    wanted = addresses(fetched.sparkSession, template, 0, last, size=size)
    once = fetched.groupBy("url").agg(F.max("body").alias("body"))
    parsed = wanted.join(once, "url", "left").withColumn("v", F.try_parse_json("body"))
    listed = F.coalesce(F.try_variant_get("v", json_path(rows), "array<variant>"), F.when(F.schema_of_variant(F.try_variant_get("v", json_path(rows), "variant")).startswith("OBJECT"), F.array(F.try_variant_get("v", json_path(rows), "variant"))))
    parsed = parsed.withColumn("items", listed)
    bad = parsed.where("coalesce(size(items), 0) <= 0")
    stop = bad.agg(F.min("page").alias("stop"))  # one row
    error = F.when(F.col("body").isNull(), "not fetched").when(F.col("v").isNull(), "no JSON").otherwise("empty")
    items = parsed.join(F.broadcast(stop), (F.col("page") < F.col("stop")) | F.col("stop").isNull()).select("page", F.posexplode("items").alias("pos", "item"))
    out = items.where(F.schema_of_variant("item").startswith("OBJECT")).select("page", "pos", *[first_of(F.col("item"), p, "double" if n in numeric else "string").alias(n) for n, p in fields.items()])
    for name in ("title", "url"):
        if name in fields:
            out = out.where(F.col(name) != "")
    return out, bad.join(F.broadcast(stop), F.col("page") == F.col("stop")).select("page", "url", error.alias("error"))


#: How a mapped column of a listing is typed, by its name.
TYPED: dict[str, Callable[[Column, str], Column]] = {
    "deadline": lambda c, as_of: dates.deadline(F.concat(F.lit("Deadline: "), c), as_of)["deadline"], "country": lambda c, as_of: countries.canon(c), "level": lambda c, as_of: coerce.level(c),
    "value": lambda c, as_of: F.array_max(money.amounts(c))["usd"], "fee": lambda c, as_of: notices.application_fee(F.concat(F.lit("Application fee: "), c)),
}


def typed_cells(rows: DataFrame, as_of: str) -> DataFrame:
    """`rows` of a table with `pre`, a struct of what its columns `cell_<name>` say, typed for the names of TYPED; the others are strings."""
    cells = [c[5:] for c in rows.columns if c.startswith("cell_")]
    for n in cells:
        rows = rows.withColumn(f"_pre_{n}", TYPED[n](F.col(f"cell_{n}"), as_of) if n in TYPED else F.col(f"cell_{n}"))
    return rows.withColumn("pre", F.struct(*[F.col(f"_pre_{n}").alias(n) for n in cells])).drop(*[f"_pre_{n}" for n in cells]) if cells else rows
