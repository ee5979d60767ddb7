"""Readers: HTML listings and tables, feeds, JSON endpoints and curated files, each a DataFrame of candidates.

Pages come from a table of url and html, which an ingestion job fills; nothing here touches the network. Paths are read by
Spark alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gleanery.functions.identity import clean_title

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
SHARES = re.compile(r"\b(share|tweet|pin it|whatsapp|facebook)\b", re.I)


class Node:
    """An element with its children and text."""

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None):
        self.tag, self.attrs, self.up, self.inside = tag, attrs, up, []

    def walk(self) -> Iterator[Node]:
        for x in self.inside:
            if isinstance(x, Node):
                yield x
                yield from x.walk()

    def text(self) -> str:
        return " ".join(" ".join(x.text() if isinstance(x, Node) else x for x in self.inside).split())


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.top = self.at = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.inside.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        x = self.at
        while x and x.tag != tag:
            x = x.up
        if x and x.up:
            self.at = x.up

    def handle_data(self, data):
        if self.at.tag not in ("script", "style"):
            self.at.inside.append(data)


def tree(html: str) -> Node:
    b = _Builder()
    b.feed(html)
    b.close()
    return b.top


_SIMPLE = re.compile(r"([A-Za-z][\w-]*|\*)?((?:[.#][\w-]+|\[[\w-]+(?:[*^$]?=[\"']?[^\]\"']*[\"']?)?\])*)$")


def _matches(node: Node, simple: str) -> bool:
    hit = _SIMPLE.match(simple)
    if not hit or (hit[1] not in (None, "*") and hit[1].lower() != node.tag):
        return False
    for part in re.findall(r"[.#][\w-]+|\[[^\]]*\]", hit[2] or ""):
        if part[0] == ".":
            ok = part[1:] in node.attrs.get("class", "").split()
        elif part[0] == "#":
            ok = node.attrs.get("id") == part[1:]
        else:
            name, op, value = re.match(r"\[([\w-]+)([*^$]?=)?[\"']?([^\]\"']*)", part).groups()
            have = node.attrs.get(name)
            ok = have is not None and {None: True, "=": have == value, "*=": value in have, "^=": have.startswith(value), "$=": have.endswith(value)}[op]
        if not ok:
            return False
    return True


def select(root: Node, selector: str) -> list[Node]:
    """Descendants that match a selector of tags, .classes, #ids, [attributes], descendants and commas, in the document's order."""
    chains = [s.split() for s in selector.split(",")]

    def fits(node: Node, chain: list[str]) -> bool:
        if not _matches(node, chain[-1]):
            return False
        up, i = node.up, len(chain) - 2
        while i >= 0 and up:
            if _matches(up, chain[i]):
                i -= 1
            up = up.up
        return i < 0

    return [n for n in root.walk() if any(fits(n, c) for c in chains if c)]


def listing_rows(html: str, url: str, item: str, title: str, limit: int) -> list[tuple[int, str, str, str]]:
    """(pos, title, url, text) of the items of a page; short titles and share links go."""
    out = []
    for node in select(tree(html), item)[:limit * 3]:
        link = next((a for a in select(node, title) if a.attrs.get("href")), None) or next((a for a in select(node, "a[href]")), None)
        name = link.text() if link else ""
        if len(name) >= 12 and not SHARES.search(name) and len(out) < limit:
            out.append((len(out), name, urljoin(url, link.attrs["href"]), node.text()))
    return out


def table_rows(html: str, url: str, row: str, columns: dict[str, int], limit: int) -> list[tuple[int, str, str, list[str]]]:
    """(pos, title, url, cells) of the rows of two cells or more whose title has eight characters."""
    out = []
    for node in select(tree(html), row):
        cells = select(node, "td")
        if len(cells) < 2 or len(out) >= limit:
            continue
        first = cells[min(columns.get("title", 0), len(cells) - 1)]
        link = next(iter(select(first, "a[href]")), None)
        if len(name := (link or first).text()) >= 8:
            out.append((len(out), name, urljoin(url, link.attrs["href"]) if link else url, [c.text() for c in cells]))
    return out


def html_listing(pages: DataFrame, source: str, item: str, title: str = "a[href]", limit: int = 40) -> DataFrame:
    """Candidates of listing pages (url, html): source, page_url, pos, title, url, listing_text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(source, u, *r) for u, h in zip(b["url"], b["html"], strict=True) if h for r in listing_rows(h, u or "", item, title, limit)]
            yield pd.DataFrame(rows, columns=["source", "page_url", "pos", "title", "url", "listing_text"])

    return pages.select("url", "html").mapInPandas(run, "source string, page_url string, pos int, title string, url string, listing_text string")


def html_table(pages: DataFrame, source: str, row: str = "tr", columns: dict[str, int] | None = None, limit: int = 120) -> DataFrame:
    """Candidates of table pages: source, page_url, pos, title, url, cells and one string column for each named column."""
    columns = columns or {"title": 0}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(source, u, *r) for u, h in zip(b["url"], b["html"], strict=True) if h for r in table_rows(h, u or "", row, columns, limit)]
            yield pd.DataFrame(rows, columns=["source", "page_url", "pos", "title", "url", "cells"])

    out = pages.select("url", "html").mapInPandas(run, "source string, page_url string, pos int, title string, url string, cells array<string>")
    return out.select("*", *[F.get("cells", i).alias(f"cell_{name}") for name, i in columns.items() if name != "title"])


def feed(spark: SparkSession, path: str, source: str, limit: int = 40) -> DataFrame:
    """Candidates of RSS items and Atom entries: source, pos, title, url, text; those without title or link go.

    Titles lose site names behind them; of several links of an entry the alternate or else the first counts; text is what the entry says (title,
    link, date, summary, categories), one a line, without markup and whole. A file that is no feed gives nothing.
    """
    say = "title string, description string, summary string, content string, date string, published string, updated string, category array<struct<_VALUE: string, _term: string>>, "
    rss = spark.read.format("xml").option("rowTag", "item").schema(say + "link string").load(path).withColumn("url", F.trim("link"))
    atom = spark.read.format("xml").option("rowTag", "entry").schema(say + "link array<struct<_href: string, _rel: string>>").load(path)
    links = F.filter("link", lambda x: x["_href"] != "")
    atom = atom.withColumn("url", F.coalesce(F.get(F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate"), F.lit(0)), F.get(links, F.lit(0)))["_href"])
    rows = rss.drop("link").unionByName(atom.drop("link")).withColumn("pos", F.monotonically_increasing_id())
    plain = lambda c: F.nullif(F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " ")), F.lit(""))
    named = F.transform("category", lambda x: F.coalesce(x["_VALUE"], x["_term"]))
    text = F.concat_ws("\n", plain("title"), "url", F.coalesce("published", "date", "updated"), *[plain(c) for c in ("description", "summary", "content")], F.nullif(F.concat_ws("\n", named), F.lit("")))
    out = rows.select(F.lit(source).alias("source"), "pos", clean_title(plain("title")).alias("title"), "url", text.alias("text"))
    return out.where("title <> '' AND url <> ''").orderBy("pos").limit(limit)


def json_path(dotted: str) -> str:
    """a.0.b as $.a[0].b, and $ as the root."""
    return "$" if dotted in ("", "$") else "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))


def json_api(spark: SparkSession, path: str, source: str, rows: str, fields: dict[str, str], numeric: tuple[str, ...] = ()) -> DataFrame:
    """Candidates of JSON answers, one a file: the array at the dotted path `rows`, mapped by `fields` (name to dotted path)."""
    raw = spark.read.option("wholetext", "true").text(path)
    items = raw.select(F.posexplode(F.from_json(F.get_json_object("value", json_path(rows)), "array<string>")).alias("pos", "item"))
    out = items.select(F.lit(source).alias("source"), "pos", *[F.get_json_object("item", json_path(p)).alias(n) for n, p in fields.items()])
    for n in numeric:
        out = out.withColumn(n, F.col(n).try_cast("double"))
    return out


def seeds(spark: SparkSession, path: str, as_of: str, live: DataFrame | None = None) -> DataFrame:
    """Curated records of a file {"scholarships": [...]}, with `stale` where their review date is past. `live` (id, deadline, amount_text,
    eligibility, funding_type) overrides what it has, a deadline only by a later one."""
    rows = spark.read.option("multiLine", "true").json(path).select(F.explode("scholarships").alias("r")).select("r.*")
    for c in ("deadline", "amount_text", "eligibility", "funding_type", "review_before", "verify_url", "update_url"):
        if c not in rows.columns:
            rows = rows.withColumn(c, F.lit(None).cast("string"))
    rows = rows.withColumn("check_url", F.coalesce("update_url", "verify_url")).withColumn("stale", F.coalesce(F.try_to_date("review_before") < F.lit(as_of[:10]).cast("date"), F.lit(False)))
    if live is not None:
        new = live.select("id", *[F.col(c).alias(f"_{c}") for c in ("deadline", "amount_text", "eligibility", "funding_type")])
        rows = rows.join(new, "id", "left").withColumn("deadline", F.greatest("deadline", "_deadline"))
        for c in ("amount_text", "eligibility", "funding_type"):
            rows = rows.withColumn(c, F.coalesce(f"_{c}", c))
        rows = rows.drop("_deadline", "_amount_text", "_eligibility", "_funding_type")
    return rows


#: Readers by kind; more can be added.
KINDS: dict[str, Callable] = {"listing": html_listing, "table": html_table, "rss": feed, "json": json_api, "seeds": seeds}


def reader(kind: str | None) -> Callable:
    """The reader of a kind, `listing` by default."""
    if (kind or "listing") not in KINDS:
        raise ValueError(f"unknown kind of source: {kind}")
    return KINDS[kind or "listing"]


def finished(candidates: DataFrame, limit: int) -> DataFrame:
    """The first candidate of each URL of a source, without empty titles and URLs, `limit` a source at most."""
    rows = candidates.where("title <> '' AND url <> ''")
    first = F.row_number().over(Window.partitionBy("source", "url").orderBy("pos"))
    rows = rows.withColumn("_n", first).where("_n = 1")
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("source").orderBy("pos", "url"))).where(F.col("_n") <= limit).drop("_n")
