"""Reports: CSV, JSON, Markdown and HTML of a ranked archive, and texts in chunks for message channels."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import notices

#: The columns of the CSV report, in order.
CSV_COLUMNS = ("id", "title", "source", "country", "degree_level", "field", "funding_type", "amount_usd", "amount_text", "deadline", "days_left", "score", "tier", "confidence", "url", "status")


def write_csv(df: DataFrame, path: str) -> None:
    """The report of a bounded top-n in one file with a header."""
    df.select(*CSV_COLUMNS).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def json_report(df: DataFrame, stats: DataFrame, as_of: str) -> DataFrame:
    """One row with the JSON object of a bounded top-n and its statistics."""
    rows = df.agg(F.array_sort(F.collect_list(F.struct(*[c for c in CSV_COLUMNS if c in df.columns])), lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1).otherwise((a["id"] - b["id"]).cast("int"))).alias("rows"))
    return rows.crossJoin(stats.select(F.struct("*").alias("stats"))).select(F.to_json(F.struct(F.lit(as_of).alias("generated_at"), "stats", "rows")).alias("value"))  # one row each


def markdown_line() -> Column:
    return F.format_string("%d. **%s** — %s, %s, score %.1f (%s)", F.col("place"), F.col("title"), F.coalesce("country", F.lit("?")), F.coalesce(F.date_format("deadline", "yyyy-MM-dd"), F.lit("rolling")), F.floor(F.col("score") * 10 + 0.5000001) / 10, F.col("tier"))


def markdown(df: DataFrame, top: int = 40) -> DataFrame:
    """One row with a numbered list of the best `top`."""
    order = [F.desc("score"), F.asc_nulls_last("deadline"), F.col("id")]
    best = df.orderBy(*order).limit(top).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # of `top` rows
    lines = best.select("place", markdown_line().alias("line")).agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("x"))
    return lines.select(F.array_join(F.transform("x", lambda e: e["line"]), "\n").alias("markdown"))


#: The columns of the HTML report, and those by which a reader can narrow it.
HTML_COLUMNS, HTML_FACETS = ("score", "tier", "title", "country", "degree_level", "field", "funding_type", "amount_text", "deadline", "source", "status"), ("tier", "country", "funding_type", "source")
NARROW = """<script>
const boxes = [...document.querySelectorAll("[data-by]")], fits = (row, box) => !box.value
  || (box.dataset.by === "text" ? row.textContent.toLowerCase().includes(box.value.toLowerCase()) : row.dataset[box.dataset.by] === box.value);
const narrow = () => document.querySelectorAll("tbody tr").forEach(row => { row.hidden = !boxes.every(box => fits(row, box)); });
boxes.forEach(box => { box.oninput = narrow; });
</script>"""


def html_row(columns: list[str]) -> Column:
    """A row of the HTML report from a frame with `columns`: a cell for each of HTML_COLUMNS (empty where it is null or missing), its title a link, its facets as attributes."""
    plain = lambda c: notices.escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in columns else F.lit("")
    cells = {c: plain(c) for c in HTML_COLUMNS}
    cells["score"] = F.when(F.col("score").isNull(), "").otherwise(F.format_string("%.1f", F.floor(F.col("score") * 10 + 0.5000001) / 10))
    if "deadline" in columns:
        cells["deadline"] = F.coalesce(F.date_format("deadline", "yyyy-MM-dd"), F.lit("rolling"))
    if "url" in columns:  # other schemes than the web's are no links
        cells["title"] = F.when(F.col("url").rlike("(?i)^https?://"), F.concat(F.lit('<a href="'), plain("url"), F.lit('">'), cells["title"], F.lit("</a>"))).otherwise(cells["title"])
    marks = [F.concat(F.lit(f' data-{c.replace("_", "")}="'), plain(c), F.lit('"')) for c in HTML_FACETS]
    return F.concat(F.lit("<tr"), *marks, F.lit(">"), *[F.concat(F.lit("<td>"), cells[c], F.lit("</td>")) for c in HTML_COLUMNS], F.lit("</tr>"))


def html_report(df: DataFrame, as_of: str = "", top: int = 400) -> DataFrame:
    """One row: the page of the best `top` rows, complete in itself, with a search box and a choice by each of HTML_FACETS."""
    order = [F.desc("score"), F.asc_nulls_last("deadline") if "deadline" in df.columns else F.desc("score"), F.col("id")]
    best = df.orderBy(*order).limit(top).withColumn("_place", F.row_number().over(Window.orderBy(*order)))  # of `top` rows
    facets = [c for c in HTML_FACETS if c in df.columns]
    x = best.agg(F.array_sort(F.collect_list(F.struct(F.col("_place").alias("place"), html_row(df.columns).alias("t")))).alias("rows"), *[F.array_sort(F.collect_set(F.nullif(F.col(c), F.lit("")))).alias(c) for c in facets])
    option = lambda v: F.concat(F.lit("<option>"), notices.escaped(v), F.lit("</option>"))
    choice = [F.concat(F.lit(f'<select data-by="{c.replace("_", "")}"><option value="">{c.replace("_", " ")}</option>'), F.array_join(F.transform(c, option), ""), F.lit("</select>")) for c in facets]
    head = f'<!DOCTYPE html><html><head><meta charset="utf-8"><title>Report</title></head><body><p>{html.escape(as_of)}</p><input data-by="text" placeholder="search">'
    heads = "".join(f"<th>{c.replace('_', ' ')}</th>" for c in HTML_COLUMNS)
    return x.select(F.concat(F.lit(head), *choice, F.lit(f"<table><thead><tr>{heads}</tr></thead><tbody>"), F.array_join(F.transform("rows", lambda r: r["t"]), "\n"), F.lit(f"</tbody></table>{NARROW}</body></html>")).alias("page"))


def html_page(df: DataFrame, top: int = 400) -> str:
    """The HTML report of the best `top`, which the driver writes."""
    return html_report(df, top=top).first()[0]


def chunked(text: Column, size: int = 3500, most: int = 4) -> Column:
    """Lines packed greedily into chunks of `size` characters, of which the first `most` are given; a longer line is a chunk of its own, whole."""
    fold = F.aggregate(
        F.split(text, "\n"), F.array().cast("array<string>"),
        lambda acc, line: F.when(F.size(acc) > most, acc).when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + 1 + F.length(line) <= size),
                                 F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit("\n"), line)))).otherwise(F.concat(acc, F.array(line))))
    return F.slice(fold, 1, most)


def blocks(df: DataFrame, key: str, place: str, text: str, size: int = 4096, between: str = "\n\n") -> DataFrame:
    """Messages of blocks: per `key` the texts in order of `place`, packed greedily into messages of `size` characters with `between` them. A longer
    block is a message of its own, whole; empty and null ones are none. A digest's blocks per key are bounded, and one task packs those of a key."""
    rows = df.where(F.col(text) != "").groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), F.col(text).alias("t")))).alias("b"))
    fold = F.aggregate(
        F.transform("b", lambda e: e["t"]), F.array().cast("array<string>"),
        lambda acc, t: F.when((F.size(acc) > 0) & (F.length(F.element_at(acc, -1)) + len(between) + F.length(t) <= size),
                              F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat(F.element_at(acc, -1), F.lit(between), t)))).otherwise(F.concat(acc, F.array(t))))
    return rows.select(key, F.posexplode(fold).alias("part", "message"))


#: The columns of the tables of runs and of notifications.
RUNS = ("id long, run_id string, source string, started_at timestamp_ntz, duration_ms int, items_found int, items_new int, items_changed int, items_skipped int, items_error int, "
        "detail_fetches int, cache_hits int, llm_calls int, llm_tokens_in int, llm_tokens_out int, llm_cost_usd double, status string, error string, consecutive_failures int")
NOTIFICATIONS = "id long, created_at timestamp_ntz, channel string, recipient string, digest_key string, count int, status string, detail string"
#: What a run can end in, and what the log of notifications keeps.
RUN_STATUS, NOTICE_STATUS = ("ok", "empty", "blocked", "error"), ("sent", "dry-run")


def shaped(df: DataFrame, schema: str) -> DataFrame:
    """`df` with exactly the columns of `schema`: missing counts and costs are 0, other missing ones null, a value that can't be cast is null."""
    out = []
    for field in schema.split(", "):
        name, kind = field.split(" ")
        zero = F.lit(0).cast(kind) if kind in ("int", "double") else F.lit(None).cast(kind)
        value = F.col(name).try_cast(kind) if name in df.columns else zero
        out.append((F.coalesce(value, zero) if kind in ("int", "double") else value).alias(name))
    return df.select(*out)


def append_runs(df: DataFrame, path: str) -> None:
    """Appends rows of runs; a status that is none becomes `ok`, or `error` where there is an error."""
    status = F.when(F.col("status").isin(*RUN_STATUS), F.col("status")).when(F.col("error") != "", "error").otherwise("ok")
    shaped(df, RUNS).withColumn("status", status).write.mode("append").parquet(path)


def append_notifications(df: DataFrame, path: str, most: int = 900) -> None:
    """Appends what was sent, or would have been in a dry run; other rows leave no trace. Details keep their first `most` characters, as the log's feature."""
    shaped(df, NOTIFICATIONS).where(F.col("status").isin(*NOTICE_STATUS)).withColumn("detail", F.left("detail", F.lit(most))).write.mode("append").parquet(path)


def digest_page(entries: DataFrame, subject: str, as_of: str, text: str = "html", footer: str = "") -> DataFrame:
    """One row: the HTML page of a bounded digest (place and `text`, HTML already), headed by its subject, time and number of matches."""
    rows = entries.agg(F.array_sort(F.collect_list(F.struct("place", F.col(text).alias("t")))).alias("x"))
    head = f"<!DOCTYPE html><html><head><meta charset=\"utf-8\"><title>{html.escape(subject)}</title></head><body><h2>{html.escape(subject)}</h2><p>{html.escape(as_of)} · "
    return rows.select(F.concat(F.lit(head), F.size("x").cast("string"), F.lit(" matches</p>"), F.array_join(F.transform("x", lambda e: e["t"]), ""), F.lit(f"<footer>{html.escape(footer)}</footer></body></html>")).alias("page"))


def send_file(digest: DataFrame, folder: str, text: str = "markdown") -> None:
    """Appends the entries of a bounded digest (place and `text`) as one text file in `folder`, in order of place."""
    digest.coalesce(1).sortWithinPartitions("place").select(F.concat(F.col(text), F.lit("\n")).alias("value")).write.mode("append").text(folder)


def send_console(digest: DataFrame, text: str = "plain", most: int = 25) -> None:
    """Prints the first `most` entries of a digest."""
    for row in digest.orderBy("place").limit(most).select(text).collect():
        print(row[0], end="\n\n")
