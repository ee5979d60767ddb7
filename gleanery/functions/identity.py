"""URLs, titles and hashes that identify an opportunity across sources; all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that don't identify a page, and words that don't identify a title.
TRACKING = "^(utm_|ga_|ref|source|mc_|igshid|fbclid)"
STOP_WORDS = "(scholarships?|fellowships?|grants?|programmes?|programs?|the|for|of|in|at|and|a|an|international|students?)"


def normalize_url(url: Column) -> Column:
    """A URL's identity: https, host in lower case without one leading www., no index page, trailing slash, fragment or tracking
    parameter, the others sorted and joined by &. What is no http(s) URL is put in lower case without trailing slashes."""
    u = F.trim(url)
    part = lambda i: F.regexp_extract(u, r"(?i)^https?://([^/?#]+)([^?#]*)(?:\?([^#]*))?", i)
    host = F.regexp_replace(F.lower(part(1)), r"^www\.", "")
    path = F.regexp_replace(F.regexp_replace(part(2), r"(?i)/index\.html?$", "/"), "/+$", "")
    path = F.when(path == "", "/").otherwise(path)
    kept = F.array_sort(F.filter(F.split(part(3), "&"), lambda x: (x != "") & ~F.lower(x).rlike(TRACKING)))
    query = F.array_join(kept, "&")
    return F.when(u.rlike(r"(?i)^https?://[^/?#]+"), F.concat(F.lit("https://"), host, path, F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))).otherwise(
        F.regexp_replace(F.lower(u), "/+$", ""))


def normalize_title(title: Column) -> Column:
    """A title's identity: lower case, without years, stop words and marks."""
    t = F.regexp_replace(F.lower(title), "&amp;", " and ")
    t = F.regexp_replace(t, r"\b20[0-9]{2}(\s*[-/–]\s*([0-9]{2}|20[0-9]{2}))?\b", " ")
    t = F.regexp_replace(F.regexp_replace(t, "[’']", ""), "[^a-z0-9 ]", " ")
    t = F.regexp_replace(t, rf"\b{STOP_WORDS}\b", " ")
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def clean_title(title: Column) -> Column:
    """A title without up to two trailing site names behind | · or •."""
    t = title
    for _ in range(2):
        t = F.regexp_replace(t, r"\s+[|·•]\s+[A-Z][^|·•]*$", "")
    return F.substring(F.regexp_replace(F.regexp_replace(t, r"^[\s\-|·•]+", ""), r"[\s\-|·•]+$", ""), 1, 400)


def canonical_key(title: Column, deadline: Column, url: Column) -> Column:
    """The identity across sources: title and day of the deadline, or the URL where the title says nothing."""
    t = normalize_title(title)
    day = F.coalesce(F.date_format(deadline, "yyyy-MM-dd"), F.lit(""))
    return F.substring(F.sha2(F.concat(t, F.lit("|"), day, F.when(t == "", F.concat(F.lit("|"), F.substring(url, 1, 120))).otherwise("")), 256), 1, 24)


def text_hash(text: Column) -> Column:
    """A hash of what a page says: without tags, case and white space; null for nothing."""
    t = F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, "<[^>]+>", " "), r"[ \t\n\r\f]+", " ")))
    return F.when(t != "", F.substring(F.sha2(t, 256), 1, 32))


def facts_hash(columns: list[str]) -> Column:
    """A hash of a row's facts; only equality matters."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 32)


def looks_like_shell(html: Column) -> Column:
    """Whether a page is an empty shell that a script fills: of modest size, with a sign of one, and hardly a body."""
    signs = ("id=\"root\"", "id=\"app\"", "__next_data__", "ng-app", "data-reactroot", "enable javascript")
    body = F.regexp_replace(F.regexp_extract(html, r"(?is)<body[^>]*>(.*)", 1), r"(?is)<script.*?</script>", "")
    found = F.lit(False)
    for s in signs:
        found = found | F.contains(F.lower(html), F.lit(s))
    return (F.length(html) <= 200_000) & found & (F.length(body) < 4000)
