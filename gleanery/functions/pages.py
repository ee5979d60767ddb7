"""The text of web pages, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lines that begin so belong to the page, not to what it says.
CHROME = ("share", "print", "save", "facebook", "twitter", "linkedin", "whatsapp", "telegram", "related", "leave a comment", "leave a reply", "subscribe",
          "log in", "sign in", "cookie", "cookies", "privacy", "terms of use")
#: Character references.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&rsquo;": "’", "&lsquo;": "‘", "&ndash;": "–", "&mdash;": "—", "&amp;": "&"}


def clean_text(page: Column, most: int | None = None) -> Column:
    """The text of an HTML page, as native expressions: what stands between tags, a line for each block, less scripts, forms and lines of the
    page's frame; a line that is among the last three kept is not repeated. Null gives an empty text. Whole pages, or the first `most` characters of each."""
    t = F.regexp_replace(F.coalesce(page, F.lit("")), r"(?is)<!--.*?-->|<(script|style|noscript|svg|form)\b.*?</\1\s*>", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:br|p|div|section|article|header|footer|nav|ul|ol|li|table|tr|h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, "<[^>]*>", " ")
    for name, sign in ENTITIES.items():
        t = F.replace(t, F.lit(name), F.lit(sign))
    lines = F.transform(F.split(t, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\s\x{a0}]+", " ")))
    frame = "(?i)^(?:" + "|".join(CHROME) + r")(?![a-z])"
    lines = F.filter(lines, lambda x: (F.length(x) >= 2) & ~x.rlike(frame))
    kept = F.aggregate(lines, F.array().cast("array<string>"), lambda acc, x: F.when(
        F.array_contains(F.slice(acc, F.greatest(F.size(acc) - 2, F.lit(1)), F.lit(3)), x), acc).otherwise(F.concat(acc, F.array(x))))
    text = F.array_join(kept, "\n")
    return text if most is None else F.substring(text, 1, most)
