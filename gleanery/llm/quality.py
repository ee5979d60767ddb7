"""Quality rules, line first.

Each line is held against rules on punctuation, navigation and boilerplate; failing lines are removed, and a
document that loses more than half of its characters is rejected.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import free_name, small_batches

#: Fixed values.
SYMBOLS = "#*$%&|<>"
SEPARATORS = (" | ", " > ", " » ", " › ", " · ")
EMPHASIS = r"[!?]{2,}"
STOPS = r"[.!?。！？]"
NAVIGATION = r"(?i)^(home|menu|skip to|log ?in|sign (in|up|out)|next|previous|back to top|share this|read more|click here|search|contact us|about us)\b"
BOILERPLATE = (r"(?i)(all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie policy|"
               r"uses cookies|accept cookies|enable javascript|subscribe to our|sign up for our newsletter|lorem ipsum|copyright ©)")

_EMPHASIS, _STOPS, _NAVIGATION, _BOILERPLATE = map(re.compile, (EMPHASIS, STOPS, NAVIGATION, BOILERPLATE))
_DROP = str.maketrans("", "", SYMBOLS)
SCHEMA = ("struct<n_words:long,word_chars:long,n_symbols:long,n_dup_lines:long,n_repeat_words:long,base_failed:boolean,"
          "kept:boolean,n_failed_lines:long,lost_chars:long,clean_text:string>")


def line_fails(line: str, n: int, chars: int) -> bool:
    """The rules for a line of `n` words and `chars` characters in words."""
    symbols = len(line) - len(line.translate(_DROP))
    if 10 * symbols > chars:
        return True
    if 3 * len(_EMPHASIS.findall(line)) > n:
        return True
    separators = sum(map(line.count, SEPARATORS))
    if separators >= 2 and 6 * separators > n:
        return True
    if n <= 6 and _NAVIGATION.search(line):
        return True
    if n >= 20 and not _STOPS.search(line):
        return True
    if n >= 5 and line.isupper():
        return True
    return bool(_BOILERPLATE.search(line))


def assess(text: str | None, max_lost: float) -> tuple:
    """What SCHEMA names, for one text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    word_chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) < len(windows):
        times, upto = Counter(windows), 0
        for i, w in enumerate(windows):
            if times[w] > 1:
                repeated += i + 3 - max(i, upto)
                upto = i + 3
    seen, twice, failed, lost, clean = set(), 0, 0, 0, []
    for line in text.split("\n"):
        k = len(line.encode("utf-8", "surrogatepass").split())
        if not k:
            clean.append(line)
            continue
        if line in seen:
            twice += 1
        seen.add(line)
        chars = len(line) - sum(map(line.count, " \t\x0b\x0c\r"))
        if line_fails(line, k, chars):
            failed += 1
            lost += chars
        else:
            clean.append(line)
    base_failed = n < 50 or 100 * repeated > 50 * n
    kept = not base_failed and lost <= max_lost * word_chars
    return (n, word_chars, len(text) - len(text.translate(_DROP)), twice, repeated, base_failed, kept, failed, lost, "\n".join(clean))


def clean_lines(df: DataFrame, max_lost: float = 0.5, text: str = "text", with_text: bool = True) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_failed_lines, lost_chars (long), base_failed,
    kept (boolean) and, unless `with_text` is false, clean_text, the text without failing lines, to every row of `df`.

    A null text counts as empty: no words, base_failed, not kept, clean_text ''. Lines without a word neither fail nor
    count. Texts are taken whole; equal rows get equal verdicts; columns of `df` with these names are replaced; an
    empty table gives an empty table. One pass without a shuffle.
    """
    small_batches(df.sparkSession)
    fields = re.findall(r"(\w+):\w+", SCHEMA)
    schema = SCHEMA if with_text else SCHEMA.replace(",clean_text:string", "")
    names = fields if with_text else fields[:-1]

    @F.pandas_udf(schema)
    def verdict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([assess(t, max_lost)[:len(names)] for t in batch], columns=names)

    kept = [c for c in df.columns if c.lower() not in fields]
    name = free_name(df, "verdict")
    out = df.withColumn(name, verdict(F.col(text)))
    return out.select(*kept, *[F.col(f"{name}.{c}").alias(c) for c in names])


def _sql(text: str) -> str:
    return text.replace("'", "''")


#: The same in DuckDB's SQL, for the parameters of the registered query.
ORACLE_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
words AS (SELECT rid, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM docs),
wins AS (
    SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
    FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM words)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS n FROM wins) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY rid),
lines AS (
    SELECT rid, unnest(string_split(text, chr(10))) AS l FROM docs),
worded AS (
    SELECT rid, l, len(regexp_extract_all(l, '[^\\x20\\x09-\\x0D]+')) AS n,
        length(regexp_replace(l, '[\\x20\\x09-\\x0D]+', '', 'g')) AS chars FROM lines WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]')),
judged AS (
    SELECT *, (
        10 * len(regexp_extract_all(l, '[#*$%&|<>]')) > chars
        OR 3 * len(regexp_extract_all(l, '{EMPHASIS}')) > n
        OR (seps >= 2 AND 6 * seps > n)
        OR (n <= 6 AND regexp_matches(l, '{_sql(NAVIGATION)}'))
        OR (n >= 20 AND NOT regexp_matches(l, '{STOPS}'))
        OR (n >= 5 AND upper(l) = l AND lower(l) <> l)
        OR regexp_matches(l, '{_sql(BOILERPLATE)}')) AS fails
    FROM (SELECT *, ({' + '.join(f"(length(l) - length(replace(l, '{s}', ''))) // 3" for s in SEPARATORS)}) AS seps FROM worded)),
by_line AS (
    SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines, count_if(fails) AS n_failed_lines,
        coalesce(sum(chars) FILTER (fails), 0) AS lost_chars FROM judged GROUP BY rid),
base AS (
    SELECT d.rid, doc_id, len(w) AS n_words, length(regexp_replace(text, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, coalesce(c.n, 0) AS n_repeat_words,
        coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(lost_chars, 0) AS lost_chars, coalesce(n_failed_lines, 0) AS n_failed_lines
    FROM docs d JOIN words USING (rid) LEFT JOIN covered c USING (rid) LEFT JOIN by_line USING (rid))
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
    CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
    NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * lost_chars <= word_chars AS kept,
    CAST(n_failed_lines AS BIGINT) AS n_failed_lines, CAST(lost_chars AS BIGINT) AS lost_chars
FROM base
"""
