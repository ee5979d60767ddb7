"""Mixing sources to target weights by systematic sampling.

Every document of a source has the same expected number of copies, its source's target over its source's
size. The documents of a source stand in one order, by size class and within it by hash and size; the running
total of expected copies, moved by one random offset, is cut at whole numbers, and a document is emitted once
for each boundary that it crosses. As neighbours are alike in size, the words taken follow the target.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import WORD_PATTERN, maybe_broadcast, written

#: Parts into which each class of (source, size) can be dealt, so that no source or size is one task's work.
SLICES = 256
#: Parts aimed at over all rows.
STRATA = 1024


def mix(df: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, seed: str = "mix",
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Adds size, source_size (long), target (double), copies (int) and taken (long) to every row of `df`.

    size is the number of words of the text (null: 0). Sources, by code point and null last, take `weights` in
    turn; targets share the sum of all sizes by weight, none above `cap` times its source's size, what is over
    being shared anew. A null source is a source of its own; rows of no words may be taken or not and add
    nothing; rows that are equal in every respect stand side by side in any order; columns of `df` with these
    names are replaced; an empty table gives an empty table. Reruns agree, as all that is random is a hash of
    `seed`, the source and the identifier.

    One scan counts rows by (source, size class, slice), a table of bounded size that gives each row its
    place; one shuffle numbers the rows within their slice.
    """
    spark = df.sparkSession
    out = [c for c in df.columns if c.lower() not in {"size", "source_size", "target", "copies", "taken"}]
    rows = df.select(
        *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(out)],  # own names, so that none clashes with what follows
        F.col(source).alias("_src"), F.col(doc_id).alias("_id"),
        F.coalesce(F.regexp_count(F.col(text), F.lit(WORD_PATTERN)), F.lit(0)).cast("long").alias("size"),
        F.expr(f"CAST(conv(substr(md5(coalesce(CAST(`{doc_id}` AS STRING), '')), 1, 8), 16, 10) AS BIGINT) DIV {2**32 // SLICES}").alias("_slice"),
    ).withColumn("_class", F.expr("length(bin(size)) * 8 + (size * 8) DIV shiftleft(1L, length(bin(size)))"))
    groups = written(rows.groupBy("_src", "_class", "_slice").agg(F.count("*").alias("n"), F.sum("size").alias("words")), "mix")
    places = spark.sql(f"""
        WITH by_source AS (
            SELECT _src, sum(words) AS s, row_number() OVER (ORDER BY _src ASC NULLS LAST) AS rank
            FROM {{groups}} GROUP BY _src),
        weighted AS (
            SELECT *, element_at(array({', '.join(map(str, weights))}), CAST((rank - 1) % {len(weights)} + 1 AS INT)) AS w FROM by_source),
        level AS (
            SELECT *, (sum(s) OVER () - (sum({cap} * s) OVER (ORDER BY CAST({cap} * s AS DOUBLE) / w, rank) - {cap} * s))
                / CAST(sum(w) OVER (ORDER BY CAST({cap} * s AS DOUBLE) / w DESC, rank DESC) AS DOUBLE) AS share
            FROM weighted),
        targets AS (
            SELECT _src, s AS source_size, least(CAST({cap} * s AS DOUBLE), max(share) OVER () * w) AS target,
                CAST(conv(substr(md5(concat('{seed}', coalesce(_src, '\\0'))), 1, 8), 16, 10) AS BIGINT) / 4294967296.0D AS u
            FROM level),
        classes AS (
            SELECT *, least({SLICES}, sum(n) OVER (PARTITION BY _src, _class) * {STRATA} DIV (SELECT sum(n) FROM {{groups}}) + 1) AS k
            FROM {{groups}}),
        strata AS (SELECT *, _slice * k DIV {SLICES} AS _stratum FROM classes),
        offsets AS (
            SELECT _src, _class, _stratum, sum(sum(n)) OVER (PARTITION BY _src ORDER BY _class, _stratum) - sum(n) AS before
            FROM strata GROUP BY _src, _class, _stratum)
        SELECT a._src AS g_src, a._class AS g_class, a._slice AS g_slice, a._stratum, before, source_size, target, u,
            CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0D END AS rate
        FROM strata a
        JOIN offsets b ON a._src <=> b._src AND a._class = b._class AND a._stratum = b._stratum
        JOIN targets c ON a._src <=> c._src""", groups=groups)
    places = maybe_broadcast(places, groups.count())
    placed = rows.join(places, F.expr("_src <=> g_src AND _class = g_class AND _slice = g_slice"))
    return (placed
            .withColumn("_i", F.expr("before + row_number() OVER (PARTITION BY _src, _class, _stratum ORDER BY size, _id) - 1"))
            .withColumn("copies", F.expr(f"CAST(greatest(0, least({cap}, floor(u + (_i + 1) * rate) - floor(u + _i * rate))) AS INT)"))
            .withColumn("taken", F.expr("copies * size"))
            .select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(out)], "size", "source_size", "target", "copies", "taken"))


def emitted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **parameters) -> DataFrame:
    """The rows of `df` as many times as `mix` takes them, with the columns of `df`, whatever their names; nulls and repeated rows as there."""
    names = {c: f"_d{i}" for i, c in enumerate(df.columns)}
    mixed = mix(df.toDF(*names.values()), doc_id=names[doc_id], text=names[text], source=names[source], **parameters)
    return mixed.withColumn("_copy", F.explode(F.expr("array_repeat(1, copies)"))).select(*[F.col(n).alias(c) for c, n in names.items()])


#: The same in DuckDB's SQL, for the parameters of the registered query.
ORACLE_SQL = """
WITH sized AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
        CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) // 16777216 AS slice
    FROM documents),
rows_ AS (SELECT *, length(bin(size)) * 8 + (size * 8) // (CAST(1 AS BIGINT) << length(bin(size))) AS class FROM sized),
by_source AS (
    SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM rows_ GROUP BY source),
weighted AS (SELECT *, CAST([5, 2, 1][CAST((rank - 1) % 3 + 1 AS INT)] AS BIGINT) AS w FROM by_source),
level AS (
    SELECT *, CAST(sum(s) OVER () - (sum(3 * s) OVER (ORDER BY CAST(3 * s AS DOUBLE) / w, rank) - 3 * s) AS DOUBLE)
        / CAST(sum(w) OVER (ORDER BY CAST(3 * s AS DOUBLE) / w DESC, rank DESC) AS DOUBLE) AS share
    FROM weighted),
targets AS (
    SELECT source, s AS source_size, least(CAST(3 * s AS DOUBLE), max(share) OVER () * w) AS target,
        CAST(('0x' || substr(md5('mix' || coalesce(source, chr(0))), 1, 8)) AS BIGINT) / 4294967296.0 AS u
    FROM level),
classes AS (
    SELECT *, least(256, count(*) OVER (PARTITION BY source, class) * 1024 // count(*) OVER () + 1) AS k FROM rows_),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, slice * k // 256, size, doc_id) - 1 AS i FROM classes)
SELECT p.doc_id, p.size, t.source_size, t.target,
    CAST(greatest(0, least(3, floor(u + (i + 1) * rate) - floor(u + i * rate))) AS BIGINT) * p.size AS taken
FROM placed p
JOIN (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM targets) t
ON p.source IS NOT DISTINCT FROM t.source
"""
