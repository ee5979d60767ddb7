"""Near-duplicate lines by a segment-partition edit join, in DataFrame operations only.

A line is a repeat if the same line, or one within `tau` edits, occurs earlier. A line is cut into tau + 1
segments; a line within tau edits has at least one of them as a substring near its place, so every line probes,
for its own length and each of the tau lengths below, the few substrings where a segment may stand. Pairs that meet
are told apart by parities of their pairs of neighbouring letters, of which an edit changes four at most, and verified by
banded bit-parallel edit distance between what their common ends leave. Where very many lines meet at one segment, what
stands left and right of it is cut and probed in the same way, again and again, which loses no pair, as the edits between
the rests are no more.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.llm.common import free_name, maybe_broadcast, written

#: Words of 64 bits that hold a line's parities.
PARITIES = ("p0", "p1", "p2", "p3")
WORDED = r"[^\x20\x09-\x0D]"


def probes(tau: int) -> list[tuple[int, int, int]]:
    """(letters that the owner has less, segment, shift) of every substring that a line probes."""
    return [(d, i, s) for d in range(tau + 1) for i in range(tau + 1) for s in range(max(-i, d - (tau - i)), min(i, d + tau - i) + 1)]


def cut(lines: DataFrame, tau: int, least: int, combos: str, *kept: str) -> DataFrame:
    """The substrings of `lines` (u: the text in UTF-32, n: code points): kept, own, d, at, width (code points) and key, a hash of the
    owner's length, the segment's number and the substring; `combos` is SQL for an array of (own, d, i, s). One expression serves all."""
    k = tau + 1
    rows = lines.select(*kept, "u", "n", F.explode(F.expr(combos)).alias("c")).select(*kept, "u", "n", "c.own", "c.d", "c.i", "c.s", F.expr("n - c.d").alias("size"))
    rows = rows.select(*kept, "u", "n", "own", "d", "i", "size", F.expr(f"CAST(i * (size DIV {k}) + greatest(0, i - {k} + size % {k}) + s AS INT)").alias("at"),
                       F.expr(f"CAST(size DIV {k} + CAST(i >= {k} - size % {k} AS INT) AS INT)").alias("width"))
    rows = rows.where(f"size >= {least} AND at >= 0 AND at + width <= n")
    return rows.select(*kept, "own", "d", "at", "width", F.expr("xxhash64(size, i, substring(u, 4 * at + 1, 4 * width))").alias("key"))


def sql_array(rows: list[tuple[bool, int, int, int]]) -> str:
    return "array(" + ", ".join(f"named_struct('own', {str(own).lower()}, 'd', {d}, 'i', {i}, 's', {s})" for own, d, i, s in rows) + ")"


def roles(tau: int) -> str:
    """What a line puts in as an owner of segments, and what it probes, apart."""
    return sql_array([(True, 0, i, 0) for i in range(tau + 1)] + [(False, *p) for p in probes(tau)])


def parities(lines: DataFrame) -> DataFrame:
    """PARITIES of `lines` (lid, u, n): bit h is set if the pairs of neighbouring letters with the hash h are odd in number."""
    pairs = lines.select("lid", "u", F.explode(F.expr("sequence(0, greatest(n - 2, 0))")).alias("i")).select("lid", F.expr("xxhash64(substring(u, 4 * i + 1, 8))").alias("g"))
    return pairs.groupBy("lid").agg(*[F.bit_xor(F.expr(f"IF((g & 192) = {64 * w}, shiftleft(1L, CAST(g & 63 AS INT)), 0L)")).alias(p) for w, p in enumerate(PARITIES)])


def within(a: str, b: str, tau: int) -> str:
    """SQL for the edit distance of two arrays of characters, or a number above `tau` if it is more; `a` has as many or more.

    Column by column of the shorter string, a word of 2 * tau + 1 bits holds where the distance rises or falls down
    the band; the distance on the last cell's diagonal grows by one wherever its bit is not set.
    """
    full = (1 << (2 * tau + 1)) - 1
    match = " | ".join(f"IF(j - {tau} + {k} >= 1 AND get({a}, j - {tau} + {k} - 1) = get({b}, j - 1), {1 << k}, 0)" for k in range(2 * tau + 1))
    zero = "((((p.m & p.vp) + p.vp) ^ p.vp) | p.m | p.vn)"
    return f"""
        aggregate(sequence(1, size({b})),
            named_struct('vp', {full & ~((1 << tau) - 1)}, 'vn', 0, 'd', size({a}) - size({b})),
            (s, j) -> IF(s.d > {tau}, s,
                transform(transform(transform(
                    array(named_struct('m', {match}, 'vp', s.vp, 'vn', s.vn)),
                    p -> named_struct('z', {zero} & {full}, 'vp', p.vp, 'vn', p.vn)),
                    q -> named_struct('z', q.z, 'hp', (q.vn | ~(q.z | q.vp)) & {full}, 'hn', q.z & q.vp)),
                    r -> named_struct('vp', (r.hn | ~(shiftright(r.z, 1) | r.hp)) & {full}, 'vn', shiftright(r.z, 1) & r.hp,
                        'd', s.d + IF(shiftright(r.z, size({a}) - size({b}) + {tau}) & 1 = 0, 1, 0)))[0]),
            s -> s.d)"""


def common(a: str, b: str, room: str, at: str) -> str:
    """SQL for the length of what two texts in UTF-32 share, no more than `room`: doubling steps from the largest down; `at` is the
    place of the next `w` letters behind `p` shared ones in {t}."""
    same = f"substring({a}, {at.format(t=a)}, 4 * w) = substring({b}, {at.format(t=b)}, 4 * w)"
    return f"aggregate(transform(sequence(0, 30), k -> shiftleft(1, 30 - k)), 0, (p, w) -> IF(w <= {room} - p AND {same}, p + w, p))"


def letters(u: str) -> str:
    return f"IF(length({u}) = 0, CAST(array() AS array<binary>), transform(sequence(0, length({u}) DIV 4 - 1), k -> substring({u}, 4 * k + 1, 4)))"


def distance(x: str, m: str, y: str, n: str, tau: int) -> str:
    """SQL for the edit distance of two texts in UTF-32 of `m` and `n` code points, m <= n, as `within` gives it, common ends taken off
    first. Each step is bound by a lambda, so that a filter that is moved down does not take it again at every letter."""
    rest = ", ".join(f"'{c}', {letters(f'substring({u}, 4 * front + 1, 4 * ({size} - front - back))')}" for c, u, size in (("x", x, m), ("y", y, n)))
    inner = f"transform(array(named_struct({rest})), o -> IF(size(o.x) = 0, size(o.y), {within('o.y', 'o.x', tau)}))[0]"
    behind = common(x, y, f"({m} - front)", "CAST(length({t}) - 4 * (p + w) + 1 AS INT)")
    return f"transform(array({common(x, y, m, '4 * p + 1')}), front -> transform(array({behind}), back -> {inner})[0])[0]"


def near_links(lines: DataFrame, tau: int, min_chars: int, crowd: int = 4096, levels: int = 3) -> DataFrame:
    """Pairs (a, b) of first places of different lines within `tau` edits; lines: (place, line), repeats allowed.

    `crowd` is the number of rows at one key beyond which its lines are cut once more, up to `levels` times; both bear on
    the plan alone, the pairs are the same. Lines are told apart by a hash of 64 bits; only two lines that are near each
    other and have the same hash, which no known text has, would be missed. Broadcast are tables of numbers only.
    """
    long = lines.where(F.length("line") >= min_chars).select("place", "line", F.xxhash64("line").alias("lid"), F.encode("line", "UTF-32").alias("u"), F.length("line").alias("n"))
    # lines that meet an owner of a segment there
    every = cut(long, tau, min_chars, sql_array([(d == 0 and s == 0, d, i, s) for d, i, s in probes(tau)]), "lid").select("key", "lid", "own")
    met = every.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.max("own").alias("owned")).where("lo <> hi AND owned").select("key")
    met = written(met, "keys")
    n_met = met.count()
    lids = written(every.join(maybe_broadcast(met, n_met), "key", "left_semi").select("lid").distinct(), "lids")
    few = long.join(maybe_broadcast(lids, lids.count()), "lid", "left_semi").groupBy("lid").agg(F.min("place").alias("place"), F.first("u").alias("u"), F.first("n").alias("n"))
    few = written(few, "lines")
    marked = few.select("lid", "u", "n").join(parities(few), "lid")
    rows = cut(marked, tau, min_chars, roles(tau), "lid", *PARITIES).join(maybe_broadcast(met, n_met), "key", "left_semi")

    def candidates(rows: DataFrame, keys: DataFrame) -> DataFrame:
        mine = rows.join(keys.select("key"), "key", "left_semi").select("key", "lid", "own", "d", *PARITIES)
        x, y = (mine.where(side).select("key", "d", *[F.col(c).alias(f"{n}{c}") for c in ("lid", *PARITIES)]) for n, side in (("x", "own"), ("y", "NOT own")))
        differ = reduce(Column.__add__, [F.bit_count(F.col(f"x{p}").bitwiseXOR(F.col(f"y{p}"))) for p in PARITIES])
        met = x.drop("d").join(y, "key").where((differ <= 4 * tau) & F.expr("IF(d = 0, xlid < ylid, xlid <> ylid)"))
        return met.select(F.col("xlid").alias("x"), F.col("ylid").alias("y"))

    pairs, level = [], 0
    while True:
        rows = written(rows, "probes")
        keys = rows.groupBy("key").agg(F.min("lid").alias("lo"), F.max("lid").alias("hi"), F.max("own").alias("owned"), F.min("own").alias("only"), F.count("*").alias("n"))
        keys = written(keys.where("lo <> hi AND owned AND NOT only").select("key", "n"), "crowds")
        last = level == levels
        pairs.append(candidates(rows, keys if last else keys.where(F.col("n") <= crowd)))
        dense = keys.where(F.col("n") > crowd)
        if last or dense.isEmpty():
            break
        # what stands left and right of the segment; the owner's side keeps its part, and a line that probes knows how much longer it is
        held = rows.join(dense.select("key"), "key", "left_semi").withColumnRenamed("key", "up")
        held = held if level else held.join(few.select("lid", "u"), "lid")
        held = held.withColumn("u", F.expr("concat(substring(u, 1, 4 * at), encode('\u0001', 'UTF-32'), substring(u, 4 * (at + width) + 1))")).withColumn("n", F.expr("length(u) DIV 4").cast("int"))
        kept = ("up", "lid", "u", *PARITIES)
        parts = [cut(held.where("own"), tau, 0, sql_array([(True, 0, i, 0) for i in range(tau + 1)]), *kept)]
        parts += [cut(held.where(f"NOT own AND d = {d}").drop("own", "d"), tau, 0, sql_array([(False, *p) for p in probes(tau) if p[0] == d]), *kept) for d in range(tau + 1)]
        rows = reduce(DataFrame.unionByName, parts).withColumn("key", F.xxhash64("up", "key")).drop("up")
        level += 1
    found = written(reduce(DataFrame.unionByName, pairs).distinct(), "pairs")
    x, y = (few.select(F.col("lid").alias(c), F.col("place").alias(f"{c}_place"), F.col("u").alias(f"{c}u"), F.col("n").alias(f"{c}n")) for c in "xy")
    both = found.join(x, "x").join(y, "y")
    both = both.where(F.expr(f"{distance('xu', 'xn', 'yu', 'yn', tau)} <= {tau}"))  # the owner x is the shorter one
    return both.select(F.least("x_place", "y_place").alias("a"), F.greatest("x_place", "y_place").alias("b")).distinct()


def mark_lines(df: DataFrame, tau: int = 2, min_chars: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of `df`: doc_id, _row, n_lines, n_exact, n_near, n_kept (long), removed_lines (array of line numbers from 0).

    A line without a word always stays. A line is an exact repeat if it stands earlier in the table, by doc_id, row and
    line; it is a near repeat if it has `min_chars` code points at least, is not exact, and a different such line within
    `tau` edits stands earlier anywhere. A null text has no lines and an empty one a single line without a word. Rows
    with the same or a null doc_id are documents of their own, in the table's order. Texts and lines are taken whole; an
    empty table gives an empty table. `df` must give the same rows in the same order when read again.
    """
    docs = df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("_row"))
    lines = (docs.select("doc_id", "_row", F.posexplode(F.split("text", "\n")).alias("i", "line"))
             .where(F.col("line").rlike(WORDED)).withColumn("place", F.struct("doc_id", "_row", "i")))
    links = near_links(lines.select("place", "line"), tau, min_chars)
    late = links.select(F.col("b").alias("first")).distinct().withColumn("near", F.lit(True))
    # lines that occur twice, with their first place, and those with a near line before
    known = lines.groupBy(F.unhex(F.md5("line")).alias("h")).agg(F.min("place").alias("first"), F.count("*").alias("n"))
    known = written(known.join(late, "first", "left").where("n > 1 OR near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near")), "known")
    hits = lines.select("doc_id", "_row", "i", "place", F.unhex(F.md5("line")).alias("h")).join(maybe_broadcast(known, known.count()), "h", "left")
    verdicts = hits.select("doc_id", "_row", "i", F.expr("coalesce(place > first, false)").alias("exact"), F.expr("coalesce(place = first AND near, false)").alias("near"),
                           F.expr("coalesce(place > first OR near, false)").alias("gone"))
    per_doc = verdicts.groupBy("_row").agg(F.count_if("exact").alias("n_exact"), F.count_if("near").alias("n_near"), F.sort_array(F.collect_list(F.expr("IF(gone, i, NULL)"))).alias("removed_lines"))
    zero = F.lit(0).cast("long")
    return (docs.select("doc_id", "_row", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n"), F.col("text").isNull().alias("none")).join(per_doc, "_row", "left")
            .select("doc_id", "_row", F.when(F.col("none"), zero).otherwise(F.col("n")).alias("n_lines"), F.coalesce("n_exact", zero).alias("n_exact"), F.coalesce("n_near", zero).alias("n_near"),
                    F.coalesce("removed_lines", F.array().cast("array<int>")).alias("removed_lines"))
            .withColumn("n_kept", F.expr("n_lines - size(removed_lines)")))


def without_repeats(df: DataFrame, tau: int = 2, min_chars: int = 40, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """`df` with its texts less the lines that `mark_lines` removes; rows of which no line with a word is left go, and rows
    that had none to begin with stay, as do null texts. Columns are those of `df`, whatever their names; nulls in other columns and
    repeated rows are kept as they are, an empty table gives an empty table. One more shuffle joins the removed lines of those rows that have any."""
    row, gone = free_name(df, "row"), free_name(df, "gone")
    marks = mark_lines(df, tau, min_chars, doc_id, text).where("size(removed_lines) > 0")
    marks = written(marks.select(F.col("_row").alias(row), F.col("removed_lines").alias(gone)), "removed")
    out = df.withColumn(row, F.monotonically_increasing_id()).join(marks, row, "left")
    left = F.expr(f"array_join(filter(split(`{text}`, '\n'), (l, i) -> NOT array_contains({gone}, i)), '\n')")
    return (out.withColumn(text, F.when(F.col(gone).isNull(), F.col(text)).otherwise(left))
            .where(F.col(gone).isNull() | F.col(text).rlike(WORDED)).select(*df.columns))


#: The same in DuckDB's SQL, for the parameters of the registered query.
ORACLE_SQL = r"""
WITH lines AS (
    SELECT doc_id, i - 1 AS i, l FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS l, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)
    WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
firsts AS (SELECT l, min((doc_id, i)) AS first, length(l) AS n FROM lines GROUP BY l),
fuzzy AS (SELECT * FROM firsts WHERE n >= 40),
parts AS (
    SELECT *, k, substr(l, CAST(k * (n // 3) + greatest(0, k - 3 + n % 3) + 1 AS BIGINT), CAST(n // 3 + CAST(k >= 3 - n % 3 AS INT) AS BIGINT)) AS part,
        k * (n // 3) + greatest(0, k - 3 + n % 3) AS at
    FROM fuzzy, (SELECT unnest([0, 1, 2]) AS k)),
windows AS (
    SELECT l, first, n, n - d AS m, k, s, substr(l, CAST(k * ((n - d) // 3) + greatest(0, k - 3 + (n - d) % 3) + s + 1 AS BIGINT),
        CAST((n - d) // 3 + CAST(k >= 3 - (n - d) % 3 AS INT) AS BIGINT)) AS part
    FROM fuzzy, (SELECT unnest([0, 1, 2]) AS d), (SELECT unnest([0, 1, 2]) AS k), (SELECT unnest([-2, -1, 0, 1, 2]) AS s)
    WHERE k * ((n - d) // 3) + greatest(0, k - 3 + (n - d) % 3) + s >= 0),
pairs AS (
    SELECT DISTINCT a.l AS x, b.l AS y, a.first AS fx, b.first AS fy FROM parts a JOIN windows b ON a.n = b.m AND a.k = b.k AND a.part = b.part WHERE a.l <> b.l),
late AS (SELECT DISTINCT CASE WHEN fx < fy THEN y ELSE x END AS l FROM pairs WHERE levenshtein(x, y) <= 2),
marked AS (
    SELECT doc_id, i, (doc_id, i) > first AS exact, (doc_id, i) = first AND late.l IS NOT NULL AS near
    FROM lines JOIN firsts USING (l) LEFT JOIN late USING (l)),
by_doc AS (
    SELECT doc_id, count_if(exact) AS n_exact, count_if(near) AS n_near, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) FILTER (exact OR near) AS gone
    FROM marked GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(string_split(text, chr(10))), 0) AS BIGINT) AS n_lines, CAST(coalesce(n_exact, 0) AS BIGINT) AS n_exact,
    CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, CAST(coalesce(len(string_split(text, chr(10))), 0) - coalesce(n_exact, 0) - coalesce(n_near, 0) AS BIGINT) AS n_kept,
    coalesce(gone, '') AS removed_lines
FROM documents d LEFT JOIN by_doc b ON d.doc_id = b.doc_id
"""
