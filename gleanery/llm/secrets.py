"""Secret scans, in DataFrame operations only.

A pattern finds candidates: runs of key-like characters that hold a digit or follow an equals sign, and, where it is
WHOLE, values of any characters after a keyword, known prefixes, runs of mixed case and long runs of letters. A random
forest, trained on labelled findings, removes the false ones by the candidate's length, its transitions between
classes of characters, how much of it are dictionary words, its path and the neighbouring words.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.llm.common import maybe_broadcast, written

#: The candidate pattern, words that are words in any corpus, and what neighbours tell.
CANDIDATE = r"""(?<![A-Za-z0-9_+/-])(?=[A-Za-z_+/-]*[0-9])[A-Za-z0-9_+/-]{8,}={0,2}|(?<==["']?)[A-Za-z0-9_+/-]{8,}"""
#: WHOLE finds all that CANDIDATE does, at the same place or inside a longer value, and what needs no digit: the value after a keyword
#: (behind the cheap test that a colon or an equals sign is near), known prefixes, mixed case, and 16 characters or more.
WHOLE = (r"""(?<=[:=]>?\s{0,2}["']?)(?<=(?i:pass|passwd|password|passphrase|pwd|secret|token|key|auth|credentials?|bearer)["']?\s{0,2}[:=]{1,2}>?\s{0,2}["']?)[^\s"']*[^\s"'.,;:)\]}>]"""
         r"""|(?<![A-Za-z0-9_+/-])(?:(?:AKIA|ASIA|gh[opsru]_|xox|sk_|pk_|AIza|eyJ)[A-Za-z0-9_+/-]{4,}={0,2}"""
         r"""|(?=[A-Za-z_+/-]*(?:[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z])|[A-Za-z_+/-]{16})[A-Za-z0-9_+/-]{8,}={0,2})|(?<==["']?)[A-Za-z0-9_+/-]{8,}""")
WORDS = ("account address annual build card change chapter client code config data date default demo document draft dummy edition example figure file final first "
         "here image index item letter list local main manual model month name notes number order page paper part password path phone photo place placeholder "
         "price print product project public report review room sample secret section series service short site start state station street string table test text "
         "this time title token total unit user value version volume week welcome work year your").split()
FEATURES = {
    "f_length": "length(c)",
    "f_digits": "regexp_count(c, '[0-9]') / length(c)",
    "f_upper": "regexp_count(c, '[A-Z]') / length(c)",
    "f_lower": "regexp_count(c, '[a-z]') / length(c)",
    "f_to_letter": "regexp_count(c, '[0-9][A-Za-z]') / length(c)",
    "f_to_digit": "regexp_count(c, '[A-Za-z][0-9]') / length(c)",
    "f_to_upper": "regexp_count(c, '[a-z][A-Z]') / length(c)",
    "f_joints": "regexp_count(c, '[_+/-]') / length(c)",
    "f_doubles": "regexp_count(c, '(.)\\\\1') / length(c)",
    "f_distinct": "size(array_distinct(split(c, ''))) / length(c)",
    "f_vowels": "regexp_count(lower(c), '[aeiou]') / length(c)",
    "f_clusters": "regexp_count(lower(c), '[bcdfghjklmnpqrstvwxz]{4,}')",
    "f_hex": "CAST(c RLIKE '^[0-9a-f]+$' AS INT)",
    "f_number": "CAST(c RLIKE '^[0-9_+/-]+$' AS INT)",
    "f_prefix": "CAST(c RLIKE '^(AKIA|ASIA|ghp_|gho_|xox|sk_|pk_|AIza|eyJ)' AS INT)",
    "f_words": "covered / length(c)",
    "f_path": "CAST(coalesce(path, '') RLIKE '(?i)(test|example|sample|fixture|mock|docs?/)' AS INT)",
    "f_assigned": "CAST(before RLIKE '[:=]\\\\s*[\"'']?$' AS INT)",
    "f_quoted": "CAST(before RLIKE '[\"'']$' AND after RLIKE '^[\"'']' AS INT)",
    "f_password": "CAST(before RLIKE '(?i)(pass(word|wd|phrase)?|pwd)[\"'']?\\\\s*[:=]?\\\\s*[\"'']?$' AS INT)",
    "f_key": "CAST(before RLIKE '(?i)(token|secret|key|auth|credentials?|bearer)[\"'']?\\\\s*[:=]?\\\\s*[\"'']?$' AS INT)",
    "f_harmless": "CAST(before RLIKE '(?i)(commit|revision|sha|md5|sha1|sha256|checksum|digest|etag|uuid|build|version|order|invoice|phone|tel|card|account|isbn|page|figure)[^A-Za-z0-9]*$' AS INT)",
    "f_sample": "CAST(after RLIKE '(?i)^[^A-Za-z0-9]*(example|sample|placeholder|dummy)' AS INT)",
}


def findings(df: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", pattern: str = CANDIDATE) -> DataFrame:
    """The candidates of every text: doc_id, path, start (code points before it), c, before (64 code points), after (32)."""
    found = (df.select(F.col(doc_id).alias("doc_id"), (F.col(path).cast("string") if path else F.lit(None).cast("string")).alias("path"), F.monotonically_increasing_id().alias("_row"), F.col(text).alias("text"))
             .where(F.col("text").rlike("[0-9=]") if pattern == CANDIDATE else F.col("text").isNotNull())
             .withColumn("cs", F.regexp_extract_all("text", F.lit(pattern), 0)).where("size(cs) > 0")
             .withColumn("parts", F.split("text", pattern)))
    rows = found.select("doc_id", "path", "_row", F.posexplode(F.arrays_zip(F.col("cs").alias("c"), F.col("parts").alias("p"), F.expr("slice(parts, 2, size(parts))").alias("q"), F.expr("concat(array(''), cs)").alias("o"))).alias("k", "z"))
    # a keyword may be a candidate of its own, so what stands before reaches back into the last one
    rows = rows.select("doc_id", "path", "_row", "k", F.col("z.c").alias("c"), F.expr("right(concat(z.o, z.p), 64)").alias("before"), F.expr("left(z.q, 32)").alias("after"), F.length("z.p").cast("long").alias("n")).where("c IS NOT NULL")
    return rows.withColumn("start", F.expr("sum(n + length(c)) OVER (PARTITION BY _row ORDER BY k) - length(c)")).select("doc_id", "path", "start", "c", "before", "after")


def corpus_words(df: DataFrame, wanted: DataFrame, share: float, text: str = "text", pattern: str = CANDIDATE) -> DataFrame:
    """Of the words `wanted` (word), those outside the candidates of a `share` of the different texts of `df` or more, and of two at least."""
    texts = df.where(F.col(text).isNotNull()).select(F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    least = max(2, math.ceil(share * texts.select("h").distinct().count()))
    words = texts.select("h", F.explode(F.array_distinct(F.split(F.lower(F.regexp_replace("text", pattern, " ")), "[^a-z]+"))).alias("word"))
    wanted = written(wanted.distinct(), "wanted")
    n = wanted.count()
    if n <= 500_000:
        words = words.join(F.broadcast(wanted), "word", "left_semi")
    counted = words.distinct().groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("word")
    return counted if n <= 500_000 else counted.join(wanted, "word", "left_semi")


def with_features(rows: DataFrame, words: DataFrame) -> DataFrame:
    """`rows` (c, before, after, path and more) with FEATURES; words: the dictionary (word)."""
    runs = rows.select("c").distinct().select("c", F.explode(F.expr("regexp_extract_all(lower(c), '[a-z]{4,}', 0)")).alias("word"))
    covered = written(runs.join(words.withColumn("known", F.lit(True)), "word").groupBy("c").agg(F.sum(F.length("word")).alias("covered")), "covered")
    out = rows.join(maybe_broadcast(covered, covered.count()), "c", "left").withColumn("covered", F.coalesce("covered", F.lit(0)))
    return out.select(*rows.columns, *[F.expr(f"CAST({sql} AS DOUBLE)").alias(name) for name, sql in FEATURES.items()])


def labelled_findings(spark: SparkSession, n: int = 6000) -> DataFrame:
    """A labelled set of `n` findings, the same at every call: keys, passwords and tokens drawn at random against numbers, digests of
    commits, placeholders, file names and identifiers made of words. label is 1 for a secret."""
    spark.range(0, n, 1, 4).createOrReplaceTempView("_secret_ids")
    pick = lambda k: f"element_at(split('{' '.join(WORDS)}', ' '), CAST(1 + conv(substr(h, {k}, 6), 16, 10) % {len(WORDS)} AS INT))"
    cut = lambda k, lo, span: f"CAST({lo} + conv(substr(h, {k}, 4), 16, 10) % {span} AS INT)"
    digits, letters = "translate(h, 'abcdef', '047258')", "translate(h, '0123456789', 'ghjkmnpqrt')"
    near = f"concat({pick(3)}, ' ', {pick(9)}, ' ')"
    cases = [  # candidate, before, after, label
        (f"concat('AKIA', upper(substr(translate(g, '0123456789', 'QZ2RT7WXYK'), 1, 16)))", near, "' '", 1),
        (f"substr(g, 1, {cut(1, 12, 20)})", f"concat({near}, 'password=')", "' '", 1),
        ("substr(sha2(h, 256), 1, 40)", f"concat({near}, 'token = \"')", "'\" '", 1),
        (f"substr(concat({letters}, upper(g)), 9, {cut(1, 20, 24)})", f"concat({near}, 'api_key: ')", "' '", 1),
        (f"substr(concat(upper({letters}), g, {letters}), 21, {cut(1, 24, 20)})", f"concat({near}, 'secret=\"')", "'\"'", 1),
        ("concat('ghp_', substr(concat(g, h), 5, 36))", near, "' '", 1),
        (f"substr({digits}, 1, 16)", near, "' '", 0),
        (f"concat(substr({digits}, 1, 3), '-', substr({digits}, 4, 4))", f"concat({near}, '(555) ')", "' '", 0),
        (f"substr({digits}, 1, {cut(1, 8, 12)})", f"concat({near}, 'order ')", "' '", 0),
        ("substr(sha2(h, 256), 1, 40)", f"concat({near}, 'commit ')", "' '", 0),
        ("g", f"concat({near}, 'md5: ')", "' '", 0),
        (f"concat({pick(3)}, '_', {pick(9)}, '_', {cut(1, 1, 2100)})", near, "'.'", 0),
        (f"concat({pick(3)}, {pick(9)}, '123')", f"concat({near}, 'password=')", "' example '", 0),
        (f"concat('your_', {pick(3)}, '_token_here')", f"concat({near}, 'token = \"')", "'\" '", 0),
        (f"concat({pick(3)}, '-', {pick(9)}, '-', {cut(1, 1, 99)})", f"concat({near}, 'page ')", "' '", 0),
        (f"concat(2000 + CAST(id % 30 AS INT), '-', lpad({cut(1, 1, 12)}, 2, '0'), '-', lpad({cut(5, 1, 28)}, 2, '0'))", near, "' '", 0),
    ]
    case = lambda i: "CASE id % 16 " + " ".join(f"WHEN {k} THEN {c[i]}" for k, c in enumerate(cases)) + " END"
    return spark.sql(f"""
        SELECT {case(0)} AS c, {case(1)} AS before, {case(2)} AS after, IF(id % 7 = 0 AND id % 16 > 5, 'tests/sample', 'src') AS path, CAST({case(3)} AS DOUBLE) AS label
        FROM (SELECT id, md5(concat('h', id)) AS h, md5(concat('g', id)) AS g FROM _secret_ids)""")


def labelled_letters(spark: SparkSession, n: int = 4000) -> DataFrame:
    """As `labelled_findings`, for what only WHOLE finds: keys of letters, passphrases and passwords with marks against prose, words after
    a keyword, names in mixed case, paths and joined words."""
    spark.range(0, n, 1, 4).createOrReplaceTempView("_letter_ids")
    pick = lambda k: f"element_at(split('{' '.join(WORDS)}', ' '), CAST(1 + conv(substr(h, {k}, 6), 16, 10) % {len(WORDS)} AS INT))"
    cut = lambda k, lo, span: f"CAST({lo} + conv(substr(h, {k}, 4), 16, 10) % {span} AS INT)"
    near = f"concat({pick(3)}, ' ', {pick(9)}, ' ')"
    upper, mixed = "upper(translate(g, '0123456789', 'QZGRTHWXYK'))", "concat(translate(g, '0123456789abcdef', 'qWeRtYuIoPaSdFgH'), translate(h, '0123456789abcdef', 'kLzXcVbNmJhGfDsA'))"
    keyword = f"element_at(array('password: ', 'password=', 'token = \"', 'secret: ', 'api_key: ', 'passwd = '), {cut(17, 1, 6)})"
    mark = f"element_at(array('!', '#', '@', '$', '%', '*'), {cut(21, 1, 6)})"
    camel = f"concat({pick(3)}, initcap({pick(9)}), initcap({pick(15)}))"
    cases = [  # candidate, before, after, label
        (f"concat('AKIA', substr({upper}, 1, 16))", near, "' '", 1),
        (f"substr({mixed}, {cut(1, 1, 20)}, {cut(5, 14, 24)})", f"concat({near}, {keyword})", "' '", 1),
        (f"lower(substr({mixed}, {cut(1, 1, 20)}, {cut(5, 14, 24)}))", f"concat({near}, {keyword})", "' '", 1),
        (f"concat({pick(3)}, {pick(9)}, {pick(15)})", f"concat({near}, 'password: ')", "' '", 1),
        (f"concat({pick(3)}, {mark}, {cut(1, 1, 99)})", f"concat({near}, 'password=')", "' '", 1),
        (f"substr({mixed}, {cut(1, 1, 20)}, {cut(5, 16, 24)})", near, "' '", 1),
        (pick(3), f"concat({near}, {keyword})", f"concat(' ', {pick(9)})", 0),
        (camel, near, "' '", 0),
        (camel, f"concat({near}, 'class ')", "'('", 0),
        (f"concat({pick(3)}, '/', {pick(9)}, '/', {pick(15)})", near, "'.'", 0),
        (f"concat({pick(3)}, '-', {pick(9)}, '-', {pick(15)})", near, "' '", 0),
        (f"concat({pick(3)}, {pick(9)}, {pick(15)})", near, "', '", 0),
    ]
    case = lambda i: f"CASE id % {len(cases)} " + " ".join(f"WHEN {k} THEN {c[i]}" for k, c in enumerate(cases)) + " END"
    return spark.sql(f"""
        SELECT {case(0)} AS c, {case(1)} AS before, {case(2)} AS after, 'src' AS path, CAST({case(3)} AS DOUBLE) AS label
        FROM (SELECT id, md5(concat('l', id)) AS h, md5(concat('k', id)) AS g FROM _letter_ids)""")


def train(labelled: DataFrame, words: DataFrame, trees: int = 40, depth: int = 8) -> RandomForestClassificationModel:
    """A forest on labelled findings (c, before, after, path, label)."""
    data = VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(with_features(labelled, words))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=11, featureSubsetStrategy="sqrt").fit(data.select("features", "label"))


def scan(df: DataFrame, labelled: DataFrame | None = None, threshold: float = 0.5, share: float = 0.002, doc_id: str = "doc_id", text: str = "text", path: str | None = "source", pattern: str = CANDIDATE) -> DataFrame:
    """The candidates of all texts: doc_id, start, c, score (double, of being a secret) and kept (score >= `threshold`).

    Every candidate of `pattern` is returned; with WHOLE, the default training set has findings without digits too. The dictionary is WORDS and the runs of four letters or more of candidates that are whole
    words outside the candidates of a `share` of the different texts, so copies of a secret do not make words of it. Null and empty texts have no candidates; texts are taken whole; equal rows have equal
    findings; a null path is none; other columns are not used; an empty table gives an empty table.
    """
    spark = df.sparkSession
    if labelled is None:
        labelled = labelled_findings(spark) if pattern == CANDIDATE else labelled_findings(spark).unionByName(labelled_letters(spark))
    rows = written(findings(df, doc_id, text, path, pattern), "findings")
    runs = rows.select("c").unionByName(labelled.select("c")).select(F.explode(F.expr("regexp_extract_all(lower(c), '[a-z]{4,}', 0)")).alias("word"))
    words = written(corpus_words(df, runs, share, text, pattern).unionByName(spark.createDataFrame([(w,) for w in WORDS], "word string")).distinct(), "dictionary")
    model = train(labelled, words)
    out = model.transform(VectorAssembler(inputCols=[*FEATURES], outputCol="features").transform(with_features(rows, words)))
    return out.withColumn("score", vector_to_array("probability")[1]).select("doc_id", "start", "c", "score", (F.col("score") >= threshold).alias("kept"))
