import random

from gleanery.llm.line_dedup import mark_lines, near_links, within, without_repeats


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(r, s, n):
    s = list(s)
    for _ in range(n):
        k, at = r.randrange(3), r.randrange(len(s))
        if k == 0:
            s[at] = r.choice("abcdé")
        elif k == 1:
            s.insert(at, r.choice("abcdé"))
        elif len(s) > 1:
            del s[at]
    return "".join(s)


def test_banded_distance_as_the_whole_table(spark):
    r, pairs = random.Random(3), []
    for _ in range(300):
        a = "".join(r.choice("abcdé") for _ in range(r.randrange(6, 30)))
        b = edited(r, a, r.randrange(5))
        pairs.append((a, b) if len(a) >= len(b) else (b, a))
    df = spark.createDataFrame(pairs, "a string, b string").selectExpr("a", "b", "split(a, '') AS x", "split(b, '') AS y")
    for tau in (1, 2, 3):
        for row in df.where("b <> ''").selectExpr("a", "b", f"{within('x', 'y', tau)} AS d").collect():
            want = distance(row["a"], row["b"])
            assert min(row["d"], tau + 1) == min(want, tau + 1), row


def test_links_by_brute_force(spark):
    r = random.Random(4)
    base = ["".join(r.choice("abcd ") for _ in range(r.randrange(20, 40))) for _ in range(25)]
    lines = sorted({edited(r, b, r.randrange(5)) for b in base for _ in range(8)} | {"same start of a template, number " + str(i) for i in range(60)})
    df = spark.createDataFrame([(i, s) for i, s in enumerate(lines)], "place long, line string")
    for tau, crowd in ((2, 1000), (2, 24), (1, 24)):
        want = {(j, i) for i, a in enumerate(lines) for j in range(i) if len(a) >= 16 and len(lines[j]) >= 16 and distance(a, lines[j]) <= tau}
        got = {tuple(x) for x in near_links(df, tau, 16, crowd, 1).collect()}
        assert got == want, (tau, crowd, len(got), len(want))


def test_edge_rows_and_texts(spark):
    long = "This is a line of some length, number one of two."
    rows = [(1, None, 0), (2, "", 0), (3, f"{long}\n\nshort\n{long}", 0), (3, f"{long}", 0), (4, long.replace("one", "own") + "\nother words here", 0), (5, "z" * 100_000, 0), (None, "short", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int").coalesce(1)
    got = sorted((tuple(r) for r in mark_lines(df).select("doc_id", "_row", "n_lines", "n_exact", "n_near", "n_kept").collect()), key=lambda r: r[1])
    assert [(r[0], *r[2:]) for r in got] == [(1, 0, 0, 0, 0), (2, 1, 0, 0, 1), (3, 4, 2, 0, 2), (3, 1, 1, 0, 0), (4, 2, 0, 1, 1), (5, 1, 0, 0, 1), (None, 1, 0, 0, 1)]
    left = {(r["doc_id"], r["text"]) for r in without_repeats(df).collect()}
    assert left == {(1, None), (2, ""), (3, f"{long}\n"), (4, "other words here"), (5, "z" * 100_000), (None, "short")}
    assert mark_lines(df.limit(0)).count() == 0
