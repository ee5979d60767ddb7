from gleanery.llm.quality import assess, clean_lines

PROSE = "The old mill stood by the river, and nobody had worked in it for years."


def test_line_rules():
    good = "\n".join(" ".join(f"Word{i}x{j}" for j in range(12)) + "." for i in range(6))
    assert assess(good, 0.5)[6]
    for bad in ("a1 | b2 | c3 | d4 | e5 | f6 " * 9, " ".join(f"W{i}!!" for i in range(60)), " ".join(f"w{i}***" for i in range(60)), " ".join(f"w{i}" for i in range(70))):
        assert not assess(bad, 0.5)[6], bad
    text, lost = assess(good + "\nAll rights reserved.\nHome\n", 0.5)[9], assess(good + "\nHome", 0.5)[8]
    assert "rights" not in text and "Home" not in text and lost == 4


def test_repeats_by_brute_force():
    words = "a b c d a b c e a b c d x".split()
    wins = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {p for i, w in enumerate(wins) if wins.count(w) > 1 for p in (i, i + 1, i + 2)}
    assert assess(" ".join(words), 0.5)[4] == len(covered)


def test_edge_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "word " * 60_000, 1), (4, PROSE, 1), (4, PROSE, 1), (None, "\n\n", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = clean_lines(df).collect()
    assert len(got) == 6 and all(r["kept"] in (True, False) and r["clean_text"] is not None for r in got)
    assert clean_lines(df.limit(0)).count() == 0
