from datetime import date

import pytest
from pyspark.sql import functions as F

from gleanery.functions import dates, facts, labels, money, record
from gleanery.functions.pages import clean_text

DAY = "2026-06-01"


def over(spark, f, texts):
    """f of each text, in order."""
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r["x"] for r in sorted(df.select("i", f(F.col("t")).alias("x")).collect(), key=lambda r: r["i"])]


DEADLINES = [
    ("Deadline: 2026-11-30", date(2026, 11, 30), False), ("Apply by March 5th, 2027", date(2027, 3, 5), False), ("deadline is 15 Jan 2027 (annual)", date(2027, 1, 15), False),
    ("Deadline 03/04/2027", date(2027, 4, 3), False), ("closing date: February 2027", date(2027, 2, 28), True), ("Deadline: 15 July", date(2026, 7, 15), True),
    ("Deadline: 15 January", date(2027, 1, 15), True), ("Deadline: 2027-02-31", None, None), ("rolling basis", None, None), (None, None, None), ("", None, None),
    ("until 18-Sep-26 or so", date(2026, 9, 18), False), ("Deadline: see below\n\nIt is on 1 Oct 2026", date(2026, 10, 1), False), ("x " * 40_000 + "deadline 2 May 2027", date(2027, 5, 2), False),
]


def test_deadlines(spark):
    got = over(spark, lambda t: dates.deadline(t, DAY), [t for t, _, _ in DEADLINES])
    assert [(r["deadline"], r["estimated"]) for r in got] == [(d, g) for _, d, g in DEADLINES]
    assert got[2]["round_label"] == "Annual" and got[8]["rolling"] and got[9]["rolling"] is False


def test_dates_to_come_stand_before_past_ones_and_exact_before_guesses(spark):
    (found,) = over(spark, lambda t: dates.dates(t, DAY), ["Past: 2026-01-10. Next: 2026-09-01 and 2027-09-01. Maybe May 2027. In September 2026."])
    assert [r["day"] for r in found] == [date(2026, 9, 1), date(2027, 9, 1), date(2026, 1, 10), date(2027, 5, 31)]


AMOUNTS = [
    ("€934 per month", 934 * 1.09 * 10), ("US$10,000 per year", 10_000), ("£5,000 a semester", 5000 * 1.27 * 2), ("a monthly stipend of €1.200", 1200 * 1.09 * 10), ("USD 1,200.50", 1200.5),
    ("€1,000 - €1,500 per month", 1500 * 1.09 * 10), ("R$ 2.000 per month", 2000 * 0.18 * 10), ("INR 5,00,000 per annum", 500_000 * 0.012), ("€1000 per month for 24 months", 1000 * 1.09 * 24), ("£20k", 20_000 * 1.27),
    ("994 eur per month", 994 * 1.09 * 10), ("$994/month", 9940), ("EUR 994 p.m.", 994 * 1.09 * 10), ("994 EUR a month", 994 * 1.09 * 10), ("€500 per annum", 545), ("a yearly award of $12,000", 12_000),
    ("¥143,000–148,000 per month", 148_000 * 0.0066 * 10), ("€800/month + €200 for books", 800 * 1.09 * 10), ("US$50,000. Rent: $12,000 per year", 50_000), ("fees of $12,000 plus $2,000/year to live on", 12_000),
    ("fees worth $18,000 plus an allowance of $2,000/month", 20_000), ("fees worth $18,000 per year plus an allowance", 18_000), ("$500 monthly plus $20000", 20_000), ("HK$ 9,000 pa", 1170), ("NZ$100 daily", 60),
    ("SG$25 per hour", 18.5), ("two grants of €300 for six months", 327), ("monthly: 994 EUR for twelve months", 994 * 1.09 * 12), ("$50,000 plus a monthly allowance", 50_000), ("$5", None), ("", None), (None, None),
]


def test_largest_amounts(spark):
    got = [max((a["usd"] for a in r), default=None) for r in over(spark, money.amounts, [t for t, _ in AMOUNTS])]
    assert [(t, g) for (t, w), g in zip(AMOUNTS, got) if g != (w if w is None else pytest.approx(w))] == []


def test_units_are_not_stolen(spark):
    got = over(spark, money.amounts, ["a fee of US$75 and €900 per month", "€992 per month and more"])
    assert [(a["number"], a["unit"]) for a in got[0]] == [(75, None), (900, "month")] and got[1][0]["text"] == "€992 per month"


def test_symbols_have_rates():
    assert set(facts.SYMBOLS.values()) <= set(facts.FX)


def test_labels_and_clean_text(spark):
    page = "<html><script>x</script><h3>Deadline:</h3><p>1 May 2027</p><div>Study in: Norway</div><div>Level:</div><div>Master</div><div>PhD</div><p>Share this</p><p>a &amp; b</p><p>a &amp; b</p></html>"
    text, none = [r[0] for r in spark.createDataFrame([(1, page), (2, None)], "i int, page string").orderBy("i").select(clean_text(F.col("page"))).collect()]
    assert "Share" not in text and text.count("a & b") == 1
    got, nothing, empty, joined = over(spark, labels.label_values, [text, None, "", "Deadline: 6 Oct 2026\nDeadline for applications of all kinds:\n1 May 2027\nOfficial website: x\nno value\nAmount: 5\nnone"])
    assert got["deadline"] == "1 May 2027" and got["country"] == "Norway" and got["level"].startswith("Master PhD")
    assert nothing == {} == empty and none == "" and joined == {"deadline": "6 Oct 2026 1 May 2027", "value": "5"}


def test_precedence_of_a_record(spark):
    text = "Study in: Norway\nDeadline: 1 May 2027\nBenefits: €900 per month\nA bachelor in Peru. TOEFL 90. The application fee is $20."
    df = spark.createDataFrame([(1, "Award", text, (date(2027, 1, 1), None)), (2, "Award of Chad", text, (None, "Kenya")), (3, None, None, None)], "id long, title string, text string, pre struct<deadline: date, country: string>")
    got = {r["id"]: r for r in record.extracted(df, DAY, pre="pre").collect()}
    one, two, none = (got[i]["record"] for i in (1, 2, 3))
    assert (one["deadline"], one["country"], one["amount_usd"], one["degree_level"], one["min_toefl"], one["application_fee_usd"]) == (date(2027, 1, 1), "Norway", 9810.0, "Bachelor", 90, 20.0)
    assert (two["deadline"], two["country"]) == (date(2027, 5, 1), "Kenya") and none["deadline"] is None and none["eligible_countries"] == [] and round(got[1]["completeness"], 2) == 0.83
    assert len(one) >= 33


def test_clean_text_by_brute_force(spark):
    """Pages of few different lines, so that most repeat: a line goes if it is among the last three kept."""
    import random

    r = random.Random(1)
    for _ in range(5):
        lines = [r.choice(["aa", "bb", "cc", "dd", "ee", "x", "Share this", "shared view"]) for _ in range(40)]
        said = [x for x in lines if len(x) > 1 and x != "Share this"]
        want: list[str] = []
        for x in said:
            if x not in want[-3:]:
                want.append(x)
        page = "<body>" + "".join(f"<p>{x}</p>" for x in lines) + "</body>"
        assert spark.createDataFrame([(page,)], "page string").select(clean_text(F.col("page"))).first()[0] == "\n".join(want)


def test_chunks_by_brute_force(spark):
    import random

    from gleanery.sources.writers import chunked

    r = random.Random(2)
    for size, most in ((10, 4), (25, 99), (3500, 4)):
        texts = ["\n".join("x" * r.randrange(14) for _ in range(r.randrange(1, 12))) for _ in range(40)] + [""]
        for t in texts:
            want: list[str] = []
            for line in t.split("\n"):
                if want and len(want[-1]) + 1 + len(line) <= size:
                    want[-1] += "\n" + line
                else:
                    want.append(line)
            t_want = want[:most]
            texts[texts.index(t)] = (t, t_want)
        for row in spark.createDataFrame(texts, "t string, want array<string>").select(chunked(F.col("t"), size, most).alias("got"), "want").collect():
            assert row["got"] == row["want"]


def test_typed_labels_are_dealt_out(spark):
    """One input file is not one task: each of the session's partitions has rows."""
    from gleanery.plans.queries import QUERIES

    rows = QUERIES["labels_typed"](spark, "/root/testdata/sf0.001")
    assert rows.select(F.spark_partition_id().alias("p")).distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_labels_at_the_edges_of_lines(spark):
    lines = ["  Study in :  Norway  \r\n\n \t Level -  PhD \r\nSubject: law\rlatin\nHOST  COUNTRY: Peru\n" + "Amount: " + "9" * 112 + "\nBenefits: " + "9" * 111, "Value:\r\n\r\n a \n b\tc  d\r", "what the scholarship: x\nWho: y\nlevel of it: z",
             "Deadline: 5 May\n1999 or so\nClosing date: 1 May 1999\n2000", ":\nA: 1\n\u0001Level: 2\nlevel: \u2028"]
    got = over(spark, labels.label_values, lines)
    assert got == [{"country": "Norway Peru", "level": "PhD", "value": "9" * 112}, {"value": "a b c d"}, {"value": "x", "level": "z"}, {"deadline": "5 May 1999 or so 1 May 1999 2000"}, {}], got


def test_a_record_takes_one_pass_and_no_field_that_is_not_selected(spark):
    """The input is read once, countries are met within the row, and steps of fields that a query leaves out are not in its plan."""
    from gleanery.plans.queries import QUERIES

    plan = QUERIES["extract_all"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [o_orderkey") == 1 and "Generate" not in plan and "collect_list" not in plan
    assert all(f" AS {step}#" not in plan for step in ("_fields", "_covered", "_funding", "_s_benefits", "record"))


def test_what_the_text_says_counts_where_neither_label_nor_reader_does(spark):
    rows = [("Deadline: soon\nWe close on 3 May 2027, apply by 2 May 2027. €100 per month, study in Peru, a PhD.", None), ("Benefits: none\nLevel: x\nStudy in: ?\nValue of 20 USD per week for a bachelor of Kenya", "$5,000"), ("Deadline: 1 June 2027\nAward: $900\nCountry: Chad\nLevel: PhD\nThe last date is 1 May 2027, €9,000, study in Peru, for a master", "none")]
    df = spark.createDataFrame([(i, "Award", t, (a,)) for i, (t, a) in enumerate(rows)], "id long, title string, text string, pre struct<amount_text: string>")
    got = [r["record"] for r in sorted(record.extracted(df, DAY, pre="pre").collect(), key=lambda r: r["id"])]
    assert [(r["deadline"], r["amount_usd"], r["country"], r["degree_level"]) for r in got] == [
        (date(2027, 5, 2), 1090.0, "Peru", "PhD"), (None, 5000.0, None, "Bachelor"), (date(2027, 6, 1), 900.0, "Chad", "PhD")], got
