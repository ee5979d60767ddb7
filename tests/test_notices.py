import pytest
from pyspark.sql import functions as F

from gleanery.config import overridden
from gleanery.functions import notices
from gleanery.sources import writers


def one(spark, expr, *values, kind="string"):
    df = spark.createDataFrame([(v,) for v in values], f"t {kind}")
    return [r[0] for r in df.select(expr(F.col("t"))).collect()]


def test_fees(spark):
    got = one(spark, notices.application_fee, "Application fee of £20.", "$1,200 application fee", "application fee EUR 10", "Application fee: 0", "none", "", None)
    assert got == [25.4, 1200.0, 10.0, None, None, None, None]


def test_sections(spark):
    text = "Title\nELIGIBILITY\nHow To\nfirst\n\nsecond\nHow To Apply:\nrest"
    got = one(spark, lambda t: notices.section(t, ("eligibility",)), text, "Eligibility", "eligibility for all\n" + "x" * 2000, "none", "", None)
    assert got == ["How To first second", None, "x" * 900, None, None, None]


def test_answers(spark):
    got = one(spark, notices.answer_json, '```json\n{"a": [1]}\n```', 'so: {"a": 1} or', '[1, 2]', '{"a": 1} {"b": 2}', "{", "", None)
    assert got == ['{"a": [1]}', '{"a": 1}', "[1, 2]", None, None, None, None]
    assert one(spark, notices.answer_field, " Not specified ", "-", " x ", "", None) == [None, None, "x", "", None]


def test_amounts_as_shown(spark):
    df = spark.createDataFrame([("992 eur per month", 10812.8), ("US$ 5,000", 5100.0), ("about 1.2.3", 9.0), ("", 5.0), (None, None), ("free", None), ("free", 0.0)], "s string, u double")
    got = [r[0] for r in df.select(notices.money_line(F.col("s"), F.col("u"))).collect()]
    assert got == ["992 eur per month  ·  ≈ US$10,813/yr", "US$ 5,000", "about 1.2.3  ·  ≈ US$9/yr", "amount not stated", "amount not stated", "free", "free"]


def test_levels_and_links(spark):
    assert one(spark, notices.label_levels, "MSc or any", "any level", "B.A.", "staff", "", None) == ["Master", "Any", "Bachelor", None, None, None]
    token = "123456:" + "a" * 34
    assert one(spark, notices.bot_token, token, f"https://x.org/bot{token}/send", f"https://t.me/bot{token}", "12:ab", "", None) == [token, token, None, None, None, None]
    assert one(spark, notices.token_shown, token, "abc", "", None) == ["123456:aa…aa", "abc:?…?", "", None]
    assert one(spark, notices.chat_id, "t.me/-1001234", "https://telegram.me/c/55555/2", " 77 ", "t.me/name", "", None) == ["-1001234", "55555", "77", None, None, None]


def test_gating_lists(spark):
    got = one(spark, notices.gating_countries, ["Kenya", "peru"], ["all countries"], ["United States of America", "america", "u.s.a."], [], None, kind="array<string>")
    assert got == [["Kenya", "Peru"], None, None, None, None]


def test_digest_is_sent(spark, tmp_path, capsys):
    digest = spark.createDataFrame([(2, "**b**", "b"), (1, "**a**", "a")], "place int, markdown string, plain string")
    writers.send_file(digest, str(tmp_path / "out"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "out")).collect()] == ["**a**", "", "**b**", ""]
    writers.send_console(digest)
    assert capsys.readouterr().out == "a\n\nb\n\n"


@pytest.mark.parametrize("text, value", [("TRUE", True), ("none", None), ("3", 3), ("0.5", 0.5), ("x y", "x y")])
def test_overrides(text, value):
    base = {"run": {"n": 1}, "flat": 2}
    got = overridden(base, {"GLEANERY__RUN__LIMIT": text, "GLEANERY__FLAT__IN__FIELDS": "a, ,b", "GLEANERY__RUN": "x", "OTHER__RUN__N": "9"})
    assert got == {"run": {"n": 1, "limit": value}, "flat": {"in": {"fields": ["a", "b"]}}} and base == {"run": {"n": 1}, "flat": 2}
