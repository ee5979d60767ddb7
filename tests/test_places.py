import pytest
from pyspark.sql import functions as F

from gleanery.functions import countries, places
from gleanery.operators import match

CASES = [
    ("Award\nStudy in: the UK for international students\nOpen to Kenya, Viet Nam and Trinidad and Tobago may apply.", ("United Kingdom", ["Kenya", "Vietnam", "Trinidad and Tobago"], [], None)),
    ("Host country: Atlantis  | more\nNot open to Iran, North Korea and Narnia.", ("Atlantis", [], ["Iran", "North Korea"], None)),
    ("Scholarships in Germany for all\nEligible countries: Pakistan, Students", ("Germany", [], [], None)),
    ("Open to Guinea, Papua New Guinea and Guinea\nLocation: U.S.A.", ("United States", ["Guinea", "Papua New Guinea"], [], None)),
    ("Grand award of South Korea\nand Chad. Worldwide.", ("South Korea", [], [], "worldwide-ish")),
    ("A fellowship at Oxford", ("Oxford", [], [], None)), ("open to all", (None, [], [], None)), ("", (None, [], [], None)), (None, (None, [], [], None)),
    ("x " * 50_000 + "\nStudy in Peru", ("Peru", [], [], None)),
]


def test_stated_countries(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES)], "id long, text string")
    got = {r["id"]: (r["country"], r["allowed"], r["excluded"], r["scope"]) for r in places.stated_countries(df).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CASES)}
    assert places.stated_countries(df.limit(0)).count() == 0


def test_groups_and_titles(spark):
    df = spark.createDataFrame([(1, "open to the Nordic states and Peru", "Grants of Norway"), (2, "Open to Nordic, Peru", "Study"), (3, "nothing", "Kenya or Papua New Guinea")], "k long, body string, head string")
    got = {r["k"]: r for r in places.stated_countries(df, "k", "body", "head").collect()}
    assert got[1]["allowed"] == [] and got[1]["country"] == "Norway"
    assert got[2]["allowed"] == [*countries.NORDIC, "Peru"] and got[3]["country"] == "Papua New Guinea"


@pytest.mark.parametrize("name", ["uk", "The Netherlands", "Study in: FRANCE *", "NATION_3", "u.s.a.", "korea (south)", "isle of man", "DPRK", "", " . ", None, "Timor-Leste", "in the bahamas"])
def test_usual_names_on_driver_and_executors(spark, name):
    assert spark.range(1).select(countries.canon(F.lit(name).cast("string"))).first()[0] == countries.usual(name)


def test_gates_go_by_usual_names(spark):
    lists = [("Holland, Peru", None, True), ("EU", None, True), ("Kenya", None, False), (None, "the netherlands", False), (None, "NETHERLANDS,Iran", False), ("International Students", "", True), ("", None, True), (" , ", None, True)]
    df = spark.createDataFrame([(i, e, x) for i, (e, x, _) in enumerate(lists)], "id long, eligible string, excluded string")
    sets = match.with_country_sets(df)
    home = countries.usual("Holland")
    got = {r["id"]: home not in (r["excluded_set"] or []) and (r["allowed_set"] is None or home in r["allowed_set"]) for r in sets.collect()}
    assert got == {i: ok for i, (_, _, ok) in enumerate(lists)} and sets.count() == len(lists)
