"""Typed facts out of free text, as native expressions: money, requirements and classes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: US dollars per unit of a currency.
FX = {
    "USD": 1.0, "EUR": 1.09, "GBP": 1.27, "CAD": 0.73, "AUD": 0.66, "NZD": 0.6, "JPY": 0.0066, "CNY": 0.14, "CHF": 1.12, "SEK": 0.095, "NOK": 0.094, "DKK": 0.146,
    "INR": 0.012, "PKR": 0.0036, "TRY": 0.029, "ZAR": 0.055, "SGD": 0.74, "HKD": 0.13, "KRW": 0.00072, "RUB": 0.011, "PLN": 0.25, "HUF": 0.0027, "CZK": 0.043,
    "BRL": 0.18, "MXN": 0.055, "SAR": 0.27, "AED": 0.27, "QAR": 0.27, "ILS": 0.27, "TWD": 0.031, "MYR": 0.21, "IDR": 6.2e-05, "PHP": 0.017, "VND": 4e-05,
    "NGN": 0.00065, "KES": 0.0078, "EGP": 0.02, "BDT": 0.0083, "NPR": 0.0075, "LKR": 0.003, "MAD": 0.1, "TND": 0.32, "GHS": 0.065, "UAH": 0.024, "RSD": 0.01,
    "BGN": 0.58, "RON": 0.22, "HRK": 0.15, "BZD": 0.5, "JMD": 0.0064, "TTD": 0.148, "THB": 0.028,
}
#: What a symbol stands for.
SYMBOLS = {"US$": "USD", "$": "USD", "€": "EUR", "£": "GBP", "¥": "JPY", "￥": "CNY", "RMB": "CNY", "₹": "INR", "₺": "TRY", "₩": "KRW", "₽": "RUB", "R$": "BRL", "﷼": "SAR",
           "RM": "MYR", "₦": "NGN", "₴": "UAH", "C$": "CAD", "A$": "AUD", "CA$": "CAD", "AU$": "AUD", "HK$": "HKD", "SG$": "SGD", "NZ$": "NZD", "NT$": "TWD", "BZ$": "BZD",
           "JM$": "JMD", "TT$": "TTD", "EC$": "USD", "SV$": "USD", "MX$": "MXN"}
#: Phrases, as whole words in any case and with any marks between, that name what an award covers.
COVERAGE = {
    "tuition": ("tuition", "course fees", "study fees"),
    "stipend": ("stipend", "living allowance", "living costs", "living expenses", "monthly allowance", "pocket money", "subsistence"),
    "airfare": ("airfare", "flight", "flights", "plane ticket", "travel costs", "travel grant", "travel allowance"),
    "health_insurance": ("health insurance", "medical insurance", "accident insurance", "health cover", "medical cover"),
    "visa_fee": ("visa fee", "visa fees", "visa costs", "residence permit"),
    "accommodation": ("accommodation", "housing", "dormitory", "lodging", "rent"),
    "books": ("books", "textbooks", "study materials", "course materials"),
    "language_course": ("language course", "language training", "language classes", "preparatory year"),
    "research_budget": ("research grant", "research budget", "research allowance", "laboratory costs", "fieldwork costs"),
}
FULL = ("fully funded", "full funding", "full scholarship", "all expenses", "all costs", "full tuition", "covers tuition")
PARTIAL = ("partially funded", "partial funding", "partial scholarship", "tuition waiver", "fee waiver", "fee reduction", "part of the costs")
DEGREES = {
    "Bachelor": ("bachelor", "bachelors", "undergraduate", "bsc"),
    "Master": ("master", "masters", "postgraduate", "msc", "mba"),
    "PhD": ("phd", "ph d", "doctorate", "doctoral"),
    "Diploma": ("diploma", "foundation year"),
    "Postdoc": ("postdoc", "postdoctoral", "post doc"),
}
#: Short forms of levels, which count where nothing but a level is meant, not in prose.
SHORT_DEGREES = {"Bachelor": ("b sc", "b a", "ba", "bba", "btech"), "Master": ("m sc", "m eng", "mtech", "post graduate"), "PhD": ("dphil",), "Diploma": ("foundation",), "Postdoc": ()}
#: Phrases that leave the subject open.
EVERY_FIELD = tuple(f"{w} {n}" for w in ("any", "all") for n in ("subject", "subjects", "field", "fields", "discipline", "disciplines", "course", "courses", "program", "programme", "degree"))
#: Phrases that speak for a field of study.
FIELDS = {
    "AI/ML": ("artificial intelligence", "machine learning", "deep learning", "neural networks", "computer vision", "language models", "ai"),
    "Data Science": ("data science", "data analysis", "data analytics", "big data", "statistics", "data mining"),
    "Computer Science": ("computer science", "computing", "informatics", "software", "robotics", "information technology", "computer security"),
    "Engineering": ("engineering", "mechanics", "electronics", "aerospace", "civil engineering", "materials science"),
    "STEM": ("stem", "physics", "chemistry", "mathematics", "biology", "astronomy", "geology"),
    "Business": ("business", "management", "finance", "accounting", "marketing", "entrepreneurship"),
    "Public Policy": ("public policy", "public administration", "international relations", "diplomacy", "governance", "development studies"),
    "Health": ("public health", "nursing", "medicine", "pharmacy", "dentistry", "epidemiology"),
    "Environment": ("environment", "environmental", "climate", "sustainability", "ecology", "renewable energy", "agriculture", "forestry"),
    "Education": ("education", "teaching", "pedagogy", "teacher training"),
    "Law": ("law", "legal", "human rights", "jurisprudence"),
    "Arts/Humanities": ("humanities", "history", "philosophy", "literature", "linguistics", "music", "theatre", "design", "film"),
    "Social Sciences": ("social sciences", "sociology", "anthropology", "economics", "psychology", "political science", "geography"),
}


def spaced(text: Column) -> Column:
    """A text as words in lower case, each between spaces of its own, in which a phrase is found without a pattern."""
    return F.concat(F.lit(" "), F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "  "), F.lit(" "))


def padded(phrase: str) -> str:
    return " " + phrase.replace(" ", "  ") + " "


def says(words: Column, phrases: tuple[str, ...]) -> Column:
    """Whether a text as of `spaced` holds one of the phrases."""
    return reduce(Column.__or__, [F.contains(words, F.lit(padded(p))) for p in phrases])


def times(words: Column, phrase: str) -> Column:
    return ((F.length(words) - F.length(F.replace(words, F.lit(padded(phrase)), F.lit("")))) / len(padded(phrase))).cast("int")


def bare_number(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), r"[\s']", "")


def money_number(text: Column) -> Column:
    """A number as people write it: 1.234,56 and 1,234.56, groups of two or three digits, two decimals at most; null if it is none."""
    return read_number(bare_number(text))


def read_number(t: Column) -> Column:
    """`money_number` of what `bare_number` gives."""
    european = t.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+(,[0-9]{1,2})?$") | t.rlike(r"^[0-9]+,[0-9]{1,2}$")
    plain = F.when(european, F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(F.replace(t, F.lit(","), F.lit("")))
    return F.when(t.rlike("^[0-9]+$"), t.try_cast("double")).when(t.rlike(r"^[0-9][0-9.,]*$"), plain.try_cast("double"))


def in_usd(amount: Column, currency: Column) -> Column:
    """An amount in US dollars; a symbol stands for its currency, and an unknown code counts as a dollar."""
    rates = F.create_map(*[x for k, v in (FX | {s: FX[c] for s, c in SYMBOLS.items()}).items() for x in (F.lit(k), F.lit(v))])
    return amount * F.coalesce(rates[F.upper(F.trim(currency))], F.lit(1.0))


def iso_date(text: Column) -> Column:
    """The first ISO date; one that no calendar has is none."""
    return F.try_to_date(F.nullif(F.regexp_extract(text, r"\b([0-9]{4}-[0-9]{2}-[0-9]{2})\b", 1), F.lit("")))


def gpa(text: Column) -> Column:
    """A grade average on the scale of 4: GPA x, or x/y."""
    pattern = r"(?i)\b(?:c?gpa)\b[^0-9]{0,30}([0-9](?:\.[0-9]{1,2})?)(?:\s*(?:/|out of|on a scale of)\s*([0-9]{1,2}(?:\.[0-9])?))?"
    value, scale = (F.regexp_extract(text, pattern, i).try_cast("double") for i in (1, 2))
    base = F.coalesce(scale, F.when(value > 4, 5.0).otherwise(4.0))
    return F.when(value > 0, F.floor(value * 4 / base * 100 + 0.5000001) / 100)


def english(text: Column) -> tuple[Column, Column]:
    """IELTS (3 to 9) and TOEFL (40 to 120) minimums."""
    band = F.regexp_extract(text, r"(?i)\bielts\b[^0-9]{0,40}([3-9](?:\.[05])?)\b", 1).try_cast("double")
    points = F.regexp_extract(text, r"(?i)\btoefl\b[^0-9]{0,40}([0-9]{2,3})\b", 1).try_cast("int")
    return band, F.when(points.between(40, 120), points)


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """`f` of a value that is computed once, however often `f` names it."""
    return F.transform(F.array(value), f)[0]


def level_names(value: Column) -> Column:
    """The levels, in order, that a value which states levels names."""
    return bound(spaced(value), lambda words: F.array_compact(F.array(*[F.when(says(words, p + SHORT_DEGREES[k]), F.lit(k)) for k, p in DEGREES.items()])))


def let(f: Callable[..., Column], **values: Column) -> Column:
    """`f` of several values, each computed once: within lambda functions nothing else keeps a value that is named twice from being computed twice."""
    return bound(F.struct(*[v.alias(k) for k, v in values.items()]), lambda s: f(*[s[k] for k in values]))


def classes(text: Column, phrases: dict[str, tuple[str, ...]]) -> Column:
    """The comma-separated names of the classes of which a phrase occurs, in their order."""
    return bound(spaced(text), lambda words: F.array_join(F.array_compact(F.array(*[F.when(says(words, p), F.lit(k)) for k, p in phrases.items()])), ","))


def funding_type(text: Column) -> Column:
    """Full if a text says so or covers three things, else partial if it says so, else by what it covers."""

    def kind(t: Column) -> Column:
        covered, only = t["covered"], F.array_contains(t["covered"], "tuition") & (F.size(t["covered"]) == 1)
        return (F.when(says(t["words"], FULL) | (F.size(covered) >= 3), "Full").when(says(t["words"], PARTIAL), "Partial")
                .when(only, "Tuition-only").when(F.size(covered) > 0, "Partial").otherwise("Unknown"))

    found = lambda words: F.array_compact(F.array(*[F.when(says(words, p), F.lit(k)) for k, p in COVERAGE.items()]))
    return bound(spaced(text), lambda words: bound(F.struct(words.alias("words"), found(words).alias("covered")), kind))


def field_scores(head: Column, words: Column) -> Column:
    """Per class and phrase: 4 if it is in the title, 1 for each of up to six occurrences in the body; an array of (score, name).
    Both texts are as of `spaced`."""
    one = lambda ps: sum((F.when(F.contains(words, F.lit(padded(p))), F.least(times(words, p), F.lit(6))).otherwise(0) + F.when(F.contains(head, F.lit(padded(p))), 4).otherwise(0) for p in ps), F.lit(0))
    return F.array(*[F.struct(one(ps).alias("score"), F.lit(k).alias("name")) for k, ps in FIELDS.items()])


def fields(title: Column, body: Column) -> Column:
    """The up to four classes of 6 or more, best first, else the best of 4 or more."""

    def best(xs: Column) -> Column:
        order = F.array_sort(F.filter(xs, lambda x: x["score"] >= 4), lambda a, b: b["score"] - a["score"])
        return bound(order, lambda o: bound(F.slice(F.filter(o, lambda x: x["score"] >= 6), 1, 4), lambda high: F.array_join(
            F.transform(F.when(F.size(high) > 0, high).otherwise(F.slice(o, 1, 1)), lambda x: x["name"]), ", ")))

    texts = F.struct(spaced(title).alias("head"), spaced(body).alias("words"))
    return bound(bound(texts, lambda t: field_scores(t["head"], t["words"])), best)


def constraints(text: Column) -> dict[str, Column]:
    """Age, experience, years since the degree and the need of a GRE."""
    age = F.coalesce(*[F.regexp_extract(text, p, 1).try_cast("int") for p in (r"(?i)(?:under|below|not (?:older|more) than|maximum age(?: of)?|up to)\s+([0-9]{2})\s*(?:years|\b)", r"(?i)age limit[^0-9]{0,12}([0-9]{2})")])
    return {
        "max_age": F.when(age.between(18, 55), age),
        "min_experience": F.regexp_extract(text, r"(?i)([0-9]{1,2})\+?\s*years?(?:'| of)?\s*(?:relevant |professional |full-time )?(?:work|professional)?\s*experience", 1).try_cast("double"),
        "max_years_since": F.regexp_extract(text, r"(?i)within (?:the )?(?:last |past )?([0-9]{1,2}) years", 1).try_cast("int"),
        "gre": F.coalesce(text.rlike(r"(?i)\bgre\b[^.]{0,30}(required|mandatory)"), F.lit(False)),
    }


def provider(text: Column) -> Column:
    """The value of a line that is labelled as provider, host or sponsor."""
    return F.nullif(F.trim(F.regexp_extract(text, r"(?im)^\s*(?:provider|host institution|university|sponsor|funded by)\s*:\s*([^\n]{3,120})", 1)), F.lit(""))
