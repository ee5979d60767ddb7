"""Dates and deadlines in free text, as native expressions. Whatever depends on time takes `as_of`."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import facts

MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
DAY, YEAR = r"[0-9]{1,2}(?:st|nd|rd|th)?", r"(?:19|20)[0-9]{2}"
#: The shapes of a date; where several fit at one place the first does. A month's end, or the next of a day without a year, is a guess.
SHAPES = {
    "iso": rf"\b{YEAR}-[0-9]{{1,2}}-[0-9]{{1,2}}\b",
    "month_day": rf"\b{MONTH}\s+{DAY},?\s+{YEAR}\b",
    "day_month": rf"\b{DAY}(?:\s+of)?[\s-]+{MONTH}[\s,-]+{YEAR}\b",
    "short": rf"\b[0-9]{{1,2}}\s*[/-]\s*{MONTH}\s*[/-]\s*[0-9]{{2}}\b",
    "numbers": rf"\b[0-9]{{1,2}}[/.][0-9]{{1,2}}[/.]{YEAR}\b",
    "month": rf"\b{MONTH}\s+{YEAR}\b",
    "day": rf"\b{DAY}\s+{MONTH}(?![\s,-]*[0-9]{{4}})",
}
#: Each shape begins a word, by a figure or a month's first letter, which is asked first.
ANY_DATE = r"(?i)(?=[0-9adfjmnos])\b(" + "|".join(SHAPES.values()) + ")"
#: Words that announce a deadline; that there is none; that it comes round.
DEADLINE = r"deadlines?|closing date|apply by|applications? (?:close|due)|due (?:date|by)|last date|closes on"
ROLLING = r"rolling (?:basis|admission|deadline)|year[- ]round|open all year|until filled|no deadline"
AROUND, YEARS_BACK, YEARS_AHEAD, DAYS_BACK = 120, 5, 8, 400
INTAKE = rf"(?i)\b({MONTH})\s*({YEAR})\b"


def made(year: Column, month: Column, day: Column) -> Column:
    """The date, null if no calendar has it."""
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def month_of(text: Column) -> Column:
    """The number of the first month that a text names."""
    name = F.lower(F.regexp_extract(text, f"(?i)({MONTH})", 1))
    return F.when(name != "", (F.floor((F.position(F.substring(name, 1, 3), F.lit("janfebmaraprmayjunjulaugsepoctnovdec")) + 2) / 3)).cast("int"))


def _read(text: Column, as_of: date, horizon: int) -> Column:
    """A date of one of SHAPES as struct<day, exact>; day is null where it is none, or not plausible."""
    today = F.lit(as_of.isoformat()).cast("date")
    end = lambda y, m: F.last_day(made(y, m, F.lit(1)))

    def placed(shape: Column, n: Column, month: Column) -> Column:
        at = lambda i: F.try_element_at(n, F.lit(i))
        short_year = at(2) + F.when(at(2) < 70, 2000).otherwise(1900)
        this = made(F.lit(as_of.year), month, at(1))
        again = F.least(F.date_add(made(F.lit(as_of.year + 1), month, F.lit(1)), at(1) - 1), end(F.lit(as_of.year + 1), month))
        day = (F.when(shape == "iso", made(at(1), at(2), at(3))).when(shape == "month_day", made(at(2), month, at(1))).when(shape == "day_month", made(at(2), month, at(1)))
               .when(shape == "short", made(short_year, month, at(1))).when(shape == "numbers", made(at(3), at(2), F.least(at(1), F.lit(28))))
               .when(shape == "month", end(at(1), month)).when(this.isNotNull(), F.when(this < F.date_sub(today, 3), again).otherwise(this)))
        return facts.let(likely, day=day, exact=~shape.isin("month", "day"))

    def likely(day: Column, exact: Column) -> Column:
        fits = F.year(day).between(as_of.year - YEARS_BACK, as_of.year + YEARS_AHEAD) & (exact | day.between(F.date_sub(today, DAYS_BACK), F.date_add(today, horizon)))
        return F.struct(F.when(fits, day).alias("day"), exact.alias("exact"))

    shape = F.coalesce(*[F.when(text.rlike(f"(?i)^{p}$"), F.lit(k)) for k, p in SHAPES.items()])
    return facts.let(placed, shape=shape, n=F.transform(F.regexp_extract_all(text, F.lit("([0-9]+)"), 1), lambda x: x.try_cast("int")), month=month_of(text))


def dates(text: Column, as_of: str, horizon: int = 760) -> Column:
    """The plausible dates of a text as array<struct<day, exact>>, best first: exact ones to come, the next first; exact ones past, the last
    first; then guesses likewise. Numbers are day first. A month of which a day is named is not guessed at its end."""
    day_of = date.fromisoformat(as_of[:10])
    today = F.lit(day_of.isoformat()).cast("date")

    def ranked(found: Column) -> Column:
        return facts.let(ordered, found=found, months=F.transform(F.filter(found, lambda x: x["exact"]), lambda x: F.trunc(x["day"], "month")))

    def ordered(found: Column, months: Column) -> Column:
        kept = F.filter(found, lambda x: x["exact"] | (x["day"] != F.last_day(x["day"])) | ~F.array_contains(months, F.trunc(x["day"], "month")))
        keyed = F.transform(kept, lambda x: F.struct((~x["exact"]).alias("guess"), (x["day"] < today).alias("past"), F.abs(F.datediff(x["day"], today)).alias("far"), x["day"].alias("day"), x["exact"].alias("exact")))
        return facts.bound(F.array_sort(F.array_distinct(keyed)), lambda order: facts.let(firsts, order=order, days=F.transform(order, lambda y: y["day"])))

    def firsts(order: Column, days: Column) -> Column:
        """A day that is stated exactly and guessed as well counts as stated."""
        once = F.filter(order, lambda x, i: F.array_position(days, x["day"]) == i + 1)
        return F.transform(once, lambda x: F.struct(x["day"].alias("day"), x["exact"].alias("exact")))

    hits = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(ANY_DATE), 1)
    found = F.filter(F.transform(hits, lambda h: _read(h, day_of, horizon)), lambda x: x["day"].isNotNull())
    return facts.bound(found, lambda xs: F.when(F.size(xs) < 2, xs).otherwise(ranked(xs)))


def nearest(text: Column, as_of: str, horizon: int = 760) -> Column:
    """struct<text, d: struct<day, exact>>: the best date behind the first word that announces a deadline and has one within 120 characters and its
    paragraph, else the best of the whole text; null where there is none. A stretch is read only if none before it has a date, the whole text last."""
    t = F.coalesce(text, F.lit(""))
    near = F.transform(F.regexp_extract_all(t, F.lit(rf"(?is)(?=[acdl])(?=((?:{DEADLINE}).{{0,{AROUND}}}))"), 1), lambda s: F.substring_index(s, "\n\n", 1))
    none = F.lit(None).cast("struct<text:string,d:struct<day:date,exact:boolean>>")
    read = lambda s: facts.bound(F.get(dates(s, as_of, horizon), F.lit(0)), lambda d: F.when(d.isNotNull(), F.struct(s.alias("text"), d.alias("d"))))
    return F.aggregate(F.concat(near, F.array(t)), none, lambda a, s: F.when(a.isNotNull(), a).otherwise(read(s)))


def shown(near: Column) -> Column:
    """The stretch in which `nearest` found its date, as shown."""
    return F.when(near.isNotNull(), F.substring(F.trim(F.regexp_replace(near["text"], r"\s+", " ")), 1, 180))


def rolling(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike(f"(?i){ROLLING}")


def round_label(text: Column) -> Column:
    """The round, the year's or the season's intake of which a text speaks."""
    t = F.coalesce(text, F.lit(""))
    numbered, annual = F.regexp_extract(t, r"(?i)\bround\s*([1-4])\b", 1), t.rlike(r"(?i)\bannual(?:ly)?\b|\bevery year\b")
    season = F.regexp_extract(t, r"(?i)\b((?:fall|autumn|spring|winter|summer) (?:20[0-9]{2} )?intake)\b", 1)
    return F.when(numbered != "", F.concat(F.lit("Round "), numbered)).when(annual, "Annual").when(season != "", F.initcap(season))


def deadline(text: Column, as_of: str, horizon: int = 760) -> Column:
    """struct<deadline, deadline_text, estimated, rolling, round_label, past>: the date of `nearest` and what else is said of it. Nulls where there is none."""
    today = F.lit(as_of[:10]).cast("date")
    return facts.bound(nearest(text, as_of, horizon), lambda x: F.struct(
        x["d"]["day"].alias("deadline"), shown(x).alias("deadline_text"), (~x["d"]["exact"]).alias("estimated"),
        rolling(text).alias("rolling"), round_label(text).alias("round_label"), (x["d"]["day"] < today).alias("past")))


def intake(text: Column) -> Column:
    """When a course starts, as a text that says nothing else states it: month and year, else a span of years."""
    month, year = (F.regexp_extract(text, INTAKE, i) for i in (1, 2))
    years = F.regexp_extract(text, r"\b(20[0-9]{2}\s*[-–/]\s*(?:20)?[0-9]{2})\b", 1)
    return F.when(month != "", F.concat(F.initcap(month), F.lit(" "), year)).otherwise(F.nullif(years, F.lit("")))


def stated_intake(text: Column) -> Column:
    """`intake` of what follows the first word that speaks of a start, in its sentence."""
    return intake(F.regexp_extract(text, r"(?i)\b(?:intake|starts?|starting|beginning|commenc\w+)\b([^.\n]{0,40})", 1))
