"""Amounts of money in free text, as native expressions: each with the period that stands nearest to it and belongs to no other."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from gleanery.functions import facts

#: How often a year an award is paid by each period; days and hours say nothing of the year.
PER_YEAR = {"month": 10.0, "week": 40.0, "semester": 2.0, "year": 1.0, "day": 1.0, "hour": 1.0}
#: Words for periods, and how a period may follow an amount.
PERIODS = {"month": ("month", "mo", "monthly", "pm"), "year": ("year", "yr", "annum", "yearly", "annually", "pa"), "week": ("week", "wk", "weekly"),
           "semester": ("semester", "sem", "term"), "day": ("day", "daily"), "hour": ("hour", "hr", "hourly")}
NUMBERS = ("two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve")
NUMBER = r"(?:[0-9]{1,3}(?:[ ,.'][0-9]{2,3})+(?:[.,][0-9]{1,2})?|[0-9]+(?:[.,][0-9]{1,2})?)(?![0-9])"
_letters = "|".join((*facts.FX, *[s for s in facts.SYMBOLS if s.isalpha()]))
_marks = "".join(s for s in facts.SYMBOLS if len(s) == 1 and s != "$")
#: A dollar may have up to two letters before it; one of a place that has no dollar of its own is a dollar of the United States.
SIGN = rf"(?:(?<![A-Za-z])[A-Za-z]{{0,2}}\$(?![A-Za-z])|[{_marks}]|\b(?:{_letters})(?![A-Za-z]))"
CODE = rf"(?:[A-Za-z]{{0,2}}\$|[{_marks}]|(?:{_letters})\b)"
RANGE = rf"(?:\s*(?:-|–|—|to)\s*(?:{SIGN}\s?)?{NUMBER})?"
#: At which characters an amount can begin; asked first, as most are others.
BEGINS = rf"(?=[$0-9{_marks}]|(?<![A-Za-z])[A-Za-z])"
AMOUNT = rf"(?i){BEGINS}(?:{SIGN}\s?{NUMBER}{RANGE}|(?<![0-9.,]){NUMBER}{RANGE}\s?{CODE})(?:\s?(?:k|million)\b)?"
#: Between an amount and its period stand at most 16 characters, and none that begin another item.
UNIT = rf"(?:(?:\b(?:per|an?|each|every|pro)\s+|/\s*)(?:{'|'.join(w for ws in PERIODS.values() for w in ws)})s?\b|\b(?:{'|'.join(w for ws in PERIODS.values() for w in ws if w.endswith('ly'))})\b|\bp\.?\s?[ma]\b\.?)"
BEHIND, LEAD = 28, 16
OTHER = r"(?i)\b(?:plus|and|or|with|including|excluding|covers|less|minus|but|additionally)\b|[,;&+]"


def constant_map(values: dict) -> Column:
    """A constant map; one node of the plan, however many entries it has."""
    return F.from_json(F.lit(json.dumps(values)), f"map<string,{'string' if isinstance(next(iter(values.values())), str) else 'double'}>")


def period(words: Column) -> Column:
    """The period that a unit's words name."""
    w = F.regexp_replace(F.regexp_replace(F.lower(words), r"^\s*(?:per|an?|each|every|pro)\s+|[^a-z]", ""), "s$", "")
    return F.try_element_at(constant_map({w: k for k, ws in PERIODS.items() for w in ws}), w)


def _one(hit: Column, before: Column, behind: Column, first: Column) -> Column:
    """An amount from its own text and the texts up to the amounts beside it."""
    near = F.regexp_replace(F.substring_index(F.substring(behind, 1, BEHIND), " for ", 1), r"(?s)(?:[;.]\s|[\n{}]).*", "")
    # a period before the amount, in its clause, that the amount before has not taken
    rest = F.when(first, before).otherwise(F.regexp_replace(before, rf"(?i)^.{{0,{LEAD}}}?{UNIT}", ""))
    clause = F.regexp_extract(F.right(rest, F.lit(60)), r"([^.;!\n]*)$", 1)
    span = rf"(?i)\bfor\s+(?:up to\s+)?((?:[0-9]{{1,2}}|{'|'.join(NUMBERS)})\s*(?:month|year))"

    def priced(sign: Column, number: Column, both: Column, ahead: Column, length: Column) -> Column:
        stated = F.when(both != "", F.regexp_extract(both, rf"(?i)({UNIT})$", 1))
        own = facts.bound(stated, lambda w: F.when(~F.left(both, F.length(both) - F.length(w)).rlike(OTHER), period(w)))
        currency = F.coalesce(F.try_element_at(constant_map(facts.SYMBOLS | {c: c for c in facts.FX}), sign), F.lit("USD"))
        count = F.coalesce(F.regexp_extract(length, "^([0-9]+)", 1).try_cast("int"), F.nullif(F.array_position(F.array(*map(F.lit, NUMBERS)), F.regexp_extract(length, "^([a-z]+)", 1)), F.lit(0)).cast("int") + 1)
        months = F.when(length != "", count * F.when(F.endswith(length, F.lit("year")), 12).otherwise(1))
        return facts.let(worth, number=number, currency=currency, own=own, unit=F.coalesce(own, F.nullif(ahead, F.lit(""))), months=months, both=both)

    def worth(number: Column, currency: Column, own: Column, unit: Column, months: Column, both: Column) -> Column:
        factor = F.when((unit == "month") & months.between(1, 60), months.cast("double")).otherwise(F.coalesce(F.try_element_at(constant_map(PER_YEAR), unit), F.lit(1.0)))
        usd = F.round(number * F.try_element_at(constant_map(facts.FX), currency) * factor, 2)
        return F.struct(usd.alias("usd"), number.alias("number"), currency.alias("currency"), unit.alias("unit"), F.trim(F.when(own.isNotNull(), F.concat(hit, both)).otherwise(hit)).alias("text"))

    large = F.lower(F.regexp_extract(hit, r"(?i)(k|million)$", 1))
    bare = F.transform(F.regexp_extract_all(hit, F.lit(f"({NUMBER})"), 1), facts.bare_number)
    number = F.array_max(F.transform(bare, facts.read_number)) * F.when(large == "k", 1e3).when(large == "million", 1e6).otherwise(1.0)
    return facts.let(priced, sign=F.upper(F.trim(F.regexp_extract(hit, f"(?i)({CODE})", 1))), number=number, both=F.regexp_extract(near, rf"(?i)^(.{{0,{LEAD}}}?{UNIT})", 1),
                     ahead=F.when(before.rlike("(?i)(?:month|week)ly"), F.lower(F.regexp_extract(clause, r"(?i)\b(month|week)ly\b", 1))), length=F.lower(F.regexp_extract(F.substring(behind, 1, 60), span, 1)))


def amounts(text: Column) -> Column:
    """The amounts of a text as array<struct<usd: a year, number, currency, unit, text>>; the largest is its array_max.

    A number beside a currency counts, a range by its upper bound. The text is cut at the amounts, so that a period is looked for no further than the next
    one. A monthly amount is paid ten times a year or, 'for N months', N times. Below 50 dollars without a period nothing is meant. Null and empty
    texts have none.
    """
    t = F.coalesce(text, F.lit(""))

    def each(parts: Column) -> Column:
        odd = F.sequence(F.lit(1), F.size(parts) - 2, F.lit(2))
        found = F.transform(F.when(F.size(parts) >= 3, odd), lambda i: _one(F.get(parts, i), F.get(parts, i - 1), F.get(parts, i + 1), i == 1))
        return F.coalesce(F.filter(found, lambda a: a["number"].isNotNull() & ((a["usd"] >= 50) | a["unit"].isNotNull())), F.array().cast("array<struct<usd:double,number:double,currency:string,unit:string,text:string>>"))

    # texts between amounts and amounts in turn; only texts with a figure are looked through
    cut = F.when(t.rlike("[0-9]"), F.split(F.regexp_replace(t, f"{AMOUNT}", "\u0001$0\u0001"), "\u0001", -1))
    return facts.bound(cut, each)
