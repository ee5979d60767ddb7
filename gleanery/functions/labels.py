"""Labelled lines of a listing and what they say, typed, as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import coerce, dates, facts, money, notices
from gleanery.functions.money import constant_map

#: The labels of each field, and labels that only end the field before them.
LABELS = {
    "deadline": ("deadline", "closing date", "closing date for applications", "application deadline", "last date for applications", "apply by", "deadline for applications"),
    "open_date": ("opening date", "applications open", "applications start", "start of applications"),
    "level": ("level/field(s) of study", "level of study", "level", "degree", "study level", "academic level", "eligibility level", "level/field of study"),
    "field": ("field", "fields of study", "field(s) of study", "subject", "subjects", "discipline", "disciplines", "area of study", "areas of study", "courses", "courses offered"),
    "country": ("study in", "host country", "destination country", "country", "country of study", "location", "country/region"),
    "institution": ("host institution(s)", "host institution", "host university", "host universities", "institutions", "university", "institution", "universities"),
    "value": ("scholarship value/inclusions", "scholarship value", "benefits", "what the scholarship covers", "amount", "value of award", "scholarship covers",
              "value and inclusions", "financial support", "scholarship award", "award value"),
    "eligibility": ("eligibility", "who can apply", "who may apply", "eligibility criteria", "requirements", "target group", "criteria"),
    "number_of_awards": ("number of awards", "awards available", "how many scholarships", "no. of awards"),
    "language": ("english language requirements", "language requirements", "english requirements", "english language requirement"),
    "nationality": ("nationality", "target countries", "eligible countries", "open to", "who is eligible from", "citizenship"),
    "intake": ("course starts", "intake", "starting", "start date", "tenure", "duration", "period"),
    "updated": ("last updated", "updated"),
    "official": ("official website", "official link", "apply online", "website", "more info", "further information"),
    "description": ("brief description", "description", "summary", "about"),
    "procedure": ("application procedure", "application procedures", "how to apply", "application process", "selection procedure", "selection criteria",
                  "application requirements", "documents required"),
    "contact": ("contact", "more information", "enquiries"),
}
#: Labels of ours besides, and a field whose lines only end the one before.
ALSO = {"value": ("value", "award"), "institution": ("provider", "sponsor", "funded by"), "language": ("ielts", "toefl")}
ENDS_ONLY = ("official",)
MOST_LINE, MOST_LINES, MOST_CHARS, WRAPPED = 120, 14, 1200, 90
#: A label: a few words at the start of a line of at most 120 characters, up to a colon or a dash; the words, and what stands behind them up to the line's end.
GAP = r"[ \t\x0B\f\r]"
LABEL = rf"\n(?=[^\n]{{1,{MOST_LINE}}}\n){GAP}*([A-Za-z][A-Za-z /'()&,.-]{{1,44}}?)(?=[ \t\x0B\f\r:–—]){GAP}*(?::|–|—|{GAP}-{GAP}){GAP}*(.*)[\r\u0085\u2028\u2029]?(?=\n)"
#: All names of labels in the order of their fields; the field of each name and, behind its place in that order, of each name that goes on after a space.
NAMES = [(a, k, f"{i:02}{k}") for i, k in enumerate(LABELS) for a in (*LABELS[k], *ALSO.get(k, ()))]
WHOLE = {a: k for a, k, _ in reversed(NAMES)}
PLACED, BEGUN = {a: p for a, _, p in reversed(NAMES)}, {a[:m.start()]: p for a, _, p in reversed(NAMES) for m in re.finditer(" ", a)}
LED = f"^({'|'.join(re.escape(a) for a, _, _ in NAMES)}) "


def _key(name: Column) -> Column:
    """The field of a label, by its whole name, else, beyond six letters, by a name that begins with it or with which it begins, up to a word's end."""
    low = F.lower(F.trim(name))
    return facts.bound(F.when(F.contains(low, F.lit("  ")), F.regexp_replace(low, " +", " ")).otherwise(low), _field)


def _field(name: Column) -> Column:
    first = F.least(F.try_element_at(constant_map(BEGUN), name), F.try_element_at(constant_map(PLACED), F.nullif(F.regexp_extract(name, LED, 1), F.lit(""))))
    return F.coalesce(F.try_element_at(constant_map(WHOLE), name), F.when(F.length(name) > 6, F.substring(first, 3, 40)))


def label_values(text: Column) -> Column:
    """map<field, value>: what stands behind a label in its line, else on up to 14 lines below it, up to the next label of whatever kind. A date may go
    on in the next line, if that has a figure. Values of a label that comes again are joined. Null and empty texts have none.

    The whole text is brought to lines without margins, none empty, between line feeds, and cut at its labels by one pattern, so that work is done by label and not by line."""
    raw = F.concat(F.lit("\n"), text, F.lit("\n"))
    margins = F.contains(raw, F.lit("\n\n")) | F.contains(raw, F.lit(" \n")) | F.contains(raw, F.lit("\n ")) | F.contains(raw, F.lit("\r"))
    lines = F.when(margins, F.regexp_replace(F.concat(F.lit("\n"), text, F.lit(" \n")), r"(?<! )(?: *\r?\n *)+", "\n")).otherwise(raw)
    # no line is empty, so an empty one tells a label: its name, a line of its own text behind a space, the lines below
    parts = F.split(F.regexp_replace(lines, LABEL, "\n\n$1\n $2"), "\n\n")
    keyed = F.transform(F.slice(parts, 2, 2**30), lambda p: F.struct(_key(F.substring_index(p, "\n", 1)).alias("key"), p.alias("part")))

    def own(h: Column) -> Column:
        return facts.bound(F.split(h["part"], "\n"), lambda ls: facts.let(said, key=h["key"], ls=ls, own=F.trim(ls[1])))

    def said(key: Column, ls: Column, own: Column) -> Column:
        more = F.get(ls, F.lit(2))
        wraps = key.isin("deadline", "open_date") & (F.length(own) < 24) & more.rlike("[0-9]") & (F.length(own) + F.length(more) < WRAPPED)
        all_of = F.when(own == "", F.substring(F.array_join(F.slice(ls, F.lit(3), F.lit(MOST_LINES)), " "), 1, MOST_CHARS)).when(wraps, F.concat(own, F.lit(" "), more)).otherwise(own)
        return F.struct(key.alias("key"), F.btrim(F.regexp_replace(all_of, r"\s{2,}|[\t\n\x0B\f\r]", " "), F.lit(" -|")).alias("value"))

    def joined(vs: Column, keys: Column) -> Column:
        one = lambda k: F.array_join(F.transform(F.filter(vs, lambda v: v["key"] == k), lambda v: v["value"]), " ")
        return F.when(F.size(keys) == F.size(vs), F.map_from_entries(vs)).otherwise(F.map_from_entries(F.transform(keys, lambda k: F.struct(k.alias("key"), one(k).alias("value")))))

    values = F.filter(F.transform(F.filter(keyed, lambda h: ~h["key"].isin(*ENDS_ONLY)), own), lambda v: v["value"] != "")
    none = F.array().cast("array<struct<key:string,value:string>>")
    return facts.bound(F.coalesce(values, none), lambda vs: facts.let(joined, vs=vs, keys=F.array_distinct(F.transform(vs, lambda v: v["key"]))))


def typed_values(df: DataFrame, text: str, as_of: str, values: str = "label_values") -> tuple[DataFrame, dict[str, Column]]:
    """`df` with `values`, the map of `label_values`, and columns of steps, as one expression would be too deep to resolve; over these, what the labels
    say by name. Steps of which nothing is selected are not computed."""
    v = lambda k: F.try_element_at(values, F.lit(k))
    due = F.concat(F.lit("Deadline: "), v("deadline"))
    df = df.withColumn(values, label_values(F.col(text)))
    df = df.withColumn("_when", dates.nearest(due, as_of)["d"]).withColumn("_best", F.array_max(money.amounts(v("value"))))
    df = df.withColumn("_where", coerce.label_countries(v("country"))).withColumn("_citizens", F.filter(coerce.label_countries(v("nationality")), lambda x: F.length(x) <= 40))
    df = df.withColumn("_degree", notices.label_levels(v("level"))).withColumn("_every", coerce.any_field(F.concat_ws(" ", v("field"), v("level"), v("value"))))
    band, points = facts.english(v("language"))
    awards = F.replace(F.regexp_extract(v("number_of_awards"), "([0-9][0-9,]{0,9})", 1), F.lit(","), F.lit("")).try_cast("int")
    school = v("institution").rlike(r"(?i)\b(?:university|institute|college|school|academy|foundation)\b|\bany ")
    return df, {
        "deadline": F.col("_when.day"), "deadline_text": F.substring(v("deadline"), 1, 180), "rolling": F.when(v("deadline").isNotNull(), dates.rolling(due)), "estimated": ~F.col("_when.exact"),
        "round_label": dates.round_label(due), "country": F.get("_where", F.lit(0)), "eligible": F.when(F.size("_citizens") > 0, F.col("_citizens")).when(F.size("_where") > 1, F.col("_where")),
        "degree": F.col("_degree"), "provider": F.when(school, F.substring(v("institution"), 1, 200)), "amount_usd": F.col("_best.usd"), "amount_text": F.col("_best.text"), "currency": F.col("_best.currency"),
        "min_ielts": band, "min_toefl": points, "n_awards": awards, "intake": dates.intake(v("intake")), "field": F.when(F.col("_every"), "Any").otherwise(F.substring(v("field"), 1, 400))}


def with_labels(df: DataFrame, text: str, as_of: str, values: str = "label_values", typed: str = "labels") -> DataFrame:
    """`df` with `values`, the map of `label_values`, and `typed`, a struct of what they say; null where a label is missing or says nothing that
    can be read."""
    made, said = typed_values(df, text, as_of, values)
    return made.select(*df.columns, values, F.struct(*[c.alias(k) for k, c in said.items()]).alias(typed))
