"""Countries that free text states: the host, who may apply, who may not, and whether everyone may.

A cue opens a stretch of text. Where a capitalised word begins a name of the table of names (fixed, a few hundred), the words from there on are met with it, up to
five at once; in each stretch the longest name at the first place wins, and names don't overlap. A list restricts only if all of it is understood. All of
it happens within the row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import countries, facts
from gleanery.functions.money import constant_map

#: Words after which a text names the host, those who may apply, those who may not; phrases that say that all may.
HOST_CUES = ("study in", "host country", "destination country", "location", "scholarship for study in", "scholarships for study in", "scholarship in", "scholarships in")
AWARD_CUES = tuple(f"{a} {w}" for a in ("scholarship", "scholarships", "award", "awards", "fellowship", "fellowships", "grant") for w in ("in", "for", "at", "to"))
OPEN_CUES = ("open to", "eligible country", "eligible countries", "eligible nation", "eligible nations", "target group", "targeted group")
CLOSED_CUES = ("not eligible", "not open to", "not available to", "excluded countries", "excluded")
EVERYONE = ("developing countries", "commonwealth", "worldwide", "all nationalities", "all countries", "any nationality")
#: Words that may stand between names of a list.
BETWEEN = ("and", "or", "the", "of", "&", ",")
MOST_WORDS, STRETCH, HEAD_LINES, HEAD_CHARS = 5, 400, 3, 400


def name_key(name: str) -> str:
    return " ".join(re.sub(r"[^\w ]+|_", "", name.lower()).split())


#: The names of countries and groups by their keys, behind a star if of a group, and the words that begin a key.
_known = {name_key(k): v for k, v in (countries.KNOWN | countries.ALIASES).items()}
NAMES = _known | {k: f"*{g}" for g in countries.GROUPS if (k := name_key(g)) not in _known}
FIRST_WORDS = sorted({k.split(" ")[0] for k in NAMES})


def stretch(text: Column, cues: tuple[str, ...], but: str = "") -> Column:
    """What follows the first of the cues in its line, up to a bar, a semicolon or the sentence's end; null without one."""
    cue = "|".join(c.replace(" ", r"\s+") for c in sorted(cues, key=len, reverse=True))
    first = "".join(sorted({c[0] for c in cues}))
    found = F.regexp_extract(text, rf"(?i)(?=[{first}])\b{but}(?:{cue})\b\s*:?[ \t]*([^\n|;]{{2,{STRETCH}}})", 1)
    return F.nullif(F.regexp_replace(found, r"\.(?:\s+\p{Lu}.*|\s*)$", ""), F.lit(""))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([\p{L}\p{N}][\p{L}\p{N}.'’-]*|[,&])"), 1)


def list_words(text: Column) -> Column:
    """Of a list, the words up to the first that is neither capitalised nor between names."""
    fits = lambda x: x.rlike(r"^\p{Lu}") | F.lower(x).isin(*BETWEEN)
    until = lambda w: F.array_position(F.transform(w, lambda x: ~fits(x)), F.lit(True)).cast("int")
    return facts.bound(words(text), lambda w: facts.bound(until(w), lambda n: F.when(n > 0, F.slice(w, F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(w)))


def gram(w: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(w), r"[^\p{L}\p{N} ]+", ""), r"\s+", " "))


def met_names(ws: Column) -> Column:
    """The names among words, by place, the longest at each, none within another: array<struct<at, end, name, of_many, long>>."""
    none = F.array().cast("array<struct<at:int,end:int,name:string,of_many:boolean,long:int>>")
    fold = lambda w, at: F.aggregate(at, none, lambda a, i: F.when(F.exists(a, lambda x: x["end"] >= i), a).otherwise(F.concat(a, longest(w, i))))

    def longest(w: Column, i: Column) -> Column:
        one = lambda n: facts.bound(gram(F.array_join(F.slice(w, i, n), " ")), lambda k: facts.bound(F.try_element_at(constant_map(NAMES), k), lambda name: F.when(name.isNotNull(), F.struct(
            i.alias("at"), (i + n - 1).alias("end"), F.ltrim(name, F.lit("*")).alias("name"), F.startswith(name, F.lit("*")).alias("of_many"), F.length(k).alias("long")))))
        return F.slice(F.filter(F.transform(F.sequence(F.least(F.lit(MOST_WORDS), F.size(w) - i + 1), F.lit(1), F.lit(-1)), one), lambda x: x.isNotNull()), 1, 1)

    begins = lambda w: F.filter(F.transform(w, lambda x, i: F.when(x.rlike(r"^\p{Lu}") & gram(x).isin(*FIRST_WORDS), i + 1)), lambda i: i.isNotNull())
    return facts.bound(ws, lambda w: facts.bound(begins(w), lambda at: fold(w, at)))


def stated(df: DataFrame, text: str = "text", title: str | None = None, known: Column | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """`df` with columns of steps; over these, country, allowed, excluded (arrays of usual names, empty if none) and scope. Steps of which nothing is selected are
    not computed; where `known` holds, no country is looked for.

    The host is the name that follows a cue, by its usual name, else what stands there; without a cue the name behind "scholarship in" and the like, else the
    longest name in the title and the first three lines. `allowed` takes the capitalised words behind its cue: two names or more and nothing else, or none at
    all; groups stand for their members. `excluded` takes the countries among them. Scope is worldwide-ish or null. Null and empty texts state nothing.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    lead = F.concat_ws(" ", *([F.col(title)] if title else []), F.replace(F.substring_index(t, "\n", HEAD_LINES), F.lit("\n"), F.lit(" ")))
    asked = lambda c: c if known is None else F.when(known, None).otherwise(c)
    df = df.withColumns({"_host": asked(stretch(t, HOST_CUES)), "_award": asked(stretch(F.substring_index(t, "\n", 6), AWARD_CUES)), "_head": asked(F.substring(lead, 1, HEAD_CHARS)),
                         "_open": list_words(stretch(t, OPEN_CUES, r"(?<!not )")), "_closed": list_words(stretch(t, CLOSED_CUES))})
    single = lambda xs: F.filter(xs, lambda x: ~x["of_many"])
    first = lambda c: F.get(F.filter(single(met_names(words(c))), lambda x: x["at"] <= 2), F.lit(0))["name"]
    bare = lambda c: F.when(c.rlike(r"\p{L}"), F.btrim(F.regexp_replace(F.element_at(F.split(c, r"\s{2,}"), 1), r"(?i)\s*\b(?:for|intended for|and other)\s+(?:international|developing|all|non)\b.*$", ""), F.lit(" .,:-")))
    longest = F.array_max(F.transform(single(met_names(words(F.col("_head")))), lambda x: F.struct(x["long"].alias("long"), (-x["at"]).alias("at"), x["name"].alias("name"))))["name"]
    host, award = F.col("_host"), F.col("_award")
    country = F.coalesce(F.when(host.isNotNull(), F.coalesce(first(host), F.substring(bare(host), 1, 70))), F.when(award.isNotNull(), F.coalesce(first(award), F.when(award.rlike(r"^\p{Lu}"), F.substring(bare(award), 1, 70)))), longest)

    def listed(xs: Column, w: Column) -> Column:
        # all capitalised words must be covered by names
        capitals = F.filter(F.transform(w, lambda x, i: F.when(x.rlike(r"^\p{Lu}"), i + 1)), lambda i: i.isNotNull())
        covered = F.forall(capitals, lambda i: F.exists(xs, lambda x: i.between(x["at"], x["end"])))
        every = F.flatten(F.transform(xs, lambda x: F.when(x["of_many"], F.coalesce(countries.members(x["name"]), F.array().cast("array<string>"))).otherwise(F.array(x["name"]))))
        return F.when((F.size(xs) >= 2) & covered, F.array_distinct(every)).otherwise(F.array().cast("array<string>"))

    everyone = facts.bound(facts.spaced(t), lambda w: facts.says(w, EVERYONE))
    return df, {"country": country, "allowed": facts.bound(met_names(F.col("_open")), lambda xs: listed(xs, F.col("_open"))),
                "excluded": F.array_distinct(F.transform(single(met_names(F.col("_closed"))), lambda x: x["name"])), "scope": F.when(everyone, "worldwide-ish")}


def stated_countries(df: DataFrame, key: str = "id", text: str = "text", title: str | None = None) -> DataFrame:
    """One row per row of `df`: `key`, country, allowed, excluded, scope, as of `stated`."""
    made, said = stated(df, text, title)
    return made.select(key, *[c.alias(k) for k, c in said.items()])
