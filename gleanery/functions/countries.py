"""Names of countries and of groups of countries, as native expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Other names of countries; every name below is an alias of itself.
ALIASES = {
    "usa": "United States", "u.s.": "United States", "u.s.a.": "United States", "united states of america": "United States", "america": "United States",
    "us": "United States", "uk": "United Kingdom", "u.k.": "United Kingdom", "great britain": "United Kingdom", "england": "United Kingdom",
    "wales": "United Kingdom", "scotland": "United Kingdom", "northern ireland": "United Kingdom", "russian federation": "Russia", "korea": "South Korea",
    "republic of korea": "South Korea", "korea (south)": "South Korea", "viet nam": "Vietnam", "islamic republic of iran": "Iran",
    "syrian arab republic": "Syria", "turkiye": "Türkiye", "turkey": "Türkiye", "czech republic": "Czechia", "burma": "Myanmar", "swaziland": "Eswatini",
    "united republic of tanzania": "Tanzania", "rsa": "South Africa", "islamic republic of pakistan": "Pakistan", "republic of india": "India",
    "the netherlands": "Netherlands", "holland": "Netherlands", "deutschland": "Germany", "prc": "China", "uae": "United Arab Emirates",
    "west bank": "Palestine", "gaza": "Palestine",
}
#: Groups and their members, in the order in which they are tried.
EU = ("Austria", "Belgium", "Bulgaria", "Croatia", "Cyprus", "Czechia", "Denmark", "Estonia", "Finland", "France", "Germany", "Greece", "Hungary", "Ireland", "Italy",
      "Latvia", "Lithuania", "Luxembourg", "Malta", "Netherlands", "Poland", "Portugal", "Romania", "Slovakia", "Slovenia", "Spain", "Sweden", "Iceland",
      "Liechtenstein", "Norway")
NORDIC = ("Sweden", "Norway", "Denmark", "Finland", "Iceland")
COMMONWEALTH = ("United Kingdom", "India", "Pakistan", "Bangladesh", "Sri Lanka", "Nepal", "Maldives", "Nigeria", "Ghana", "Kenya", "Uganda", "Tanzania", "Zambia",
                "Zimbabwe", "Malawi", "Mozambique", "Namibia", "Botswana", "Lesotho", "Eswatini", "South Africa", "Cameroon", "Rwanda", "Sierra Leone", "Liberia",
                "Gambia", "Australia", "New Zealand", "Canada", "Ireland", "Cyprus", "Malta", "Fiji", "Samoa", "Tonga", "Vanuatu", "Solomon Islands",
                "Papua New Guinea", "Jamaica", "Trinidad and Tobago", "Barbados", "Guyana", "Bahamas", "Belize", "Brunei", "Singapore", "Montserrat")
OIC = ("Pakistan", "Bangladesh", "Indonesia", "Malaysia", "Türkiye", "Saudi Arabia", "UAE", "Qatar", "Kuwait", "Oman", "Bahrain", "Jordan", "Lebanon", "Syria",
       "Iraq", "Egypt", "Morocco", "Algeria", "Tunisia", "Libya", "Sudan", "Somalia", "Djibouti", "Comoros", "Senegal", "Gambia", "Guinea", "Sierra Leone",
       "Mali", "Niger", "Nigeria", "Chad", "Cameroon", "Gabon", "Azerbaijan", "Kazakhstan", "Uzbekistan", "Turkmenistan", "Kyrgyzstan", "Tajikistan",
       "Afghanistan", "Iran", "Palestine", "Yemen", "Brunei", "Maldives", "Albania", "Turkey")
DEVELOPING = ("Pakistan", "India", "Bangladesh", "Sri Lanka", "Nepal", "Afghanistan", "Myanmar", "Cambodia", "Laos", "Vietnam", "Philippines", "Indonesia",
              "Timor-Leste", "Papua New Guinea", "Fiji", "Samoa", "Tonga", "Vanuatu", "Solomon Islands", "Nigeria", "Ghana", "Kenya", "Uganda", "Tanzania",
              "Ethiopia", "Rwanda", "Zambia", "Zimbabwe", "Malawi", "Mozambique", "Namibia", "Botswana", "Lesotho", "Eswatini", "South Africa", "Cameroon",
              "Senegal", "Gambia", "Sierra Leone", "Liberia", "Mali", "Niger", "Chad", "Burkina Faso", "Guinea", "Egypt", "Morocco", "Tunisia", "Algeria",
              "Libya", "Sudan", "Somalia", "Jordan", "Lebanon", "Syria", "Iraq", "Yemen", "Palestine", "Iran", "Brazil", "Mexico", "Argentina", "Chile",
              "Colombia", "Peru", "Venezuela", "Ecuador", "Bolivia", "Paraguay", "Uruguay", "Costa Rica", "Panama", "Cuba", "Jamaica", "Haiti",
              "Dominican Republic", "Trinidad and Tobago", "Guyana", "Suriname", "China", "Mongolia", "Uzbekistan", "Kazakhstan", "Kyrgyzstan", "Tajikistan",
              "Turkmenistan", "Azerbaijan", "Georgia", "Armenia", "Moldova", "Ukraine", "Belarus", "Albania", "Bosnia and Herzegovina", "North Macedonia",
              "Serbia", "Montenegro", "Kosovo", "Thailand", "Malaysia", "Bhutan", "Maldives")
EUROPE = (*EU, "United Kingdom", "Switzerland", "Ukraine", "Belarus", "Moldova", "Serbia", "Bosnia and Herzegovina", "Albania", "North Macedonia", "Montenegro",
          "Russia", "Turkey", "Georgia", "Armenia", "Azerbaijan")
ASEAN = ("Indonesia", "Malaysia", "Thailand", "Vietnam", "Philippines", "Singapore", "Myanmar", "Cambodia", "Laos", "Brunei")
SOUTH_ASIA = ("India", "Pakistan", "Bangladesh", "Sri Lanka", "Nepal", "Bhutan", "Maldives", "Afghanistan")
ARAB = ("Egypt", "Morocco", "Algeria", "Tunisia", "Libya", "Sudan", "Jordan", "Lebanon", "Syria", "Iraq", "Yemen", "Palestine", "Saudi Arabia", "UAE", "Qatar",
        "Kuwait", "Oman", "Bahrain", "Somalia", "Djibouti", "Comoros", "Mauritania")
LATIN = ("Brazil", "Mexico", "Argentina", "Chile", "Colombia", "Peru", "Venezuela", "Ecuador", "Bolivia", "Paraguay", "Uruguay", "Costa Rica", "Panama", "Cuba",
         "Jamaica", "Dominican Republic", "Trinidad and Tobago", "Guyana", "Suriname", "Haiti")
CARIBBEAN = ("Cuba", "Jamaica", "Trinidad and Tobago", "Barbados", "Bahamas", "Belize", "Guyana", "Suriname", "Dominican Republic", "Haiti")
PACIFIC = ("Fiji", "Samoa", "Tonga", "Vanuatu", "Solomon Islands", "Papua New Guinea", "Kiribati", "Nauru", "Tuvalu", "Palau", "Marshall Islands", "Micronesia")
GROUPS = {
    "eu": EU, "european union": EU, "eea": EU, "europe": EUROPE, "commonwealth": COMMONWEALTH, "oic": OIC, "developing": DEVELOPING, "nordic": NORDIC,
    "scandinavia": NORDIC, "asean": ASEAN, "south asia": SOUTH_ASIA, "arab": ARAB, "latin america": LATIN, "caribbean": CARIBBEAN, "pacific islands": PACIFIC,
    "worldwide": (), "world": (), "global": (), "international": (), "all countries": (), "any": (), "every country": (), "all": (),
}
#: Words that stay small inside a name, and names that are in no group.
SMALL = ("de", "del", "la", "le", "du", "d'", "van", "von", "of", "and", "the", "is", "di", "da")
OTHERS = ("United States", "North Korea", "South Korea", "Japan", "United Arab Emirates", "South Sudan", "Mauritius", "Andorra", "Monaco", "San Marino")
KNOWN = {n.lower(): n for names in (*GROUPS.values(), OTHERS) for n in names if n not in ("UAE", "Turkey")} | {n.lower(): n for n in ALIASES.values()}


#: What may stand before a name.
LEAD = r"(?i)^(?:(?:study in|study at|located in|in|at|the)\b[\s:]*)+"
NAME_OF = {re.sub(r"[^\w ]+", "", k): n for k, n in (KNOWN | ALIASES).items()}


def usual(name: str | None) -> str | None:
    """`canon` of one name, for the driver."""
    bare = re.sub(LEAD, "", " ".join((name or "").split())).strip(" .,;:*")
    if not bare:
        return None
    found = NAME_OF.get(" ".join(re.sub(r"[^\w ]+", "", name.lower()).split())) or NAME_OF.get(" ".join(re.sub(r"[^\w ]+", "", bare.lower()).split()))
    if found or (bare == bare.upper() and len(bare) <= 6):
        return found or bare
    return " ".join(w.lower() if i and w.lower() in SMALL else w[:1].upper() + w[1:].lower() for i, w in enumerate(bare.split()))


def canon(name: Column) -> Column:
    """The usual name of a country: looked up without marks, as it is or without a lead-in, else the name itself without one, each word capitalised but
    small ones inside; capitals of six letters or fewer stay. Null for null, and for a name of which nothing is left."""
    names = F.create_map(*[F.lit(x) for pair in NAME_OF.items() for x in pair])
    key = lambda t: F.trim(F.regexp_replace(F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_ ]+", ""), r"\s+", " "))
    bare = F.btrim(F.regexp_replace(F.regexp_replace(F.trim(name), r"\s+", " "), LEAD, ""), F.lit(" .,;:*"))
    words = F.transform(F.split(bare, " "), lambda w, i: F.when((i > 0) & F.lower(w).isin(*SMALL), F.lower(w)).otherwise(F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 200)))))
    found = F.coalesce(F.try_element_at(names, key(name)), F.try_element_at(names, key(bare)))
    return F.when(bare != "", F.coalesce(found, F.when((F.upper(bare) == bare) & (F.length(bare) <= 6), bare), F.array_join(words, " ")))


def group_of(name: Column) -> Column:
    """The first group whose name the text is or holds (letters and spaces alone count); null if there is none. As the probe has
    neither marks nor digits, 'sub-saharan africa', 'low-income' and 'g20' name no group."""
    key = F.trim(F.regexp_replace(F.lower(F.trim(name)), "[^a-z ]+", ""))
    return F.coalesce(*[F.when(F.contains(key, F.lit(g)), F.lit(g)) for g in GROUPS])


def members(group: Column) -> Column:
    """The members of a group of GROUPS, none for one that means everyone; null for null."""
    return F.try_element_at(F.create_map(*[x for g, m in GROUPS.items() for x in (F.lit(g), F.array(*map(F.lit, m)).cast("array<string>"))]), group)


def resolved(items: Column) -> Column:
    """A list of countries and groups as struct<allowed: array or null for everyone, scope>: unknown for no items, worldwide if
    nobody is named, group:NAME of the first group, else list."""
    groups = F.filter(F.transform(items, group_of), lambda g: g.isNotNull())
    named = F.transform(F.filter(items, lambda x: group_of(x).isNull()), canon)
    allowed = F.array_sort(F.array_distinct(F.array_compact(F.concat(F.flatten(F.transform(groups, members)), named))))
    scope = (F.when(F.coalesce(F.size(items), F.lit(0)) <= 0, "unknown").when(F.size(allowed) == 0, "worldwide")
             .when(F.size(groups) > 0, F.concat(F.lit("group:"), F.try_element_at(groups, F.lit(1)))).otherwise("list"))
    return F.struct(F.when(F.size(allowed) > 0, allowed).alias("allowed"), scope.alias("scope"))
