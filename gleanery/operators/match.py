"""Hard gates, the explainable weighted score, confidence, urgency and tiers, for one profile."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import countries, notices

#: Weights of the score's components and lower bounds of the tiers.
WEIGHTS = {"country": 22, "field": 16, "funding": 18, "amount": 12, "degree": 10, "competition": 8, "english_ready": 6, "research": 8}
TIERS = {"must_apply": 78, "strong": 62, "worth_a_look": 45}
#: Words that stand for a named field of study.
FIELD_WORDS = {
    "AI": ("ai", "artificial intelligence"), "Machine Learning": ("machine learning", "ml"), "NLP": ("nlp", "natural language"),
    "Deep Learning": ("deep learning",), "Computer Science": ("computer science", "computing", "software"), "Data Science": ("data science", "data"),
    "Robotics": ("robotic",), "Cybersecurity": ("security", "cyber"),
}


@dataclass(frozen=True)
class Profile:
    """What gates and score are evaluated for."""

    home_country: str | None = "NATION_3"
    degree: str = "Master"
    gpa: float | None = 3.5
    gpa_scale: float = 4.0
    ielts: float | None = 7.5
    toefl: int | None = 100
    gre: float | None = None
    age: int | None = 24
    experience: float = 1.5
    graduation_year: int | None = 1995
    fields: tuple[str, ...] = ("Data Science", "Machine Learning")
    exclude_fields: tuple[str, ...] = ("law",)
    preferred: tuple[str, ...] = ("NATION_5", "NATION_7", "NATION_11")
    blocked: tuple[str, ...] = ("NATION_9",)
    needs_full_funding: bool = True
    min_award: float = 12000.0
    max_fee: float = 50.0
    budget: float = 25000.0
    apply_window: int = 240
    has_research: bool = True
    publications: int = 3
    weights: dict = field(default_factory=lambda: dict(WEIGHTS))
    tiers: dict = field(default_factory=lambda: dict(TIERS))


def rounded(x: Column, n: int = 2) -> Column:
    """Half up, with a margin that absorbs the last bits of binary fractions."""
    return F.floor(x * 10.0**n + 0.5000001) / 10.0**n


def days_left(deadline: Column, as_of: str) -> Column:
    """Whole days until the deadline, rounded down, also below zero."""
    return F.floor(F.timestamp_diff("SECOND", F.lit(as_of).cast("timestamp_ntz"), deadline) / 86400).cast("int")


def members(csv: str) -> Column:
    """The trimmed, non-empty parts of a comma-separated column."""
    return F.expr(f"filter(transform(split({csv}, ','), x -> trim(x)), x -> x <> '')")


def scale_of(value: Column) -> Column:
    """A grade scale out of prose: its first number if it lies between 1 and 10, else 4."""
    x = F.regexp_extract(F.coalesce(value, F.lit("")), r"([0-9]+(?:\.[0-9]+)?)", 1).try_cast("double")
    return F.when(x.between(1, 10), x).otherwise(4.0)


def gates(p: Profile, as_of: str) -> list[tuple[str, bool, Column]]:
    """(name, hard, fails) of each rule; a null means that it can't be decided and passes. `allowed_set` and `excluded_set` are as of
    `with_country_sets`."""
    home = F.lit(countries.usual(p.home_country))
    allowed, excluded = F.col("allowed_set"), F.col("excluded_set")
    degrees, wanted = F.lower("degree_level"), p.degree.lower()
    funding, days = F.lower("funding_type"), days_left(F.col("deadline"), as_of)
    scale = scale_of(F.col("gpa_scale"))
    is_excluded = F.coalesce(F.array_contains(excluded, home), F.lit(False))
    return [
        ("excluded", True, is_excluded),
        ("not_listed", True, ~is_excluded & (F.size(allowed) > 0) & ~F.array_contains(allowed, home)),
        ("list_unclear", False, ~is_excluded & F.col("eligible").isNull() & (F.size(excluded) > 0)),
        ("blocked", True, F.col("country").isin(*p.blocked) if p.blocked else F.lit(False)),
        ("degree", True, ~F.arrays_overlap(F.split(degrees, ","), F.array(*[F.lit(x) for x in (wanted, "any", "all")]))),
        ("degree_unknown", False, F.col("degree_level").isNull()),
        ("funding_short", False, F.lit(p.needs_full_funding) & funding.isin("partial", "tuition-only") & (F.coalesce("amount_usd", F.lit(0.0)) < max(p.min_award, 1.0))),
        ("fee", False, F.col("application_fee_usd") > p.max_fee),
        ("tuition_only", False, F.lit(bool(p.budget)) & (funding == "tuition-only") & (F.coalesce("amount_usd", F.lit(0.0)) <= 0)),
        ("gpa", True, F.when(F.abs(scale - p.gpa_scale) < 0.01, F.lit(p.gpa)).otherwise(F.lit(p.gpa) * scale / p.gpa_scale) + 1e-9 < F.col("min_gpa")),
        ("ielts", True, F.lit(p.ielts) + 1e-9 < F.col("min_ielts")),
        ("toefl", True, F.lit(p.toefl) < F.col("min_toefl")),
        ("age", True, F.lit(p.age) > F.col("max_age")),
        ("experience", True, F.lit(p.experience) + 1e-9 < F.col("min_work_experience_years")),
        ("degree_age", True, F.year(F.lit(as_of).cast("timestamp_ntz")) - F.lit(p.graduation_year) > F.col("max_years_since_degree")),
        ("gre", False, F.col("requires_gre") & F.lit(p.gre).isNull()),
        ("past", True, days < 0),
        ("far_out", False, days > p.apply_window),
        ("no_deadline", False, F.col("deadline").isNull() & ~F.coalesce("deadline_rolling", F.lit(False))),
    ]


def with_country_sets(df: DataFrame) -> DataFrame:
    """Adds allowed_set, the usual names of the countries to which `eligible` restricts (null: no restriction; groups stand for their members, lists of
    prose restrict nobody), and excluded_set. Each list that occurs is resolved once and met again by an equi-join; where they are few, as lists mostly are,
    adaptive execution broadcasts them."""
    for column, name, sets in (("eligible", "allowed_set", notices.gating_countries), ("excluded", "excluded_set", notices.excluded_countries)):
        once = df.select(F.col(column).alias("_list")).where("_list IS NOT NULL").distinct().withColumn(name, sets(members("_list")))
        df = df.join(once, F.col(column) == F.col("_list"), "left").drop("_list")
    return df


def with_gates(df: DataFrame, p: Profile, as_of: str) -> DataFrame:
    """Adds gate_pass (boolean), reasons and warnings (arrays of rule names)."""
    rules, df = gates(p, as_of), with_country_sets(df)
    named = lambda hard: F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, h, c in rules if h == hard]))
    return df.withColumn("reasons", named(True)).withColumn("warnings", named(False)).withColumn("gate_pass", F.size("reasons") == 0).drop("allowed_set", "excluded_set")


def components(p: Profile) -> dict[str, Column]:
    """The eight parts of the score."""
    w, text, funding = p.weights, F.lower("field"), F.lower("funding_type")
    tokens = [t for f in p.fields for t in (*FIELD_WORDS.get(f, ()), f.lower())]
    any_of = lambda col, words: F.coalesce(F.greatest(*[F.contains(col, F.lit(x)) for x in (*words, words[0])]), F.lit(False)) if words else F.lit(False)
    field_part = (F.when(any_of(text, p.exclude_fields), 0.0).when(text.isNull(), 0.4).when(any_of(text, tokens), 1.0).when(text.contains("any"), 0.85)
                  .when(any_of(text, ("stem", "engineering", "comput", "science")), 0.5).otherwise(0.05))
    amount = F.coalesce("amount_usd", F.lit(0.0))
    full = F.coalesce(funding == "full", F.lit(False))
    research = F.lit(p.has_research) & (F.concat(F.coalesce("description", F.lit("")), F.coalesce("field", F.lit(""))).rlike("(?i)research|thesis|phd|publication"))
    aligned = F.when(research, 0.8).otherwise(0.0) + F.when(F.lit(p.publications >= 3) & full, 0.2).otherwise(0.0)
    parts = {
        "country": F.when(F.col("country").isin(*p.preferred), 1.0).when(F.col("country").isNotNull(), 0.25).otherwise(0.4),
        "field": field_part,
        "funding": F.when(funding == "full", 1.0).when(funding == "tuition-only", 0.45).when(funding == "partial", 0.35).otherwise(0.2),
        "amount": F.when(amount > 0, 0.35 + 0.65 * F.least(F.lit(1.0), amount / max(p.budget or 25000.0, 1.0))).when(full, 0.8).otherwise(0.3),
        "degree": F.when(F.col("degree_level").isNull() | F.lower("degree_level").contains("any"), 0.9).when(F.array_contains(F.split(F.lower("degree_level"), ","), p.degree.lower()), 1.0).otherwise(0.2),
        "competition": F.when(F.col("n_awards") < 30, 0.35).when(F.col("n_awards") < 200, 0.65).when(F.col("n_awards").isNotNull(), 0.95).otherwise(0.5),
        "english_ready": F.when(F.col("min_ielts").isNull() & F.col("min_toefl").isNull(), 1.0).when(F.lit(p.ielts) >= F.col("min_ielts") + 0.5, 0.85).otherwise(0.4),
        "research": F.when(aligned > 0, F.least(F.lit(1.0), aligned)).otherwise(0.3),
    }
    return {k: c * float(w[k]) for k, c in parts.items()}


def confidence() -> Column:
    """How much of a row is filled, between 0.2 and 1."""
    has = lambda c: F.coalesce(c != "", F.lit(False)).cast("int")
    deadline = (F.col("deadline").isNotNull() | F.coalesce("deadline_rolling", F.lit(False))).cast("int")
    share = (has(F.col("title")) + deadline + has(F.col("country")) + has(F.col("degree_level")) + has(F.col("funding_type"))) / 5.0
    method = F.coalesce("parse_method", F.lit(""))
    bonus = 0.06 * has(F.col("amount_text")) + 0.06 * has(F.col("eligibility")) + 0.04 * has(F.col("field"))
    bonus = bonus + F.when(method.contains("regex") & (share >= 1.0), 0.08).when(method.isin("", "none"), -0.05).otherwise(0.0)
    return rounded(F.least(F.lit(1.0), F.greatest(F.lit(0.2), 0.45 + 0.45 * share + bonus)), 3)


def urgency(days: Column) -> Column:
    """The factor by which a near deadline lifts a score."""
    return F.when(days.isNull() | (days < 0), 1.0).when(days <= 14, 1.12).when(days <= 45, 1.05).when(days > 240, 0.97).otherwise(1.0)


def evaluate(df: DataFrame, p: Profile, as_of: str) -> DataFrame:
    """Adds gates, days_left, breakdown (map), confidence, score and tier. A null component counts as unknown; rows that fail
    a hard gate score at most 40 and are ineligible. One projection, after the joins of `with_country_sets`.

    The session's constraint inference is switched off: over so many derived columns its time grows exponentially.
    """
    df.sparkSession.conf.set("spark.sql.constraintPropagation.enabled", "false")
    parts = components(p)
    out = with_gates(df, p, as_of).withColumn("days_left", days_left(F.col("deadline"), as_of)).withColumn("confidence", confidence())
    out = out.withColumns({f"part_{k}": c for k, c in parts.items()})
    raw = rounded(sum((F.col(f"part_{k}") for k in parts), F.lit(0.0)))
    out = out.withColumn("raw", raw)
    lifted = rounded(F.least(F.lit(100.0), rounded(F.col("raw") * (0.7 + 0.3 * F.col("confidence"))) * urgency(F.col("days_left"))))
    out = out.withColumn("score", F.when(F.col("gate_pass"), lifted).otherwise(rounded(F.least(F.lit(40.0), F.col("raw") * 0.4))))
    tier = F.when(~F.col("gate_pass"), "ineligible")
    for name, least in sorted(p.tiers.items(), key=lambda x: -x[1]):
        tier = tier.when(F.col("score") >= least, name)
    out = out.withColumn("tier", tier.otherwise("low"))
    return out.withColumn("breakdown", F.create_map(*[x for k in parts for x in (F.lit(k), rounded(F.col(f"part_{k}")))])).drop(*[f"part_{k}" for k in parts])


def shortlist(scored: DataFrame, least: float = 45.0) -> DataFrame:
    """Rows that pass, score enough and are not past; order by score, then deadline."""
    return scored.where(F.col("gate_pass") & (F.col("score") >= least) & (F.col("days_left").isNull() | (F.col("days_left") >= 0)))
