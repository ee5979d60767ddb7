"""A whole record out of a listing's text, as native expressions: each field by its own order of precedence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import coerce, dates, facts, identity, labels, money, notices, places
from gleanery.session import dealt

#: The sections of a text, by what heads them.
SECTIONS = {"eligibility": ("eligibility", "who can apply", "requirements"), "benefits": ("benefits", "what the scholarship covers", "value"), "procedure": ("how to apply", "application procedure"),
            "description": ("description", "about", "summary")}
#: Fields that a reader may have read already, typed (`pre`), and that stand before what the text says.
PRE = {"deadline": "date", "country": "string", "degree": "string", "amount_text": "string", "field": "string", "provider": "string"}
OFFICIAL = r"(?i)official (?:website|link|page)\s*:?\s*(https?://[^\s)>\]]+)"


def stated(df: DataFrame, as_of: str, text: str = "text", title: str = "title", pre: str | None = None) -> tuple[DataFrame, dict[str, Column]]:
    """`df` with columns of steps; over these, all fields that its texts state. Steps of which nothing is selected are not computed.

    Of a field the first of these counts that says anything: what the reader read (a struct `pre` with any of PRE), what a label says, what the text says by patterns, which
    are tried only where neither of the others says anything. A field that can't be read is null and costs no row.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    has = df.schema[pre].dataType.names if pre else []
    given = lambda c: F.col(f"{pre}.{c}").cast(PRE[c]) if c in has else F.lit(None).cast(PRE.get(c, "string"))
    met, label = labels.typed_values(df, text, as_of, "_v")
    met, named = places.stated(met, text, title, F.coalesce(given("country"), label["country"]).isNotNull())
    dated = label["deadline"].isNotNull() | (given("deadline").isNotNull() & label["deadline_text"].isNotNull())
    met = met.withColumn("_near", F.when(dated, None).otherwise(dates.nearest(t, as_of)))
    # of several texts in one expression; null and empty ones have no amounts
    texts = F.array(F.when(label["amount_usd"].isNull(), t), *([given("amount_text")] if "amount_text" in has else []))
    met = met.withColumn("_ms", F.transform(texts, lambda x: money.amounts(x))).withColumns({"_m": F.array_max(F.get("_ms", F.lit(0))), "_given": F.array_max(F.get("_ms", F.lit(1)))})
    levelled, open_field = F.coalesce(given("degree"), label["degree"]).isNotNull(), given("field").isNotNull() | F.coalesce(label["field"] == "Any", F.lit(False))
    met = met.withColumns({"_levels": F.when(levelled, "").otherwise(facts.classes(t, facts.DEGREES)), "_covered": facts.classes(t, facts.COVERAGE), "_funding": facts.funding_type(t),
                           "_fields": F.when(open_field, "").otherwise(facts.fields(F.coalesce(label["field"], F.col(title)), t))})
    for name, heads in SECTIONS.items():
        met = met.withColumn(f"_s_{name}", notices.section(t, heads))
    own = lambda c: F.when(label["amount_usd"].isNotNull(), label[c]).otherwise(F.col(f"_m.{c.replace('amount_', '')}"))
    band, points = facts.english(t)
    limits = facts.constraints(t)
    amount = F.col("_given")
    return met, {
        "title": coerce.record_title(F.col(title)), "title_key": identity.normalize_title(F.col(title)),
        "deadline": F.coalesce(given("deadline"), label["deadline"], F.col("_near.d.day")), "deadline_text": F.coalesce(label["deadline_text"], dates.shown(F.col("_near"))),
        "deadline_estimated": F.when(given("deadline").isNotNull(), False).when(label["deadline"].isNotNull(), label["estimated"]).otherwise(~F.col("_near.d.exact")),
        "deadline_rolling": F.coalesce(label["rolling"], F.lit(False)) | dates.rolling(t), "round_label": F.coalesce(label["round_label"], dates.round_label(t)), "intake": F.coalesce(label["intake"], dates.stated_intake(t)),
        "country": F.coalesce(given("country"), label["country"], named["country"]), "eligible_countries": F.coalesce(label["eligible"], named["allowed"]), "excluded_countries": named["excluded"], "scope": named["scope"],
        "degree_level": F.coalesce(given("degree"), label["degree"], F.nullif(F.col("_levels"), F.lit(""))), "field": F.coalesce(given("field"), F.when(label["field"] == "Any", "Any"), F.nullif(F.col("_fields"), F.lit("")), label["field"]),
        "provider": F.coalesce(given("provider"), label["provider"], facts.provider(t)),
        "amount_usd": F.coalesce(amount["usd"], own("amount_usd")), "amount_text": F.coalesce(given("amount_text"), own("amount_text")), "currency": F.coalesce(amount["currency"], own("currency")),
        "application_fee_usd": notices.application_fee(t), "funding_type": F.nullif(F.col("_funding"), F.lit("Unknown")), "coverage": F.nullif(F.col("_covered"), F.lit("")),
        "min_gpa": facts.gpa(t), "min_ielts": F.coalesce(label["min_ielts"], band), "min_toefl": F.coalesce(label["min_toefl"], points),
        "max_age": limits["max_age"], "min_experience": limits["min_experience"], "max_years_since_degree": limits["max_years_since"], "requires_gre": limits["gre"],
        "n_awards": label["n_awards"], "official_url": F.nullif(F.regexp_extract(t, OFFICIAL, 1), F.lit("")), **{k: F.col(f"_s_{k}") for k in SECTIONS},
    }


def extracted(df: DataFrame, as_of: str, key: str = "id", title: str = "title", text: str = "text", pre: str | None = None) -> DataFrame:
    """`df` with a struct `record` of all that its texts state, as of `stated`, and its completeness; `key` deals the rows out, so that the work on texts goes to all
    tasks alike, however few files they come from."""
    met, said = stated(dealt(df, key), as_of, text, title, pre)
    full = notices.completeness(*[F.col(f"record.{c}") for c in ("title", "deadline", "country", "degree_level", "funding_type", "amount_usd")])
    return met.withColumn("record", F.struct(*[c.alias(k) for k, c in said.items()])).withColumn("completeness", full).select(*df.columns, "record", "completeness")
