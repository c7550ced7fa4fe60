"""Fit scores with explanations and gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import listing, places, text
from .dedupe import first_of_each, with_order
from .screening import disliked

SCORER = "local_rule_based"


def preference_terms(preference: str) -> list[str]:
    return [t for t in preference.lower().replace("-", " ").split() if len(t) > 3 and t not in L.PREFERENCE_STOPWORDS]


def preferences_in(body: Column, preferences: list[str]) -> Column:
    """The preferences of which any term occurs in a text, in their order."""
    from ..functions.urls import contains_any

    hits = [F.when(contains_any(body, preference_terms(p)), F.lit(p)) for p in preferences]
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def scored(
    filtered: DataFrame, sources: DataFrame, likes: list[str], industries: list[str], dislikes: list[str], markers: list[str]
) -> DataFrame:
    """Included postings with score, fit level, explanations and gaps, best first.

    The score: 35; 15 each for an internship and for 2027; 3 for each matched
    preference up to 15; 10 for a connection; 35 less for a disliked term;
    within 0..100. The connection is the company's first source's.
    """
    details = F.coalesce(F.col("eligibility_text"), F.lit(""))
    rows = filtered.where(F.col("included") & (F.size(disliked(F.col("title"), dislikes)) == 0)
                          & places.allowed(F.col("location"), F.col("title"), details, markers))
    known = first_of_each(with_order(sources), "company").select("company", F.col("has_connection").alias("_link"))
    rows = rows.join(known, "company", "left").withColumn("_text", F.lower(F.concat_ws(
        " ", "title", "company", "location", "posting_url", F.array_join("reasons", " ")
    )))
    rows = rows.withColumns({"_likes": preferences_in(F.col("_text"), likes + industries), "_not": preferences_in(F.col("_text"), dislikes)})
    intern, year = F.col("_text").contains("intern"), F.col("_text").contains("2027")
    linked, bad, good = F.coalesce("_link", F.lit(False)), F.size("_not") > 0, F.size("_likes") > 0
    points = lambda condition, n: F.when(condition, F.lit(n)).otherwise(F.lit(0))
    total = 35 + points(intern, 15) + points(year, 15) + F.least(F.lit(15), 3 * F.size("_likes")) + points(linked, 10) - points(bad, 35)
    rows = listing.with_generic_reason(rows, F.col("title"), F.col("posting_url"), "_general")
    general = F.col("_general").isNotNull()
    said = F.array_compact(F.array(
        F.when(intern, F.lit("Role appears internship-related.")),
        F.when(year, F.lit("Role explicitly mentions 2027.")),
        F.when(good, F.concat(F.lit("Matches preferences: "), F.array_join(F.slice("_likes", 1, 5), ", "), F.lit("."))),
        F.when(linked, F.lit("Company has a known connection.")),
        F.when(bad, F.concat(F.lit("Penalized disliked terms: "), F.array_join("_not", ", "), F.lit("."))),
    ))
    gaps = F.array_compact(F.array(
        F.when(~year, F.lit("Does not explicitly mention Summer 2027.")),
        F.when(F.col("location") == "Unknown", F.lit("Location is unknown.")),
        F.when(general, F.lit("Looks like a general program page rather than a specific open role.")),
    ))
    rows = rows.withColumns({
        "score": F.greatest(F.lit(0), F.least(F.lit(100), total)).cast("int"), "provider": F.lit(SCORER),
        "explanations": F.when(F.size(said) > 0, said).otherwise(F.array(F.lit("Limited information available for scoring."))),
        "gaps": gaps,
    })
    return rows.withColumn("fit_level", text.fit_level(F.col("score"))).select(
        "title", "company", "location", "posting_url", "date_collected", "source_url", "score", "fit_level", "provider",
        "explanations", "gaps",
    ).orderBy(F.desc("score"), "company", "title")


def is_recommended(score: Column, level: Column) -> Column:
    return (score >= L.RECOMMENDED_SCORE) & (F.lower(level) != "weak")


def usage_totals(usage: DataFrame) -> DataFrame:
    """Summed tokens of model calls."""
    return usage.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("prompt_tokens", "output_tokens", "total_tokens")))


def parsed_response(raw: Column) -> Column:
    """A model's JSON answer as struct(score, fit_level, explanations, gaps); null if unusable."""
    body = F.regexp_replace(F.trim(raw), r"(?s)^```(?:json)?\s*|\s*```$", "")
    answer = F.from_json(body, "score int, fit_level string, explanations array<string>, gaps array<string>")
    level = F.lower(answer["fit_level"])
    level = F.when(level.isin("strong", "medium", "weak"), level).otherwise(text.fit_level(answer["score"]))
    none = F.array().cast("array<string>")
    return F.when(answer["score"].between(0, 100), F.struct(
        answer["score"].alias("score"), level.alias("fit_level"), F.coalesce(answer["explanations"], none).alias("explanations"),
        F.coalesce(answer["gaps"], none).alias("gaps"),
    ))
