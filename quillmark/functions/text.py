"""Text functions over columns: cleaning, keys, summaries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .urls import contains_any, first_contained, let

SPACE = r"(?U)\s+"


def clean_text(text: Column) -> Column:
    """White space collapsed."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def clean_title(title: Column) -> Column:
    tidy = clean_text(title)
    return F.when(tidy == "", F.lit("Untitled posting")).otherwise(tidy)


def normalized(text: Column) -> Column:
    """Lower case, white space collapsed: names and titles."""
    return clean_text(F.lower(text))


def role_text(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def role_key(company: Column, title: Column, location: Column) -> Column:
    place = F.when(location == "Unknown", F.lit("")).otherwise(location)
    return F.concat_ws("|", role_text(company), role_text(title), role_text(place))


def content_hash(title: Column, company: Column, location: Column, posting_id: Column, source_url: Column) -> Column:
    """A digest of what counts as a posting's content; eligibility and date don't.

    ``posting_id`` is the address in its canonical form.
    """
    return F.sha2(F.to_json(F.struct(
        company.alias("company"), location.alias("location"), posting_id.alias("posting_url"),
        source_url.alias("source_url"), title.alias("title"),
    )), 256)


def strip_tags(html: Column) -> Column:
    return F.regexp_replace(html, "<[^>]+>", " ")


def location_list(text: Column) -> Column:
    """Places of a list in order, once each whatever their case, joined by `` | ``."""
    tidy = F.regexp_replace(text, r"(?i)\+\s*\d+\s+offices?", "|")
    tidy = F.regexp_replace(tidy, r"(?i)\b(?:Show less|See More)\b", "")
    pieces = F.transform(F.split(tidy, r"\s*\|\s*|\s{2,}|\n+"), lambda p: F.btrim(clean_text(p), F.lit(" ,;|")))
    pieces = F.filter(pieces, lambda p: p != "")
    first = F.array_distinct(F.transform(pieces, lambda p: F.lower(p)))
    kept = F.transform(first, lambda low: F.element_at(F.filter(pieces, lambda p: F.lower(p) == low), 1))
    return F.when(F.size(kept) > 0, F.array_join(kept, " | ")).otherwise(F.lit("Unknown"))


def deadline(text: Column) -> Column:
    """The first date after or before a deadline word, in title case; else null."""
    low = F.lower(text)
    found = [F.regexp_extract(low, p, 1) for p in L.DEADLINE_PATTERNS]
    return F.coalesce(*(F.when(f != "", F.initcap(F.trim(f))) for f in found))


def season(title: Column) -> Column:
    found = F.regexp_extract(F.lower(title), r"\b(summer|fall|spring|winter)?\s*(202\d)\b", 0)
    return F.when(found != "", F.initcap(F.trim(found)))


def summary_text(values: Column, fallback: str, most: int = 280) -> Column:
    """At most two sentences and ``most`` characters of an array of texts."""
    tidy = F.trim(F.array_join(F.filter(F.transform(values, clean_text), lambda v: v != ""), " "))

    def cut(text: Column) -> Column:
        short = F.substring(text, 1, most - 3)
        short = F.when(short.contains(" "), F.regexp_replace(short, r"(?s) [^ ]*$", "")).otherwise(short)
        short = F.regexp_replace(short, "[ ,;:]+$", "")
        return F.when(short != "", F.concat(short, F.lit("..."))).otherwise(F.lit(fallback))

    def shown(text: Column) -> Column:
        first = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+", 3), F.trim), lambda s: s != "")
        pair = F.struct(F.try_element_at(first, F.lit(1)).alias("one"), F.concat_ws(" ", F.try_element_at(first, F.lit(1)), F.try_element_at(first, F.lit(2))).alias("two"))
        best = let(pair, lambda p: F.when(F.length(p["two"]) <= most, p["two"]).when(F.length(p["one"]) <= most, p["one"]))
        return F.when(text == "", F.lit(fallback)).otherwise(F.coalesce(best, cut(text)))

    return let(tidy, shown)


def is_diagnostic(text: Column) -> Column:
    return contains_any(F.lower(text), L.DIAGNOSTIC_MARKERS)


def explanation_text(explanations: Column) -> Column:
    readable = F.filter(explanations, lambda e: ~is_diagnostic(e))
    return summary_text(readable, "Matched the internship and location requirements; review the posting for details.")


def review_status(status: Column) -> Column:
    low = F.lower(F.trim(status))
    return (
        F.when(low.isin("", "interested", "needs_follow_up"), F.lit("to_review"))
        .when(low == "ignored", F.lit("not_interested")).otherwise(low)
    )


def activity_type(action: Column) -> Column:
    pairs = [F.lit(x) for pair in L.ACTIVITY_TYPES.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.trim(F.coalesce(action, F.lit("")))), F.lit("other"))


def fit_level(score: Column) -> Column:
    return F.when(score >= 75, F.lit("strong")).when(score >= 50, F.lit("medium")).otherwise(F.lit("weak"))


def company_of_query(query: Column) -> Column:
    return F.trim(F.regexp_replace(query, r"(?i)\s+summer\s+\d{4}\s+internship\s+careers\s*$", ""))


def appended_note(existing: Column, addition: Column) -> Column:
    return (
        F.when(F.coalesce(existing, F.lit("")) == "", addition).when(existing.contains(addition), existing)
        .otherwise(F.concat_ws(" ", existing, addition))
    )


def query_term(text: Column) -> Column:
    """Lower case with the known misspellings mended."""
    out = F.lower(text)
    for wrong, right in (("finanacial", "financial"), ("arospace", "aerospace"), ("defence", "defense")):
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return out


def interest_terms(text: Column) -> Column:
    """Words of over three letters of an interest, spelling mended."""
    out = F.lower(text)
    for wrong, right in (("finanacial", "financial"), ("aropace", "aerospace"), ("defence", "defense defence"), ("-", " ")):
        out = F.replace(out, F.lit(wrong), F.lit(right))
    return F.filter(F.split(clean_text(out), " "), lambda t: F.length(t) > 3)


def work_arrangement(location: Column, title: Column) -> Column:
    place, role = F.lower(F.coalesce(location, F.lit(""))), F.lower(F.coalesce(title, F.lit("")))
    return (
        F.when(F.trim(place).isin("", "unknown"), F.lit("Unknown"))
        .when(place.contains("remote") | role.contains("remote"), F.lit("Remote"))
        .when(place.contains("hybrid") | role.contains("hybrid"), F.lit("Hybrid"))
        .when(contains_any(place, ["on-site", "onsite", "on site"]), F.lit("On-site")).otherwise(F.lit("Unknown"))
    )


def factual_summary(title: Column, company: Column, location: Column, notes: Column) -> Column:
    """Nine labelled lines of what is known about a posting."""
    known = lambda c: F.when(F.coalesce(c, F.lit("")) == "", F.lit("Unknown")).otherwise(c)
    place = F.when(F.trim(F.coalesce(location, F.lit(""))).isin("", "Unknown", "unknown"), F.lit("Unknown")).otherwise(location)
    program = F.coalesce(F.initcap(first_contained(F.lower(title), L.PROGRAM_KEYWORDS)), F.lit("Unknown"))
    lines = [
        ("Role", known(title)), ("Company", known(company)), ("Location", place), ("Work Arrangement", work_arrangement(location, title)),
        ("Program or Team", program), ("Timing", F.coalesce(season(title), F.lit("Unknown"))),
        ("Responsibilities", F.lit("Unknown (posting body not stored)")), ("Qualifications", F.lit("Unknown (posting body not stored)")),
        ("Application Deadline", F.coalesce(deadline(title), deadline(notes), F.lit("Unknown"))),
    ]
    return F.concat_ws("\n", *(F.concat(F.lit(f"{label}: "), value) for label, value in lines))


def factual_highlights(title: Column, location: Column) -> Column:
    role, place = F.lower(title), F.lower(location)
    general = F.lit("Professional internship program opportunity.")
    kind = (
        F.when(F.coalesce(title, F.lit("")) == "", general)
        .when(contains_any(role, ["software", "engineer", "developer"]), F.lit("Technical role focused on software development / engineering."))
        .when(contains_any(role, ["quant", "trading"]), F.lit("Quantitative role involving modeling, analysis, or financial markets."))
        .when(contains_any(role, ["data", "analyst", "analytics"]), F.lit("Data-centric role focused on analysis, reporting, or statistics."))
        .when(contains_any(role, ["operations", "logistics"]), F.lit("Operations-focused role involving logistics, supply chain, or process optimization."))
        .otherwise(general)
    )
    where = (
        F.when(F.coalesce(location, F.lit("")) == "", F.lit(None).cast("string"))
        .when(place.contains("remote"), F.lit("Fully remote work arrangement option."))
        .when(place.contains("hybrid"), F.lit("Hybrid onsite/offsite model."))
        .when(~F.trim(location).isin("", "Unknown", "unknown"), F.concat(F.lit("Located onsite at "), location, F.lit(".")))
    )
    return F.array_compact(F.array(kind, where))
