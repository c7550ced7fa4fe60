"""The main filter: classify, then eligibility, dislikes, location."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import listing, places
from ..functions.stage import settled


def term_root(term: Column) -> Column:
    return (
        F.when(term.isin("tax", "taxes"), F.lit("tax")).when(term.startswith("engineer"), F.lit("engineer"))
        .when(term.endswith("ies") & (F.length(term) > 4), F.concat(F.substring(term, F.lit(1), F.length(term) - 3), F.lit("y")))
        .when(term.endswith("ing") & (F.length(term) > 5), F.substring(term, F.lit(1), F.length(term) - 3))
        .when(term.endswith("s") & (F.length(term) > 4), F.substring(term, F.lit(1), F.length(term) - 1))
        .otherwise(term)
    )


def term_roots(text: Column) -> Column:
    """Distinct roots of a text's meaningful words."""
    words = F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))
    words = F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(L.TITLE_STOPWORDS))
    return F.array_distinct(F.transform(words, term_root))


def disliked(title: Column, dislikes: list[str]) -> Column:
    """The dislikes that share two roots (one, if they have one) with a title."""
    roots = term_roots(title)

    def hit(dislike: str) -> Column:
        own = term_roots(F.lit(dislike))
        need = F.when(F.size(own) == 1, 1).otherwise(2)
        return F.when((F.size(own) > 0) & (F.size(F.array_intersect(roots, own)) >= need), F.lit(dislike))

    return F.array_compact(F.array(*map(hit, dislikes))) if dislikes else F.array().cast("array<string>")


def screened(postings: DataFrame, dislikes: list[str], markers: list[str]) -> DataFrame:
    """Every posting with ``included`` and its ``reasons`` in order.

    The first exclusion decides: not a specific listing, for graduates only, a
    disliked role, a place not allowed. One projection, no shuffle.
    """
    title, place = F.col("title"), F.col("location")
    details = F.coalesce(F.col("eligibility_text"), F.lit(""))
    rows = listing.with_classified(postings, title, F.col("posting_url"), "_c")
    rows = rows.withColumns({
        "_d": disliked(title, dislikes),
        "_g": listing.is_graduate_only(title, details), "_p": places.allowed(place, title, details, markers),
    })
    specific = F.col("_c.is_specific")
    text = F.lower(F.concat_ws(" ", "title", "company", "location", "posting_url", "source_url"))
    years = F.array_compact(F.array(*(F.when(text.contains(t), F.lit(t)) for t in sorted(L.TARGET_YEAR_TERMS))))
    conflict = F.concat(F.lit(f"{L.PREFERENCE_REASON} Matched: "), F.array_join("_d", ", "), F.lit("."))
    ok = specific & ~F.col("_g") & (F.size("_d") == 0) & F.col("_p")
    extra = (
        F.when(~specific, F.lit(None).cast("string")).when(F.col("_g"), F.lit(L.GRADUATE_REASON)).when(F.size("_d") > 0, conflict)
        .when(~F.col("_p"), F.lit(L.LOCATION_REASON))
        .when(F.size(years) > 0, F.concat(F.lit("Mentions target year terms: "), F.array_join(years, ", "), F.lit(".")))
    )
    label = F.concat(F.lit("Listing type: "), listing.category_label(F.col("_c.category")), F.lit("."))
    told = {"included": ok, "reasons": F.array_compact(F.array(label, F.col("_c.reason"), extra))}
    return settled(rows, told).drop("_c", "_d", "_g", "_p")


def excluded_by_type(filtered: DataFrame) -> DataFrame:
    """Excluded postings per listing type, most first."""
    first = F.try_element_at(F.filter("reasons", lambda r: r.startswith("Listing type: ")), F.lit(1))
    label = F.coalesce(F.regexp_replace(F.regexp_replace(first, "^Listing type: ", ""), r"\.$", ""), F.lit("Other"))
    return filtered.where("not included").groupBy(label.alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label")
