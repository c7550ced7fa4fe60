"""Which of two values of a posting's field is better, and what titles and addresses tell."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .text import clean_title, normalized
from .urls import contains_any, greenhouse_board, host, let, lever_board

APPLICATION = r"(?i)^job application for (.+) at (.+)$"


def _low(text: Column) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit(""))))


def missing_company(company: Column) -> Column:
    return (_low(company) == "") | normalized(company).isin(L.MISSING_COMPANIES)


def missing_place(place: Column) -> Column:
    return (_low(place) == "") | normalized(place).isin(L.MISSING_PLACES)


def better_title(current: Column, candidate: Column) -> Column:
    better = (candidate != "") & (
        (current == "") | current.rlike(APPLICATION) | current.startswith("Job Application for")
        | ((F.length(candidate) < F.length(current)) & current.contains(" at "))
    )
    return F.when(better, candidate).otherwise(current)


def better_company(current: Column, candidate: Column) -> Column:
    longer = ~missing_company(candidate) & (current != candidate) & (current != F.initcap(candidate)) & (F.length(candidate) > F.length(current))
    return F.when((candidate != "") & (missing_company(current) | longer), candidate).otherwise(current)


def better_place(current: Column, candidate: Column) -> Column:
    known = ~missing_place(candidate)
    wider = (_low(current) != "") & F.contains(_low(candidate), _low(current)) & (F.length(_low(candidate)) > F.length(_low(current)))
    better = (missing_place(current) & known) | (candidate.contains("|") & ~current.contains("|") & known) | wider
    return F.when(better, candidate).otherwise(current)


def richer_text(current: Column, candidate: Column) -> Column:
    return F.when(F.length(F.trim(candidate)) > F.length(F.trim(current)), candidate).otherwise(current)


def merged(kept: Column, other: Column) -> dict[str, Column]:
    """The fields of ``kept`` with better values of ``other`` taken over."""
    return {
        "title": better_title(kept["title"], other["title"]),
        "company": better_company(kept["company"], other["company"]),
        "location": better_place(kept["location"], other["location"]),
        "eligibility_text": richer_text(kept["eligibility_text"], other["eligibility_text"]),
    }


def _bare_slug(slug: Column) -> Column:
    """A board's slug without the suffixes, as words."""
    bare = F.lower(F.trim(slug))
    for suffix in L.BOARD_SLUG_SUFFIXES:
        bare = F.regexp_replace(bare, f"{suffix}$", "")
    return F.trim(F.replace(bare, F.lit("-"), F.lit(" ")))


def company_of_slug(slug: Column) -> Column:
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in L.BOARD_SLUGS.items() for x in pair)), F.lower(F.trim(slug)))
    words = let(_bare_slug(slug), lambda b: F.when(b != "", F.initcap(b)).otherwise(F.replace(slug, F.lit("-"), F.lit(" "))))
    return F.coalesce(known, let(words, clean_title))


def company_of_url(url: Column) -> Column:
    board = F.coalesce(greenhouse_board(url)["board"], lever_board(url)["board"])
    return let(board, lambda b: F.when(b.isNotNull(), company_of_slug(b)).otherwise(F.lit("")))


def board_title(title: Column, url: Column) -> Column:
    """struct(title, company) of a job board's title."""
    tidy = F.regexp_replace(title, r"(?i)\s*\|\s*(LinkedIn|Indeed\.com|Glassdoor|Monster)\s*$", "")
    facts = F.struct(let(tidy, clean_title).alias("title"), company_of_url(url).alias("inferred"), F.lower(url).contains("indeed.com").alias("indeed"))
    return let(let(facts, _title_parts), _parsed_title)


def _title_parts(f: Column) -> Column:
    title, cut = f["title"], lambda c: F.split_part(c, F.lit(" | "), F.lit(1))
    after = cut(F.regexp_extract(title, r"(?s)^.* at (.*)$", 1))
    return F.struct(
        f["title"], f["inferred"], f["indeed"], title.rlike(APPLICATION).alias("applied"), clean_title(F.regexp_extract(title, APPLICATION, 1)).alias("role"),
        clean_title(F.regexp_extract(title, APPLICATION, 2)).alias("firm"), clean_title(F.regexp_extract(title, r"(?s)^(.*) at (?:.*)$", 1)).alias("before"),
        clean_title(after).alias("after"), clean_title(F.split_part(title, F.lit(" - "), F.lit(1))).alias("left"),
        clean_title(cut(F.regexp_replace(title, r"(?s)^.*? - ", ""))).alias("right"),
    )


def _parsed_title(f: Column) -> Column:
    pair = lambda t, c: F.struct(t.alias("title"), c.alias("company"))
    return (
        F.when(f["applied"] & ~missing_company(f["firm"]), pair(f["role"], f["firm"]))
        .when(f["applied"], pair(f["role"], F.when(f["inferred"] != "", f["inferred"]).otherwise(f["firm"])))
        .when(f["title"].contains(" at ") & ~missing_company(f["after"]), pair(f["before"], f["after"]))
        .when(f["indeed"] & f["title"].contains(" - "), pair(f["right"], f["left"]))
        .otherwise(pair(f["title"], f["inferred"]))
    )


def place_of_snippet(snippet: Column) -> Column:
    """The first place that a snippet names; empty if none."""
    return let(clean_title(snippet), _place_in)


def _place_in(text: Column) -> Column:
    found = F.array(*(F.regexp_extract(text, f"(?i){p}", 1) for p in L.SNIPPET_PLACE_PATTERNS))
    named = F.filter(F.transform(F.filter(found, lambda f: f != ""), clean_title), lambda f: ~F.lower(f).isin(L.NOT_PLACES))
    return F.coalesce(F.try_element_at(named, F.lit(1)), F.lit(""))


def enriched(title: Column, company: Column, location: Column, url: Column, snippet: Column) -> dict[str, Column]:
    """Missing title, company and place filled from title, address and snippet.

    A company that a source states stays; only a missing one or a job board's
    name is replaced.
    """
    def company_now(parsed: Column) -> Column:
        open_ = missing_company(company) | F.lower(company).startswith("job board")
        return F.when(open_, better_company(company, parsed["company"])).otherwise(company)

    return {
        "title": let(board_title(title, url), lambda p: better_title(title, p["title"])),
        "company": let(board_title(title, url), company_now),
        "location": let(place_of_snippet(snippet), lambda p: better_place(location, p)),
    }


def board_company(title: Column, url: Column) -> Column:
    """The company of a job board's search result."""
    low = F.lower(url)
    first = lambda c: F.split_part(c, F.lit(" | "), F.lit(1))
    at = F.regexp_replace(title, r"(?s)^.*? at ", "")
    slug = F.split_part(F.regexp_replace(host(url), r"^www\.", ""), F.lit("."), F.lit(1))
    parsed, inferred = board_title(title, url)["company"], company_of_url(url)
    of_slug = F.when(slug.isin("jobs", "boards", "careers"), F.lit("Unknown Company")).otherwise(F.replace(slug, F.lit("-"), F.lit(" ")))
    named = (
        F.when(low.contains("linkedin.com") & title.contains(" at "), first(at))
        .when(low.contains("linkedin.com") & title.contains(" | "), first(title))
        .when(low.contains("indeed.com") & title.contains(" - "), F.split_part(title, F.lit(" - "), F.lit(1)))
        .when(low.contains("indeed.com") & title.contains(" at "), first(at))
    )
    plain = F.when(title.contains(" at "), at).when(title.contains(" | "), first(title)).otherwise(of_slug)
    return let(F.coalesce(named, F.nullif(parsed, F.lit("")), F.nullif(inferred, F.lit("")), plain), clean_title)


def is_board_result(title: Column, url: Column, snippet: Column) -> Column:
    text = F.lower(F.concat_ws(" ", title, url, snippet))
    return contains_any(host(url), L.BOARD_DOMAINS) | contains_any(text, L.BOARD_KEYWORDS)


def company_of_result(title: Column, url: Column) -> Column:
    """A discovered company's name from a page's title, or its domain."""
    from .urls import domain_key

    tidy = lambda c: F.btrim(F.regexp_replace(c, r"(?U)\s+", " "), F.lit(" -|:"))
    low, key = F.lower(title), domain_key(url)
    cuts = [F.when(low.contains(s), F.substring(title, F.lit(1), F.instr(low, s) - 1)) for s in (" careers", " internships", " jobs", " | linkedin")]
    known = F.try_element_at(F.create_map(*(F.lit(x) for pair in L.DOMAIN_COMPANIES.items() for x in pair)), key)
    return (
        F.when(low.contains(" at "), tidy(F.regexp_replace(title, r"(?s)^.* at ", "")))
        .when(F.coalesce(*cuts).isNotNull(), tidy(F.coalesce(*cuts)))
        .otherwise(F.coalesce(known, tidy(F.replace(key, F.lit("-"), F.lit(" ")))))
    )
