"""The listing classifier: is a page one specific internship?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lexicon as L
from .stage import settled
from .text import normalized
from .urls import contains_any, first_contained, let, path, query_value


def matches(text: Column, patterns: list[str]) -> Column:
    """Does any pattern occur, whatever the case?"""
    return text.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?U)\S+"))


def mentions_internship(title: Column, url: Column) -> Column:
    return matches(F.concat_ws(" ", title, url), L.INTERNSHIP_PATTERNS) | matches(title, [L.STUDENT_PATTERN])


def is_story(title: Column, url: Column) -> Column:
    return contains_any(url, L.BLOG_URL_FRAGMENTS) | contains_any(title, L.STORY_MARKERS)


def is_search_page(title: Column, url: Column) -> Column:
    return contains_any(F.concat_ws(" ", title, url), L.SEARCH_MARKERS)


def has_job_url(url: Column) -> Column:
    """Rules on a lower-case address; the first that applies decides."""
    return let(last_path(url), lambda way: let(F.struct(way.alias("way"), url.alias("url")), lambda f: job_rule(f["url"], f["way"])))


def last_path(url: Column) -> Column:
    return F.regexp_replace(path(url), "/+$", "")


def job_rule(url: Column, way: Column) -> Column:
    """Of a lower-case address and its path without last slashes."""
    has = url.contains
    slashes = F.length(way) - F.length(F.replace(way, F.lit("/"), F.lit("")))
    numbered = F.trim(F.coalesce(query_value(url, "id"), query_value(url, "jobid"), F.lit(""))).rlike("^[0-9]+$")
    yes, no = F.lit(True), F.lit(False)
    return (
        F.when(contains_any(url, [*L.BLOG_URL_FRAGMENTS, "linkedin.com/jobs/search", "indeed.com/jobs?", "indeed.com/q-"]), no)
        .when(F.when(way.endswith("/jobs"), numbered).otherwise(no), yes)
        .when(~contains_any(url, L.SPECIFIC_URL_FRAGMENTS), no)
        .when(has("/job/") & (slashes >= 3), yes)
        .when(has("/job-detail/") & (slashes >= 4), yes)
        .when(has("/jobdetail/") & (slashes >= 2), yes)
        .when(has("/jobs/") & way.endswith("/jobs"), no)
        .when(has("linkedin.com/jobs/view/") | has("indeed.com/viewjob"), yes)
        .when(has("/jobs/") & (slashes >= 2), yes)
        .when(contains_any(url, ["jobid=", "requisition", "reqid=", "gh_jid=", "careersection"]), yes)
        .when(has("/careers/details/") & (slashes >= 3), yes)
        .otherwise(has("/opening/") | has("/position/"))
    )


def has_role_title(title: Column) -> Column:
    """Rules on a normalised title; the first that applies decides."""
    role = matches(title, [rf"\b{term}\b" for term in L.ROLE_TITLE_TERMS])
    seen = lambda pattern: title.rlike(f"(?U){pattern}")
    words = word_count(title)
    return (
        F.when(title.rlike(L.HEBREW_STUDENT_PATTERN), words >= 2)
        .when(matches(title, [L.STUDENT_PATTERN]), role)
        .when(seen(r"\b20(26|27)\b"), F.lit(True))
        .when(seen(r"\bsummer\b") & seen(r"\bintern"), words >= 3)
        .otherwise(
            seen(r"\bsummer associate\b") | seen(r"\bassociate consultant internship?\b")
            | (seen(r"\binternship\b") & (words >= 2)) | (seen(r"\bintern") & role)
        )
    )


def is_program_detail(title: Column, url: Column) -> Column:
    way = F.regexp_replace(F.lower(path(url)), "/+$", "")
    return way.rlike(r"/internships?-programs/[^/]+$") & has_role_title(title)


def _fragment(name: Column) -> Column:
    """The first fragment of general titles that a title holds; a search for internships must open it."""
    opens = name.startswith("search intern") | name.startswith("search for intern")
    found = None
    for f in L.GENERIC_TITLE_FRAGMENTS:
        holds = name.contains(f) & opens if f == "search intern" else name.contains(f)
        found = F.when(holds, F.lit(f)) if found is None else found.when(holds, F.lit(f))
    return found


def _facts(name: Column, link: Column, way: Column) -> dict[str, Column]:
    """What the rules ask about a normalised title, an address and its path."""
    return {
        "job": job_rule(link, way), "role": has_role_title(name), "fragment": _fragment(name), "place": first_contained(link, L.GENERIC_URL_FRAGMENTS),
        "program": way.rlike(r"/internships?-programs/[^/]+$"), "words": word_count(name),
    }


def _general(title: Column, f: dict[str, Column]) -> Column:
    """Why a page is a general one, or null; rules in order of precedence."""
    quoted = lambda text, value: F.concat(F.lit(f"{text} ('"), value, F.lit("')."))
    return (
        F.when(title.isin(L.GENERIC_EXACT_TITLES), F.concat(F.lit("Title matches a generic careers page: '"), title, F.lit("'.")))
        .when(f["fragment"].isNotNull(), quoted("Title looks like a program navigation page", f["fragment"]))
        .when(f["place"].isNotNull() & ~f["job"] & ~(f["program"] & f["role"]), quoted("URL looks like a general careers page", f["place"]))
        .when(title.rlike("^(search )?internships?$"), F.lit("Title is a generic internships search label."))
        .when((f["words"] >= L.LONG_TITLE_WORDS) & ~f["job"], F.lit("Title looks like page copy rather than a job posting title."))
    )


def _verdict(name: Column, link: Column, f: dict[str, Column], why: Column) -> Column:
    year = name.contains("2027") | name.contains("2026")
    by_title = (
        F.when(year, F.lit("Title includes a target internship year."))
        .when(name.contains("summer") & name.contains("intern"), F.lit("Title includes a summer internship role."))
        .otherwise(F.lit("Title includes a specific internship role."))
    )

    def verdict(category: str, reason: Column) -> Column:
        return F.struct(F.lit(category == "specific_listing").alias("is_specific"), F.lit(category).alias("category"), reason.alias("reason"))

    return (
        F.when(is_story(name, link), verdict("blog_or_story", F.lit("URL or title looks like a blog or employee story page.")))
        .when(~mentions_internship(name, link), verdict("not_internship", F.lit("Does not mention internship-related terms.")))
        .when(why.isNotNull() & is_search_page(name, link), verdict("generic_search_page", why))
        .when(why.isNotNull(), verdict("generic_program_page", why))
        .when(f["job"], verdict("specific_listing", F.lit("URL points to a specific job posting path.")))
        .when(f["role"], verdict("specific_listing", by_title))
        .otherwise(verdict("generic_program_page", F.lit("Mentions internships but lacks a specific role title or job posting URL.")))
    )


def _staged(rows: DataFrame, title: Column, url: Column) -> tuple[DataFrame, Column, Column, dict[str, Column]]:
    """``rows`` with the facts as columns of their own, each worked out once and in generated code."""
    names = {n: f"_listing_{n}" for n in ("name", "link", "way", "job", "role", "fragment", "place", "program", "words")}
    rows = rows.withColumns({names["name"]: normalized(title), names["link"]: F.lower(F.trim(url))})
    name, link = F.col(names["name"]), F.col(names["link"])
    rows = rows.withColumn(names["way"], last_path(link))
    rows = rows.withColumns({names[k]: c for k, c in _facts(name, link, F.col(names["way"])).items()})
    return rows, name, link, {k: F.col(n) for k, n in names.items()}


def with_classified(rows: DataFrame, title: Column, url: Column, out: str) -> DataFrame:
    """``rows`` and, as column ``out``, struct(is_specific, category, reason) of each page."""
    kept = rows.columns
    rows, name, link, facts = _staged(rows, title, url)
    rows = rows.withColumn("_listing_why", _general(name, facts))
    return settled(rows, {out: _verdict(name, link, facts, F.col("_listing_why"))}).select(*kept, out)


def classified(title: Column, url: Column) -> Column:
    """The same as one column, for single use; :func:`with_classified` is faster on many rows."""
    tidy = F.struct(normalized(title).alias("name"), F.lower(F.trim(url)).alias("link"))
    placed = let(tidy, lambda x: F.struct(x["name"].alias("name"), x["link"].alias("link"), last_path(x["link"]).alias("way")))
    facts = let(placed, lambda x: F.struct(
        x["name"].alias("name"), x["link"].alias("link"), *(c.alias(k) for k, c in _facts(x["name"], x["link"], x["way"]).items())
    ))
    return let(facts, lambda f: let(_general(f["name"], f), lambda why: _verdict(f["name"], f["link"], f, why)))


def with_generic_reason(rows: DataFrame, title: Column, url: Column, out: str) -> DataFrame:
    """``rows`` and, as column ``out``, why a page is a general one, or null."""
    kept = rows.columns
    rows, name, _, facts = _staged(rows, title, url)
    return settled(rows, {out: _general(name, facts)}).select(*kept, out)


def category_label(category: Column) -> Column:
    pairs = [F.lit(x) for pair in L.CATEGORY_LABELS.items() for x in pair]
    other = F.initcap(F.replace(category, F.lit("_"), F.lit(" ")))
    return F.coalesce(F.try_element_at(F.create_map(*pairs), category), other)


def is_graduate_only(title: Column, eligibility: Column) -> Column:
    return let(F.concat_ws(" ", title, eligibility), lambda text: (
        F.when(matches(text, L.STRICT_GRADUATE_PATTERNS), F.lit(True))
        .when(matches(text, L.UNDERGRADUATE_PATTERNS), F.lit(False))
        .otherwise(matches(text, L.GRADUATE_PATTERNS))
    ))


def mentions_terms(text: Column) -> Column:
    return contains_any(text, L.MENTION_TERMS)


def is_likely_job_link(text: Column, href: Column) -> Column:
    name, link = F.lower(F.trim(text)), F.lower(F.trim(href))
    excluded = F.lit(False)
    for prefix in L.LINK_EXCLUDED_PREFIXES:
        excluded = excluded | link.startswith(prefix)
    wanted = contains_any(name, L.LINK_TEXT_KEYWORDS) | contains_any(link, L.LINK_URL_KEYWORDS)
    return ~excluded & (link != "") & ~name.isin(L.LINK_EXCLUDED_TITLES) & ~contains_any(link, L.LINK_EXCLUDED_URLS) & wanted
