"""URL functions over columns: parts, canonical forms, platforms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L

#: The generic syntax of RFC 3986, appendix B: scheme, host, path, query, fragment.
PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def part(url: Column, number: int) -> Column:
    return F.regexp_extract(url, PARTS, number)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 1))


def host(url: Column) -> Column:
    return F.lower(part(url, 2))


def path(url: Column) -> Column:
    return part(url, 3)


def query(url: Column) -> Column:
    return part(url, 4)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once, however often it is used."""
    return F.transform(F.array(value), body)[0]


def contains_any(text: Column, words: list[str]) -> Column:
    """Does the text hold any of the words? ``text`` is best a column, not an expression."""
    return reduce(lambda found, word: found | text.contains(word), words[1:], text.contains(words[0])) if words else F.lit(False)


def first_contained(text: Column, words: list[str]) -> Column:
    """The first of the words, in their order, that the text holds; else null."""
    return reduce(lambda found, word: found.when(text.contains(word), F.lit(word)), words[1:], F.when(text.contains(words[0]), F.lit(words[0])))


def _plain(text: Column) -> Column:
    return F.coalesce(F.try_url_decode(text), text)


def _encoded(text: Column) -> Column:
    return F.replace(F.replace(F.url_encode(text), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column) -> Column:
    """The query's (k, v) structs, decoded, without blank values."""
    fields = F.filter(F.split(query(url), "&"), lambda x: x.rlike("(?s)^[^=]*=."))
    return F.transform(fields, lambda x: F.struct(
        _plain(F.regexp_extract(x, "(?s)^([^=]*)=", 1)).alias("k"), _plain(F.regexp_extract(x, "(?s)^[^=]*=(.*)$", 1)).alias("v")
    ))


def query_value(url: Column, key: str) -> Column:
    """The first value of a query key, or null."""
    return F.try_element_at(F.filter(query_pairs(url), lambda p: p["k"] == key), F.lit(1))["v"]


def is_linkedin(url: Column) -> Column:
    return F.lower(url).contains("linkedin.com/jobs/view/")


def is_indeed(url: Column) -> Column:
    low = F.lower(url)
    return low.contains("indeed.com/viewjob") | (low.contains("indeed.com") & low.contains("jk="))


def is_aggregator(url: Column) -> Column:
    return is_linkedin(url) | is_indeed(url)


def is_public_aggregator(url: Column) -> Column:
    """An aggregator's page of one job, not its search pages."""
    search = contains_any(F.lower(url), ["linkedin.com/jobs/search", "indeed.com/jobs?", "indeed.com/q-"])
    return ~search & is_aggregator(url)


def is_public_board(url: Column) -> Column:
    low = F.lower(url)
    boards = low.contains("linkedin.com") | low.contains("indeed.com")
    return F.when(boards, is_public_aggregator(url)).otherwise(F.lit(True))


def linkedin_canonical(url: Column) -> Column:
    number = F.regexp_extract(url, r"(?i)linkedin\.com/jobs/view/(\d+)", 1)
    return F.when(number != "", F.concat(F.lit("https://www.linkedin.com/jobs/view/"), number)).otherwise(F.lower(F.trim(url)))


def indeed_canonical(url: Column) -> Column:
    key = F.lower(F.regexp_extract(url, r"(?i)[?&]jk=([a-z0-9]+)", 1))
    page = host(F.trim(url)).contains("indeed.com") & F.lower(path(F.trim(url))).contains("/viewjob")
    bare = F.lower(F.regexp_replace(F.split_part(F.trim(url), F.lit("#"), F.lit(1)), "/+$", ""))
    return (
        F.when(key != "", F.concat(F.lit("https://www.indeed.com/viewjob?jk="), key))
        .when(page, bare).otherwise(F.lower(F.trim(url)))
    )


def canonical(url: Column) -> Column:
    """One spelling of a posting's address.

    Aggregators keep their job's number; others lose tracking and blank
    parameters, fragment and last slashes, are lower-cased whole, and have
    repeated keys side by side. Without scheme or host: trimmed lower case.
    """
    return let(F.trim(url), _canonical)


def _canonical(tidy: Column) -> Column:
    kept = F.filter(query_pairs(tidy), lambda p: ~F.lower(p["k"]).isin(L.TRACKING_PARAMETERS))

    def grouped(pairs: Column) -> Column:
        keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
        return F.flatten(F.transform(keys, lambda k: F.filter(pairs, lambda p: p["k"] == k)))

    shown = F.transform(let(kept, grouped), lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"])))
    asked = F.when(query(tidy) == "", F.lit("")).otherwise(let(F.array_join(shown, "&"), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit(""))))
    whole = F.lower(F.concat(F.regexp_extract(tidy, "(?s)^[^?#]*", 0), asked))
    lacking = ~tidy.rlike("^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]")
    plain = F.when(lacking, F.lower(tidy)).otherwise(F.regexp_replace(whole, "/+$", ""))
    return F.when(is_linkedin(tidy), linkedin_canonical(tidy)).when(is_indeed(tidy), indeed_canonical(tidy)).otherwise(plain)


def posting_id(url: Column) -> Column:
    return F.coalesce(F.nullif(canonical(url), F.lit("")), F.lower(F.trim(url)))


def stable_id(url: Column, title: Column, provider: Column) -> Column:
    slug = F.regexp_replace(F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(canonical(url), F.lit("")), F.concat(provider, F.lit(":"), slug))


def navigation(url: Column) -> Column:
    """Scheme and host in lower case, no fragment, no last slashes."""
    tidy = F.trim(url)
    head = F.when(scheme(tidy) != "", F.concat(scheme(tidy), F.lit(":"))).otherwise(F.lit(""))
    site = F.when(host(tidy) != "", F.concat(F.lit("//"), host(tidy))).otherwise(F.lit(""))
    asked = F.when(query(tidy) != "", F.concat(F.lit("?"), query(tidy))).otherwise(F.lit(""))
    return F.regexp_replace(F.concat(head, site, path(tidy), asked), "/+$", "")


def search_target(url: Column) -> Column:
    """A search result's address: redirects unwrapped, no fragment; empty without scheme or host."""
    tidy = F.trim(url)
    tidy = F.when(tidy.startswith("//"), F.concat(F.lit("https:"), tidy)).otherwise(tidy)
    redirect = part(tidy, 2).endswith("duckduckgo.com") & path(tidy).startswith("/l/")
    target = F.when(redirect, query_value(tidy, "uddg"))
    final = F.coalesce(target, tidy)
    return F.when((part(final, 1) == "") | (part(final, 2) == ""), F.lit("")).otherwise(F.regexp_replace(final, "(?s)#.*$", ""))


def with_scheme(url: Column) -> Column:
    tidy = F.trim(url)
    return F.when(tidy.rlike("^(?i)https?://"), tidy).otherwise(F.concat(F.lit("https://"), tidy))


def platform(url: Column) -> Column:
    low = F.lower(url)
    return (
        F.when(is_linkedin(url), F.lit("linkedin")).when(is_indeed(url), F.lit("indeed"))
        .when(low.contains("greenhouse.io"), F.lit("greenhouse")).when(low.contains("lever.co"), F.lit("lever"))
        .when(low.contains("myworkdayjobs.com") | low.contains("workday.com"), F.lit("workday")).otherwise(F.lit("other"))
    )


def greenhouse_board(url: Column) -> Column:
    """struct(board, job), or null."""
    pattern = r"(?i)https?://(?:job-boards|boards)\.greenhouse\.io/([^/]+)/jobs/(\d+)"
    board = F.regexp_extract(url, pattern, 1)
    return F.when(board != "", F.struct(board.alias("board"), F.regexp_extract(url, pattern, 2).alias("job")))


def lever_board(url: Column) -> Column:
    pattern = r"(?i)https?://jobs\.lever\.co/([^/]+)/([^/?#]+)"
    board = F.regexp_extract(url, pattern, 1)
    return F.when(board != "", F.struct(board.alias("board"), F.regexp_extract(url, pattern, 2).alias("job")))


def is_job_posting(url: Column) -> Column:
    return contains_any(F.lower(url), ["/job/", "jobid=", "requisition"])


def is_careers_search(url: Column) -> Column:
    return contains_any(F.lower(url), ["search-jobs", "search?keyword"])


def looks_like_careers(url: Column) -> Column:
    return contains_any(F.lower(url), L.CAREER_PATH_MARKERS)


def is_blocked_host(name: Column) -> Column:
    return contains_any(name, L.BLOCKED_DOMAINS)


def domain_key(url: Column) -> Column:
    name = F.replace(host(url), F.lit("www."), F.lit(""))
    name = F.regexp_replace(F.regexp_replace(name, r"^careers\.", ""), r"^jobs\.", "")
    return F.split_part(name, F.lit("."), F.lit(1))


def website(url: Column) -> Column:
    return F.concat(part(url, 1), F.lit("://"), part(url, 2))


def is_trusted_host(name: Column) -> Column:
    bare = F.lower(F.split_part(name, F.lit(":"), F.lit(1)))
    found = F.lit(False)
    for domain in L.TRUSTED_HOSTS:
        found = found | (bare == domain) | bare.endswith(f".{domain}")
    return found


def is_job_detail(url: Column) -> Column:
    """Does the address look like one job's page?"""
    low = F.regexp_replace(F.lower(path(url)), "/+$", "")
    pieces = F.size(F.filter(F.split(low, "/"), lambda p: p != ""))
    boards = host(url).contains("lever.co") | host(url).contains("ashbyhq.com")
    return (
        low.rlike(r"/(?:job|jobs)/(?:[^/]+/)*\d+(?:/|$)") | contains_any(low, ["/job/", "/jobdetails/", "/job-detail/"])
        | (boards & (pieces >= 2))
    )


def is_direct_source(url: Column) -> Column:
    return is_job_detail(url) | F.lower(path(url)).rlike(r"/jobs/(?:r[-_]\d+|\d+)(?:/|$)")


def is_other_locale(url: Column, root: Column) -> Column:
    """Does the path open with a locale that the root's path doesn't open with?"""
    locale = lambda u: F.lower(F.regexp_extract(path(u), r"(?i)^/*([a-z]{2}(?:-[a-z]{2})?)(?:/|$)", 1))
    return (locale(url) != "") & (locale(url) != locale(root))


def repaired(url: Column) -> Column:
    """Known broken pagination: ``/search-jobs&p=2`` becomes a query."""
    broken = (host(url) == "careers.blackrock.com") & (query(url) == "") & path(url).rlike(r"(?i)^/search-jobs&p=\d+$")
    return F.when(broken, F.regexp_replace(url, r"(?i)(/search-jobs)&(p=\d+)", "$1?$2")).otherwise(url)
