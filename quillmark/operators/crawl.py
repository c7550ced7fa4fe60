"""Links of pages and the next addresses to visit."""

from __future__ import annotations

from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import lexicon as L
from ..functions import listing, urls

LINK = T.ArrayType(T.StructType([T.StructField(c, T.StringType()) for c in ("text", "href", "rel", "aria_label", "class_name")]))
PAGE_ATTRIBUTES = ("data-href", "data-url", "data-next-url", "data-page-url")


class _Links(HTMLParser):
    """Collects a page's links: anchors and buttons with text, frames, scripts, rel=next."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict[str, str]] = []
        self.open: list[tuple[str, dict[str, str], list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        values = {k: v or "" for k, v in attrs}
        link = {"text": "", "href": "", "rel": values.get("rel", ""), "aria_label": values.get("aria-label", ""), "class_name": values.get("class", "")}
        link["href"] = values.get("href", "") or next((values[a] for a in PAGE_ATTRIBUTES if values.get(a)), "")
        if tag in ("a", "button"):
            self.open.append((tag, link, []))
        elif tag in ("iframe", "script") and values.get("src"):
            self.found.append(link | {"href": values["src"], "rel": "career-embed"})
        elif tag == "link" and "next" in values.get("rel", "").lower() and link["href"]:
            self.found.append(link)

    def handle_data(self, data: str) -> None:
        for _, _, parts in self.open:
            parts.append(data)

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                _, link, parts = self.open.pop(i)
                if link["href"]:
                    self.found.append(link | {"text": " ".join("".join(parts).split())})
                return


def links_of(html: str | None) -> list[dict[str, str]]:
    parser = _Links()
    parser.feed(html or "")
    parser.close()
    return parser.found


@F.pandas_udf(LINK)
def page_links(pages: pd.Series) -> pd.Series:
    return pages.map(links_of)


@F.pandas_udf(T.StringType())
def resolved(base: pd.Series, href: pd.Series) -> pd.Series:
    """An address relative to its page; empty for fragments, mail, telephone and scripts."""

    def one(root: str | None, link: str | None) -> str:
        link = (link or "").strip()
        if not link or link.lower().startswith(tuple(L.LINK_EXCLUDED_PREFIXES)):
            return ""
        try:
            whole = urljoin(root or "", link)
            parts = urlsplit(whole)
        except ValueError:
            return ""
        return whole if parts.scheme and parts.netloc else ""

    return pd.Series([one(b, h) for b, h in zip(base, href)])


@F.pandas_udf(T.StringType())
def unescaped(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unescape(t))


def semantic_text(html: Column) -> Column:
    """A page's text: block tags end lines, others go, lines are tidied, empty ones dropped."""
    broken = F.regexp_replace(html, r"(?i)</?(?:p|div|section|li|h[1-6]|br|dt|dd|article|main)[^>]*>", "\n")
    plain = unescaped(F.regexp_replace(broken, "<[^>]+>", " "))
    lines = F.transform(F.split(plain, r"\r?\n"), lambda x: F.trim(F.regexp_replace(x, r"(?U)\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def is_next_page(text: Column, rel: Column, aria: Column, css: Column, target: Column) -> Column:
    name = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    said = F.lower(F.concat_ws(" ", rel, aria, css))
    way = F.regexp_replace(F.lower(urls.path(target)), "/+$", "")
    pairs = urls.query_pairs(target)
    keyed = F.exists(pairs, lambda p: F.lower(p["k"]).isin(L.PAGE_KEYS) | (F.lower(p["k"]).isin(L.PAGE_NUMBER_KEYS) & p["v"].rlike("^[0-9]+$")))
    numbered = name.rlike("^[0-9]+$") & way.rlike(r"/(?:careers?|jobs?|openings?|search)")
    return (
        F.lower(rel).contains("next") | F.lower(aria).contains("next") | name.isin(L.PAGE_TEXTS) | name.startswith("next ")
        | said.contains("pagination-next") | F.coalesce(keyed, F.lit(False))
        | F.when(numbered, ~urls.is_job_detail(target)).otherwise(way.rlike(r"/(?:page|pages|p)/?[-_]?\d+$") | way.rlike(r"[-_/](?:page|pg)[-_]?\d+$"))
    )


def is_listing_page(text: Column, rel: Column, target: Column) -> Column:
    name = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    site, way = urls.host(target), F.regexp_replace(F.lower(urls.path(target)), "/+$", "")
    pieces = F.filter(F.split(way, "/"), lambda p: p != "")
    n = F.size(pieces)
    return (
        F.when((site == "careers.blackrock.com") & (way == "/job"), F.lit(False))
        .when((rel == "career-embed") & urls.is_trusted_host(site), F.lit(True))
        .when(name.isin(L.LISTING_TEXTS), F.lit(True))
        .when(site.contains("lever.co") | site.contains("ashbyhq.com"), n == 1)
        .when(site.contains("greenhouse.io"), (n == 1) | ((n == 2) & (F.try_element_at(pieces, F.lit(2)) == "jobs")))
        .otherwise(way.rlike(r"/(?:careers?|jobs?|openings?|positions?|search-jobs|job-search)$"))
    )


def is_detail_page(text: Column, target: Column) -> Column:
    way = F.regexp_replace(F.lower(urls.path(target)), "/+$", "")
    slug = F.replace(F.regexp_extract(way, "([^/]*)$", 1), F.lit("-"), F.lit(" "))
    return (
        F.when(way.rlike(r"/internships?-programs/[^/]+$"), listing.mentions_internship(text, slug))
        .otherwise(listing.mentions_internship(text, target) & urls.is_job_detail(target))
    )


def frontier(pages: DataFrame) -> DataFrame:
    """(page_url, ord, url): the addresses each page adds to the crawl, in order, once each.

    ``pages`` has page_url, root_url and html. Next pages stay on the site;
    listing and job pages also go to trusted hosts; other locales are left out.
    """
    rows = pages.select("page_url", "root_url", F.posexplode(page_links("html")).alias("ord", "link")).select("page_url", "root_url", "ord", "link.*")
    rows = rows.withColumn("url", urls.repaired(resolved("page_url", "href"))).where("url <> ''")
    site = urls.host(F.col("url"))
    own = (site == urls.host(F.col("page_url"))) | (site == urls.host(F.col("root_url")))
    near = own | urls.is_trusted_host(site)
    following = is_next_page(F.col("text"), F.col("rel"), F.col("aria_label"), F.col("class_name"), F.col("url"))
    lists, detail = is_listing_page(F.col("text"), F.col("rel"), F.col("url")), is_detail_page(F.col("text"), F.col("url"))
    keep = (
        ~urls.is_other_locale(F.col("url"), F.col("root_url")) & ~(following & ~own) & ~(lists & ~near) & ~(detail & ~near)
        & (following | lists | detail) & (urls.navigation(F.col("url")) != urls.navigation(F.col("page_url")))
    )
    first = Window.partitionBy("page_url", "_key").orderBy("ord")
    rows = rows.where(keep).withColumn("_key", urls.navigation(F.col("url"))).withColumn("_n", F.row_number().over(first))
    return rows.where("_n = 1").select("page_url", "ord", "url")


def link_postings(pages: DataFrame, collected: str) -> DataFrame:
    """Postings that a page's anchors name: likely job links that are specific listings, first per address."""
    rows = pages.select("company", "page_url", F.posexplode(page_links("html")).alias("ord", "link")).select("company", "page_url", "ord", "link.*")
    rows = rows.where(listing.is_likely_job_link(F.col("text"), F.col("href"))).withColumn("posting_url", resolved("page_url", "href")).where("posting_url <> ''")
    title = F.when(F.trim("text") == "", F.lit("Untitled posting")).otherwise(F.col("text"))
    rows = rows.withColumn("title", title).where(listing.classified(F.col("title"), F.col("posting_url"))["is_specific"])
    first = Window.partitionBy("page_url", "posting_url").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(
        "title", "company", F.lit("Unknown").alias("location"), "posting_url", F.lit(collected).alias("date_collected"),
        F.col("page_url").alias("source_url"), F.lit("").alias("eligibility_text"),
    )


def crawl(fetch, roots: list[str], most: int = 100) -> Iterator[tuple[str, str]]:
    """(url, html) of a site breadth first, ``most`` pages at most; for use inside a reader."""
    queue, seen = list(dict.fromkeys(r.strip() for r in roots if r.strip())), set()
    while queue and len(seen) < most:
        url = queue.pop(0)
        if url in seen:
            continue
        seen.add(url)
        html = fetch(url)
        yield url, html
        for link in links_of(html):
            if "next" in link["rel"].lower() or link["text"].lower() in L.PAGE_TEXTS:
                queue.append(urljoin(url, link["href"]))
