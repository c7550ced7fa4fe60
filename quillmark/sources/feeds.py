"""Connectors: paged JSON feeds and HTML boards as posting tables.

A connector is a row of data: how its pages follow each other, where the
records are and what their fields become. Payloads come from a reader that a
caller supplies (or from stored pages); all parsing is done on columns.
"""

from __future__ import annotations

import glob
import json
import os
import re
import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import unescape
from urllib.parse import parse_qs, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import listing, text, urls
from ..operators import crawl

MOST_PAGES = 100
TERMS = ["intern", "summer analyst", "summer associate", "co-op"]


class FeedError(RuntimeError):
    """A feed's payload is malformed or its pages don't end."""


@dataclass(frozen=True)
class Feed:
    """One connector.

    ``records`` is the JSON path of the record array (``$`` for the payload
    itself), ``schema`` the records' fields, ``fields`` SQL for id, title, url,
    location, details over the record's columns and the source's (company,
    careers_url). ``paging``: how pages follow: single, offset or page, with the
    page size and the path of the total. ``keep`` is a further condition;
    ``specific`` is False where any mention of an internship will do.
    """

    name: str
    records: str
    schema: str
    fields: dict[str, str]
    paging: str = "single"
    size: int = 100
    total: str = ""
    first: int = 0
    keep: str = "true"
    specific: bool = True
    last_wins: bool = False
    terms: list[str] = field(default_factory=lambda: [""])


ORIGIN = "regexp_extract(careers_url, '^[a-z]+://[^/]+', 0)"
FEEDS = {f.name: f for f in [
    Feed("phenom_api", "$.refineSearch.data.jobs", "jobId string, reqId string, jobSeqNo string, jobUrl string, url string, title string, location string, cityState string, descriptionTeaser string",
         {"id": "coalesce(jobId, reqId, jobSeqNo)", "title": "title", "url": f"coalesce(jobUrl, url, concat({ORIGIN}, '/job/', coalesce(jobId, reqId, jobSeqNo)))",
          "location": "coalesce(location, cityState)", "details": "descriptionTeaser"}, "offset", 100, "$.refineSearch.totalHits"),
    Feed("mckinsey_jobs", "$.docs", "jobID string, title string, friendlyURL string, cities array<string>, yourBackground string, whatYouWillDo string",
         {"id": "jobID", "title": "title", "url": "concat('https://www.mckinsey.com/careers/search-jobs/jobs/', friendlyURL)", "location": "array_join(cities, ' | ')",
          "details": "concat_ws(' ', yourBackground, whatYouWillDo, title)"}, "offset", 100, "$.numFound", 1),
    Feed("lever_api", "$", "id string, text string, hostedUrl string, applyUrl string, categories struct<location:string>, descriptionPlain string, lists string",
         {"id": "coalesce(id, hostedUrl, applyUrl)", "title": "text", "url": "coalesce(hostedUrl, applyUrl)", "location": "categories.location", "details": "concat_ws(' ', descriptionPlain, lists)"}, "offset", 100),
    Feed("greenhouse_api", "$.jobs", "title string, absolute_url string, location struct<name:string>, metadata array<struct<name:string,value:string>>, offices array<struct<name:string,location:string>>, content string",
         {"id": "absolute_url", "title": "title", "url": "absolute_url", "details": "content",
          "location": "coalesce(nullif(array_join(transform(filter(metadata, m -> lower(trim(m.name)) = 'job posting location' and coalesce(m.value, '') <> ''), m -> regexp_replace(m.value, '[\\\\[\\\\]\"]', '')), ', '), ''), nullif(array_join(array_distinct(filter(transform(offices, o -> coalesce(o.location, o.name)), x -> x <> '')), ', '), ''), location.name)"}),
    Feed("jibe_jobs", "$.jobs", "data struct<req_id:string,slug:string,title:string,hiring_organization:string,apply_url:string,full_location:string,location_name:string,short_location:string,description:string,qualifications:string,responsibilities:string>",
         {"id": "coalesce(data.req_id, data.slug)", "title": "data.title", "url": f"if(data.apply_url like 'http%', data.apply_url, concat({ORIGIN}, '/main/jobs/', coalesce(data.req_id, data.slug)))",
          "location": "coalesce(data.full_location, data.location_name, data.short_location)", "details": "concat_ws(' ', data.description, data.qualifications, data.responsibilities)"},
         "page", 100, "$.totalCount", 1, "contains(lower(concat_ws(' ', data.title, data.hiring_organization)), lower(try_url_decode(regexp_extract(careers_url, 'keywords?=([^&]*)', 1))))"),
    Feed("adp_workforce_now", "$.jobRequisitions", "itemID string, requisitionTitle string, customFieldGroup struct<stringFields:array<struct<nameCode:struct<codeValue:string>,stringValue:string>>>, requisitionLocations array<struct<nameCode:struct<shortName:string>>>",
         {"id": "itemID", "title": "requisitionTitle", "details": "''", "location": "array_join(array_distinct(transform(requisitionLocations, l -> l.nameCode.shortName)), '; ')",
          "url": "concat(split_part(careers_url, '&jobId=', 1), '&jobId=', filter(customFieldGroup.stringFields, f -> f.nameCode.codeValue = 'ExternalJobID')[0].stringValue)"}, "offset", 100, "$.meta.totalNumber"),
    Feed("eightfold_pcsx", "$.data.positions", "id string, name string, positionUrl string, locations array<string>",
         {"id": "id", "title": "name", "url": f"if(positionUrl like 'http%', positionUrl, concat({ORIGIN}, positionUrl))", "location": "array_join(locations, '; ')", "details": "''"}, "offset", 10, "$.data.count", last_wins=True, terms=TERMS),
    Feed("general_dynamics_jobs", "$.Results", "Title string, Link struct<Url:string>, LocationNames array<string>, Excerpt string",
         {"id": "Link.Url", "title": "Title", "url": f"if(Link.Url like 'http%', Link.Url, concat({ORIGIN}, Link.Url))", "location": "array_join(LocationNames, '; ')", "details": "Excerpt"}, "page", 100, specific=False, last_wins=True, terms=TERMS),
    Feed("ashby_api", "$.jobs", "title string, jobUrl string, applyUrl string, location string, isListed boolean, descriptionPlain string, descriptionHtml string, description string",
         {"id": "coalesce(jobUrl, applyUrl)", "title": "title", "url": "coalesce(jobUrl, applyUrl)", "location": "location", "details": "coalesce(descriptionPlain, descriptionHtml, description)"}, keep="coalesce(isListed, true)"),
    Feed("workday_api", "$.jobPostings", "title string, externalPath string, locationsText string, bulletFields array<string>",
         {"id": "externalPath", "title": "title", "url": "concat(regexp_replace(split_part(careers_url, '?', 1), '/+$', ''), externalPath)", "location": "coalesce(nullif(locationsText, ''), array_join(bulletFields, ', '))", "details": "''"}, "offset", 20, "$.total"),
    Feed("oracle_recruiting_api", "$.items[0].requisitionList", "Id string, Title string, PrimaryLocation string, ShortDescriptionStr string, ExternalQualificationsStr string",
         {"id": "Id", "title": "Title", "url": f"concat({ORIGIN}, '/hcmUI/CandidateExperience/en/job/', Id)", "location": "PrimaryLocation", "details": "concat_ws(' ', ShortDescriptionStr, ExternalQualificationsStr)"}, "offset", 100, "$.items[0].TotalJobsCount"),
    Feed("goldman_higher", "$.data.roleSearch.items", "roleId string, jobTitle string, locations array<struct<city:string,state:string,country:string>>, educationLevel string, corporateTitle string, jobFunction string, division string",
         {"id": "roleId", "title": "jobTitle", "url": "concat('https://higher.gs.com/roles/', url_encode(roleId))", "location": "array_join(array_distinct(transform(locations, l -> concat_ws(', ', nullif(l.city, ''), nullif(l.state, ''), nullif(l.country, '')))), '; ')",
          "details": "concat_ws(' ', educationLevel, corporateTitle, jobFunction, division)"}, "page", 20, "$.data.roleSearch.totalCount"),
    Feed("ibm_careers", "$.hits.hits", "_source struct<title:string,url:string,description:string,field_keyword_05:string,field_keyword_17:string,field_keyword_19:string>",
         {"id": "_source.url", "title": "_source.title", "url": "_source.url", "location": "coalesce(_source.field_keyword_19, _source.field_keyword_05)", "details": "_source.description"}, "offset", 30, keep="_source.url like 'http%'", terms=["intern", "entry"]),
    Feed("elbit_jobs", "$", "id string, jobId string, title string, name string, jobTitle string, url string, jobUrl string, link string, category string, location string, city string, description string",
         {"id": "coalesce(id, jobId)", "title": "coalesce(title, name, jobTitle)", "url": f"coalesce(url, jobUrl, link, concat({ORIGIN}, '/job/', coalesce(id, jobId)))", "location": "coalesce(location, city)", "details": "concat_ws(' ', category, description)"}, specific=False),
    Feed("bank_of_america_jobs", "$.jobsList", "jobRequisitionId string, jcrURL string, externalUrl string, postingTitle string, jobSubFamily string, location string, primaryLocation string, locationString string, jobDescriptionExternal string",
         {"id": "jobRequisitionId", "title": "postingTitle", "url": f"if(coalesce(jcrURL, '') <> '', concat({ORIGIN}, jcrURL), externalUrl)", "location": "coalesce(location, primaryLocation, locationString)", "details": "jobDescriptionExternal"}, "offset", 100, "$.totalMatches"),
    Feed("consider_board", "$.jobs", "company struct<name:string>, jobs array<struct<title:string,url:string,applyUrl:string,locations:array<string>,companyName:string>>",
         {"id": "coalesce(job.url, job.applyUrl)", "title": "job.title", "url": "coalesce(job.url, job.applyUrl)", "location": "array_join(job.locations, ' | ')", "details": "''"}, "cursor", 60, keep="lower(coalesce(job.companyName, company.name)) = lower(source_company)"),
]}
#: Connectors whose success means that a source was read whole (beside the feeds).
EXHAUSTIVE = [*FEEDS, "avature_rss", "bayer_successfactors", "closed_company", "cyberark_parent_workday", "notion_public_page", "parked_company_domain", "paycor_html", "pixar_jobs", "profusa_careers", "successfactors_html", "wix_positions", "lemonade_jobs", "breezy_html", "teamtailor_html"]


def with_retry(call: Callable[[], str], attempts: int = 4, base: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> str:
    """Repeats a call that fails for a passing reason, waiting base * 2^k seconds."""
    for k in range(attempts):
        try:
            return call()
        except Exception as error:
            passing = any(s in str(error).lower() for s in ("429", "500", "502", "503", "504", "timed out"))
            if not passing or k == attempts - 1:
                raise
            sleep(base * 2**k)
    raise FeedError("no attempts")


def _at(payload, path: str):
    """The value at a simple JSON path, or None."""
    for step in path.lstrip("$.").replace("[", ".").replace("]", "").split("."):
        if step:
            payload = payload[int(step)] if isinstance(payload, list) and step.isdigit() and int(step) < len(payload) else payload.get(step) if isinstance(payload, dict) else None
    return payload


def pages(feed: Feed, fetch: Callable[[dict], str]) -> Iterator[tuple[int, str]]:
    """(page number, payload) of a feed, until it says that it has ended.

    ``fetch`` gets start, size, page, term and cursor. Raises on a payload
    without records, and if the pages go on beyond MOST_PAGES.
    """
    number = 0
    for term in feed.terms:
        start, cursor, size = feed.first, None, feed.size
        for page in range(MOST_PAGES + 1):
            if page == MOST_PAGES:
                raise FeedError(f"{feed.name}: more than {MOST_PAGES} pages")
            raw = with_retry(lambda: fetch({"start": start, "size": size, "page": page + (feed.first if feed.paging == "page" else 0), "term": term, "cursor": cursor}))
            payload = json.loads(raw)
            records = payload if feed.records == "$" else _at(payload, feed.records)
            if isinstance(records, dict):
                records = records.get("items")
            if not isinstance(records, list):
                raise FeedError(f"{feed.name}: unexpected response")
            yield number, raw
            number += 1
            start += len(records)
            total = int(_at(payload, feed.total) or 0) if feed.total else 0
            if feed.paging == "cursor":
                meta = payload.get("meta") or {}
                done, cursor, size = not records or meta.get("sequence") in (None, "", cursor), meta.get("sequence"), min(2 * int(meta.get("size", size)), 200)
            else:
                short = len(records) < feed.size and not (total and start - feed.first < total)
                done = feed.paging == "single" or not records or (total and start - feed.first >= total) or short
            if done:
                break


class PagesReader(DataSourceReader):
    """Reads stored pages: one partition a source's folder, so sources are read side by side."""

    def __init__(self, options: dict) -> None:
        self.folder = options["path"]

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(p) for p in sorted(glob.glob(os.path.join(self.folder, "*")))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for number, path in enumerate(sorted(glob.glob(os.path.join(partition.value, "*")))):
            with open(path, encoding="utf-8") as file:
                yield os.path.basename(partition.value), number, file.read()


class StoredPages(DataSource):
    """``spark.read.format("stored_pages").load(folder)``: source, page, payload."""

    @classmethod
    def name(cls) -> str:
        return "stored_pages"

    def schema(self) -> str:
        return "source string, page int, payload string"

    def reader(self, schema) -> PagesReader:
        return PagesReader(self.options)


def fetched(spark: SparkSession, feed: Feed, fetch: Callable[[dict], str], source: str) -> DataFrame:
    """A source's pages; sources differ, pages of one follow each other."""
    return spark.createDataFrame([(source, n, raw) for n, raw in pages(feed, fetch)], "source string, page int, payload string")


def _postings(rows: DataFrame, specific: bool | None, collected: str, last_wins: bool = False) -> DataFrame:
    """Cleans (ord, id, title, url, location, details, company, careers_url) and keeps one row an id; no test if ``specific`` is None."""
    title = text.clean_title(F.coalesce("title", F.lit("")))
    place = text.clean_text(F.coalesce("location", F.lit("")))
    rows = rows.where("coalesce(id, '') <> '' and coalesce(url, '') <> ''").withColumns({
        "title": title, "location": F.when(place == "", F.lit("Unknown")).otherwise(place), "posting_url": F.trim("url"),
        "eligibility_text": crawl.semantic_text(F.coalesce("details", F.lit(""))),
    })
    fit = listing.classified(F.col("title"), F.col("posting_url"))["is_specific"]
    fit = fit if specific else listing.mentions_internship(F.lower("title"), F.lower("posting_url"))
    fit = F.lit(True) if specific is None else fit
    order = Window.partitionBy("careers_url", "id").orderBy(F.desc("ord") if last_wins else F.col("ord"))
    rows = rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").where(fit)
    return rows.select(
        "title", "company", "location", "posting_url", F.lit(collected).alias("date_collected"), F.col("careers_url").alias("source_url"), "eligibility_text",
    )


def feed_postings(payloads: DataFrame, feed: Feed, collected: str) -> DataFrame:
    """Postings of a feed's payloads (page, payload, company, careers_url).

    Records are parsed with the feed's schema, so only its fields are read.
    """
    body = F.col("payload") if feed.records == "$" else F.get_json_object("payload", feed.records)
    body = F.when(body.startswith("{"), F.get_json_object(body, "$.items")).otherwise(body)
    rows = payloads.withColumnRenamed("company", "source_company").select(
        "page", "source_company", "careers_url", F.posexplode(F.from_json(body, f"array<struct<{_as_struct(feed.schema)}>>")).alias("pos", "r")
    ).select("page", "pos", "source_company", "careers_url", "r.*")
    if feed.name == "consider_board":
        rows = rows.select("page", "pos", "source_company", "careers_url", "company", F.posexplode("jobs").alias("inner", "job")).withColumn("pos", F.struct("pos", "inner")).drop("inner")
    rows = rows.where(feed.keep).select(F.struct("page", "pos").alias("ord"), *(F.expr(sql).alias(f"_{k}") for k, sql in feed.fields.items()), "source_company", "careers_url")
    named = rows.select("ord", *(F.col(f"_{k}").alias(k) for k in feed.fields), F.col("source_company").alias("company"), "careers_url")
    return _postings(named, feed.specific, collected, feed.last_wins)


def _as_struct(schema: str) -> str:
    """``a int, b string`` as ``a:int,b:string``, leaving nested types alone."""
    parts, depth, start = [], 0, 0
    for i, ch in enumerate(schema + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            name, _, kind = schema[start:i].strip().partition(" ")
            parts.append(f"{name}:{kind}")
            start = i + 1
    return ",".join(parts)


@dataclass(frozen=True)
class Board:
    """An HTML connector: a pattern per posting, with the groups of its fields."""

    name: str
    pattern: str
    url: int
    title: int
    location: int = 0
    row: str = ""
    specific: bool = True


#: Fixed patterns of public boards' pages.
BOARDS = {b.name: b for b in [
    Board("paycor_html", r"""(?is)<a[^>]+href=["'](https://recruitingbypaycor\.com/career/JobIntroduction\.action\?[^"']+)["'][^>]+ns-qa=["']([^"']+)["'][^>]*>.*?</a>\s*</div>\s*<div[^>]+class=["']gnewtonCareerGroupJobDescriptionClass["'][^>]*>(.*?)</div>""", 1, 2, 3),
    Board("pixar_jobs", r"""(?is)<a[^>]+href=["'](/job/[^"']+)["'][^>]*>.*?<h2[^>]*>(.*?)</h2>.*?<span[^>]+class=["'][^"']*\bjob-location\b[^"']*["'][^>]*>(.*?)</span>""", 1, 2, 3, r"(?is)<tr[^>]*>(.*?)</tr>"),
    Board("bayer_successfactors", r"""(?is)<a[^>]+href=["'](/job/[^"']+)["'][^>]*class=["'][^"']*\bjobTitle-link\b[^"']*["'][^>]*>(.*?)</a>.*?<td[^>]+class=["'][^"']*\bcolLocation\b[^"']*["'][^>]*>(.*?)</td>""", 1, 2, 3, r"""(?is)<tr[^>]+class=["'][^"']*\bdata-row\b[^"']*["'][^>]*>(.*?)</tr>"""),
    Board("successfactors_html", r"""(?is)<a(?=[^>]+class=["'][^"']*\bjobTitle-link\b)(?=[^>]+href=["'](/job/[^"']+)["'])[^>]*>(.*?)</a>""", 1, 2),
    Board("blackrock_jobs", r"""(?is)<a class="section3__search-results-a" href="([^"]+)"[^>]*>\s*<h2 class="section3__job-title">(.*?)</h2>.*?<span class="section3__job-info">([^<]*)</span>""", 1, 2, 3),
    Board("ycombinator_jobs", r"""(?s)\{[^{}]*"title":"([^"]+)"[^{}]*"url":"([^"]+)"[^{}]*"location":"([^"]*)\"""", 2, 1, 3),
    Board("avature_rss", r"(?is)<item>.*?<title>(.*?)</title>.*?<link>(.*?)</link>.*?</item>", 2, 1, specific=False),
]}


def board_postings(html_pages: DataFrame, board: Board, collected: str) -> DataFrame:
    """Postings of a board's pages (page_url, html, company, careers_url), by its pattern."""
    rows = html_pages.withColumn("html", crawl.unescaped("html") if board.name == "ycombinator_jobs" else F.col("html"))
    if board.row:
        rows = rows.select("page_url", "company", "careers_url", F.posexplode(F.regexp_extract_all("html", F.lit(board.row), F.lit(0))).alias("p", "html"))
    found = rows.select("page_url", "company", "careers_url", F.posexplode(F.regexp_extract_all("html", F.lit(board.pattern), F.lit(0))).alias("ord", "hit"))
    part = lambda n: F.regexp_extract("hit", board.pattern, n) if n else F.lit("")
    plain = lambda c: crawl.unescaped(F.regexp_replace(F.regexp_replace(c, r"^<!\[CDATA\[|\]\]>$", ""), "<[^>]+>", " "))
    named = found.select("ord", crawl.resolved("page_url", crawl.unescaped(part(board.url))).alias("url"), plain(part(board.title)).alias("title"),
                         plain(part(board.location)).alias("location"), F.lit("").alias("details"), "company", "careers_url").withColumn("id", F.col("url"))
    return _postings(named, board.specific, collected)


LD = "struct<`@type`:string,title:string,url:string,sameAs:string,description:string,jobLocation:string,`@graph`:array<struct<`@type`:string,title:string,url:string,sameAs:string,description:string,jobLocation:string>>>"


def json_ld_postings(html_pages: DataFrame, collected: str) -> DataFrame:
    """JobPosting records of ``ld+json`` scripts, single, in arrays or in a graph; places joined by `` | ``."""
    script = r"""(?is)<script[^>]*type=["']application/ld\+json["'][^>]*>(.*?)</script>"""
    rows = html_pages.select("page_url", "company", "careers_url", F.posexplode(F.regexp_extract_all("html", F.lit(script), F.lit(1))).alias("ord", "body"))
    body = F.when(F.trim("body").startswith("["), F.trim("body")).otherwise(F.concat(F.lit("["), F.trim("body"), F.lit("]")))
    nodes = rows.select("page_url", "company", "careers_url", "ord", F.explode(F.from_json(body, f"array<{LD}>")).alias("r"))
    flat = F.concat(F.array(F.struct(*(F.col("r").getField(c).alias(c) for c in ("@type", "title", "url", "sameAs", "description", "jobLocation")))), F.coalesce(F.col("r").getField("@graph"), F.array()))
    jobs = nodes.select("page_url", "company", "careers_url", "ord", F.posexplode(flat).alias("p", "j")).where(F.col("j").getField("@type") == "JobPosting")
    names = F.regexp_extract_all("j.jobLocation", F.lit(r'"addressLocality"\s*:\s*"([^"]+)"'), F.lit(1))
    url = crawl.resolved("careers_url", F.coalesce("j.url", "j.sameAs"))
    named = jobs.select(F.struct("ord", "p").alias("ord"), url.alias("url"), "j.title", F.array_join(F.array_distinct(names), " | ").alias("location"), F.col("j.description").alias("details"), "company", "careers_url")
    return _postings(named.withColumn("id", F.col("url")), True, collected)


RECORD_KEYS = {
    "title": ("title", "jobTitle", "job_title", "name", "positionTitle"),
    "url": ("url", "jobUrl", "job_url", "link", "applyUrl", "apply_url", "externalUrl"),
    "location": ("location", "jobLocation", "job_location", "city"),
}
RECORD_WORDS = ("intern", "student", "graduate", "summer", "/job/")


def _embedded(html: str | None) -> list:
    """The JSON values that a page embeds for its own scripts."""
    found = []
    starts = list(re.finditer(r"serverInitialData\s*=\s*(?=\{)", html or ""))
    starts += re.finditer(r"""(?i)<script[^>]*id=["']__NEXT_DATA__["'][^>]*>\s*""", html or "")
    for start in starts:
        for body in (html[start.end():], unescape(html[start.end():])):
            try:
                found.append(json.JSONDecoder().raw_decode(body)[0])
                break
            except ValueError:
                continue
    return found


def _nodes(value) -> Iterator[dict]:
    """Every object inside a JSON value, outer ones first."""
    left = [value]
    while left:
        node = left.pop()
        if isinstance(node, dict):
            yield node
        if isinstance(node, (dict, list)):
            left.extend(reversed(list(node.values() if isinstance(node, dict) else node)))


def _first(node: dict, keys: tuple[str, ...]) -> str:
    """The first key's text, or the name or title of its object."""
    for key in keys:
        value = node.get(key)
        if isinstance(value, dict):
            value = value.get("name") or value.get("title")
        if isinstance(value, str) and value.strip():
            return value.strip()
    return ""


def _records(*fields: str) -> T.ArrayType:
    return T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in fields]))


@F.pandas_udf(_records("title", "url", "location"))
def job_records(html: pd.Series) -> pd.Series:
    def one(page: str | None) -> list[dict]:
        records = [(n, {f: _first(n, keys) for f, keys in RECORD_KEYS.items()}) for value in _embedded(page) for n in _nodes(value)]
        said = lambda n: " ".join(str(n.get(k, "")) for k in ("title", "jobTitle", "name", "url", "jobUrl")).lower()
        return [r for n, r in records if r["title"] and r["url"] and any(w in said(n) for w in RECORD_WORDS)]

    return html.map(one)


@F.pandas_udf(_records("title", "url", "location", "kind", "details"))
def lemonade_records(html: pd.Series) -> pd.Series:
    def one(page: str | None) -> list[dict]:
        lists = [n["allRecipes"] for value in _embedded(page) for n in _nodes(value) if isinstance(n.get("allRecipes"), list)]
        if not lists:
            raise FeedError("the page's complete role list was not found")
        text_of = lambda r, *keys: next((str(r[k]) for k in keys if r.get(k)), "")
        return [
            {"title": text_of(r, "title", "pageTitle"), "url": text_of(r, "link"), "location": text_of(r, "location"), "kind": text_of(r, "employmentType"),
             "details": f"{text_of(r, 'employmentType')} {text_of(r, 'content')}"} for r in lists[0] if isinstance(r, dict)
        ]

    return html.map(one)


def embedded_json_postings(html_pages: DataFrame, collected: str) -> DataFrame:
    """Job records of the data that a page embeds for its own scripts, at any depth."""
    rows = html_pages.select("company", "careers_url", F.posexplode(job_records("html")).alias("ord", "r"))
    named = rows.select("ord", crawl.resolved("careers_url", "r.url").alias("url"), "r.title", "r.location", F.lit("").alias("details"), "company", "careers_url")
    return _postings(named.withColumn("id", F.col("url")), True, collected)


def lemonade_postings(html_pages: DataFrame, collected: str) -> DataFrame:
    """The roles of the list ``allRecipes`` in a page's embedded data; their employment type counts for the test."""
    rows = html_pages.select("company", "careers_url", F.posexplode(lemonade_records("html")).alias("ord", "r"))
    named = rows.select("ord", crawl.resolved("careers_url", "r.url").alias("url"), "r.title", "r.location", "r.details", "r.kind", "company", "careers_url")
    fit = listing.classified(F.concat_ws(" ", "title", "kind"), F.col("url"))["is_specific"]
    return _postings(named.where(fit).withColumn("id", F.col("url")), None, collected)


CLOSED = ["no longer accepting", "no longer available", "position has been filled", "job is closed", "applications are closed"]
EVIDENCE = ["apply now", "responsibilities", "qualifications", "requirements", "job description", "how to apply"]


def semantic_postings(html_pages: DataFrame, collected: str) -> DataFrame:
    """Pages that are one job themselves: a specific first heading, evidence of a job, not closed."""
    rows = html_pages.withColumns({"title": F.regexp_replace(F.regexp_extract("html", r"(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", " "), "details": crawl.semantic_text(F.col("html"))})
    low = F.lower("details")
    place = F.regexp_extract("details", r"(?i)(?:^|\n)\s*locations?(?:\(s\))?\s*:?\s*\n?([^\n]+)", 1)
    rows = rows.where(urls.contains_any(low, EVIDENCE) & ~urls.contains_any(low, CLOSED) & (F.trim("title") != ""))
    named = rows.select(F.lit(0).alias("ord"), F.col("page_url").alias("id"), F.col("page_url").alias("url"), crawl.unescaped("title").alias("title"), place.alias("location"), "details", "company", "careers_url")
    return _postings(named, True, collected)


def pwc_postings(html_pages: DataFrame, collected: str) -> DataFrame:
    """Every /job/ path anywhere in a page; title and location are the path's."""
    paths = F.array_sort(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?i)/job/[^"'\s<>]+"""), F.lit(0))))
    rows = html_pages.select("company", "careers_url", F.posexplode(paths).alias("ord", "way"))
    slug = F.split_part(F.element_at(F.split("way", "/"), -1), F.lit("?"), F.lit(1))
    title = F.replace(F.replace(slug, F.lit("---"), F.lit(" - ")), F.lit("_"), F.lit(" "))
    place = F.coalesce(F.try_element_at(F.filter(F.split("way", "/"), lambda p: ~p.isin("", "job")), F.lit(1)), F.lit(""))
    place = F.replace(F.regexp_replace(place, "^[^-]*-", ""), F.lit("-"), F.lit(" "))
    named = rows.select("ord", crawl.resolved("careers_url", "way").alias("url"), title.alias("title"), place.alias("location"), F.lit("").alias("details"), "company", "careers_url")
    return _postings(named.withColumn("id", F.col("url")), True, collected)


def wix_postings(html_pages: DataFrame, collected: str) -> DataFrame:
    """Position pages, each one job: og:title, else the title, without the site's name."""
    og = r"""(?i)property=["']og:title["'][^>]*content=["']([^"']+)["']|content=["']([^"']+)["'][^>]*property=["']og:title["']"""
    named = [F.nullif(F.regexp_extract("html", og, n), F.lit("")) for n in (1, 2)]
    title = F.coalesce(*named, F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    title = F.regexp_replace(F.trim(crawl.unescaped(F.regexp_replace(title, "<[^>]+>", " "))), r" \| Wix(?: Careers)?$", "")
    rows = html_pages.select(F.lit(0).alias("ord"), F.col("page_url").alias("id"), F.col("page_url").alias("url"), title.alias("title"), F.lit("").alias("location"), F.lit("").alias("details"), "company", "careers_url")
    return _postings(rows.where("title <> ''"), True, collected)


def direct_posting(sources: DataFrame, collected: str) -> DataFrame:
    """Sources whose own address is one job: the title is the address's words."""
    slug = F.regexp_extract(F.regexp_replace(urls.path(F.col("careers_url")), "/+$", ""), r"([^/]*[A-Za-z][^/]*)(?:/[0-9]+)?$", 1)
    title = F.initcap(F.trim(F.regexp_replace(F.regexp_replace(slug, "[-_]+", " "), r"\b\d+\b", "")))
    named = sources.where(urls.is_direct_source(F.col("careers_url"))).select(
        F.lit(0).alias("ord"), F.col("careers_url").alias("id"), F.col("careers_url").alias("url"), title.alias("title"), F.lit("").alias("location"), F.lit("").alias("details"), "company", "careers_url")
    return _postings(named, True, collected)


def notion_postings(payloads: DataFrame, collected: str) -> DataFrame:
    """Live child pages of a public page's block map (payload, company, careers_url)."""
    block = "struct<value:struct<type:string,alive:boolean,parent_id:string,properties:struct<title:string>>>"
    rows = payloads.select("company", "careers_url", F.explode(F.from_json(F.get_json_object("payload", "$.recordMap.block"), f"map<string,{block}>")).alias("id", "b"))
    plain = lambda c: F.replace(c, F.lit("-"), F.lit(""))
    root = F.regexp_extract(F.split_part("careers_url", F.lit("?"), F.lit(1)), "([0-9a-f]{32})$", 1)
    rows = rows.where((F.col("b.value.type") == "page") & F.col("b.value.alive") & (plain(F.col("b.value.parent_id")) == root))
    named = rows.select(F.lit(0).alias("ord"), "id", F.concat(F.regexp_extract("careers_url", "^[a-z]+://[^/]+/", 0), plain(F.col("id"))).alias("url"),
                        F.regexp_extract("b.value.properties.title", r'\[\["([^"]*)"', 1).alias("title"), F.lit("").alias("location"), F.lit("").alias("details"), "company", "careers_url")
    return _postings(named, False, collected)


def sitemap_urls(pages_: DataFrame) -> DataFrame:
    """(company, careers_url, url): job pages that a sitemap lists, once each; over MOST_PAGES of a source is an error, as in :func:`pages`."""
    rows = pages_.select("company", "careers_url", F.posexplode(F.regexp_extract_all("html", F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1))).alias("ord", "url"))
    rows = rows.where(F.lower("url").rlike(r"/(?:positions?|jobs?)/")).dropDuplicates(["careers_url", "url"])
    rows = rows.withColumn("_n", F.count("*").over(Window.partitionBy("careers_url")))
    few = F.assert_true(F.col("_n") <= MOST_PAGES, F.lit(f"a sitemap lists more than {MOST_PAGES} job pages"))
    return rows.where(few.isNull()).select("company", "careers_url", "url")


def confirmed_empty(html_pages: DataFrame, *markers: str) -> DataFrame:
    """Pages of closed or parked sources: each must hold a marker, in its text or its HTML without blanks, and gives no posting."""
    said = F.concat_ws("\n", F.lower(crawl.semantic_text(F.col("html"))), F.lower(F.regexp_replace("html", r"\s+", "")))
    closed = F.assert_true(urls.contains_any(said, list(markers)), F.lit("the page no longer says that it is closed"))
    return html_pages.where(closed.isNotNull())


def strategies(company: Column, careers_url: Column, source_type: Column, collector: Column) -> Column:
    """The connectors that a source is tried with, in order."""
    site, name = urls.host(careers_url), text.normalized(company)
    on = lambda domain: (site == domain) | site.endswith(f".{domain}")
    names = lambda *values: F.array(*map(F.lit, values))
    four = ("json_ld", "embedded_json", "semantic_detail")
    chosen = (
        F.when(collector.isin("blackrock_jobs", "pwc_jobs"), F.concat(F.array(collector), names(*four)))
        .otherwise(F.array(collector))
    )
    return (
        F.when((F.coalesce(collector, F.lit("")) != "") & (collector != "auto"), chosen)
        .when(on("myworkdayjobs.com"), names("workday_api", "embedded_json", "generic_links"))
        .when(on("greenhouse.io"), names("greenhouse_api", "json_ld", "embedded_json", "generic_links"))
        .when(on("lever.co"), names("lever_api", "embedded_json", "generic_links"))
        .when(on("ashbyhq.com"), names("ashby_api", "embedded_json", "generic_links"))
        .when(on("breezy.hr"), names("breezy_html", "json_ld", "embedded_json", "generic_links"))
        .when(on("teamtailor.com"), names("teamtailor_html", *four, "generic_links"))
        .when(on("recruitingbypaycor.com"), names("paycor_html"))
        .when((name == "blackrock") | site.contains("careers.blackrock.com"), names("blackrock_jobs", *four))
        .when((name == "bakar bio labs") | site.contains("jobs.bakarlabs.org"), names("consider_board"))
        .when((name == "pwc") | site.contains("jobs-us.pwc.com"), names("pwc_jobs", *four, "generic_links"))
        .when((name == "mckinsey & co") | site.contains("mckinsey.com"), names("mckinsey_jobs", *four, "generic_links"))
        .when(source_type == "job_board", names("embedded_json", "semantic_detail", "generic_links"))
        .otherwise(names(*four, "generic_links"))
    )


#: Connectors that read HTML pages; those of one rule share a function.
HTML_READERS: dict[str, Callable[[DataFrame, str], DataFrame]] = {
    "json_ld": json_ld_postings, "embedded_json": embedded_json_postings, "lemonade_jobs": lemonade_postings, "semantic_detail": semantic_postings,
    "pwc_jobs": pwc_postings, "generic_links": lambda p, d: crawl.link_postings(p, d), "breezy_html": lambda p, d: crawl.link_postings(p, d),
    "teamtailor_html": lambda p, d: crawl.link_postings(p, d), "profusa_careers": lambda p, d: crawl.link_postings(p, d), "wix_positions": wix_postings,
    "closed_company": lambda p, d: json_ld_postings(confirmed_empty(p, "company is no longer operating"), d), "parked_company_domain": lambda p, d: json_ld_postings(confirmed_empty(p, 'window.location.href="/lander"', "window.location.href='/lander'"), d),
    **{name: (lambda p, d, b=board: board_postings(p, b, d)) for name, board in BOARDS.items()},
}


def read_html(name: str, html_pages: DataFrame, collected: str) -> DataFrame:
    return HTML_READERS[name](html_pages, collected)


def read_feed(name: str, payloads: DataFrame, collected: str) -> DataFrame:
    """A JSON connector's postings; a parent company's feed is cut to the label of its child."""
    if name == "notion_public_page":
        return notion_postings(payloads, collected)
    if name == "cyberark_parent_workday":
        return feed_postings(payloads, FEEDS["workday_api"], collected).where(F.lower(F.concat_ws(" ", "title", "posting_url")).contains("cyberark"))
    return feed_postings(payloads, FEEDS[name], collected)


def request(base: str, **values: object) -> str:
    """An address with the given query values added to its own."""
    parts = urlsplit(base)
    query = {k: v[0] for k, v in parse_qs(parts.query).items()} | {k: str(v) for k, v in values.items()}
    return parts._replace(query=urlencode(query)).geturl()


def search_payload(payloads: DataFrame, kind: str, limit: int = 5) -> DataFrame:
    """Results of a search service's JSON (payload, query, date_searched): ``tavily`` or ``google``."""
    path, link, said = {"tavily": ("$.results", "url", "content"), "google": ("$.items", "link", "snippet")}[kind]
    record = F.from_json(F.get_json_object("payload", path), f"array<struct<title:string,{link}:string,{said}:string>>")
    rows = payloads.select("query", "date_searched", F.posexplode(F.slice(record, 1, limit)).alias("ord", "r"))
    return rows.select("ord", F.col("r.title").alias("title"), urls.search_target(F.col(f"r.{link}")).alias("url"), F.col(f"r.{said}").alias("snippet"), F.lit(kind).alias("provider"), "query", "date_searched").where("url <> ''")


def search_page(html_pages: DataFrame, limit: int = 5) -> DataFrame:
    """Results of a search engine's HTML page (html, query, date_searched), first per address."""
    hit = r"""(?is)<a[^>]+class=["'][^"']*result__a[^"']*["'][^>]*href=["']([^"']*)["'][^>]*>(.*?)</a>(?:(?!result__a).)*"""
    said = r"""(?is)class=["'][^"']*result__snippet[^"']*["'][^>]*>(.*?)</a>"""
    rows = html_pages.select("query", "date_searched", F.posexplode(F.regexp_extract_all("html", F.lit(hit), F.lit(0))).alias("ord", "h"))
    plain = lambda c: text.clean_text(crawl.unescaped(F.regexp_replace(c, "<[^>]+>", "")))
    rows = rows.select(
        "ord", plain(F.regexp_extract("h", hit, 2)).alias("title"), urls.search_target(crawl.unescaped(F.regexp_extract("h", hit, 1))).alias("url"),
        plain(F.regexp_extract("h", said, 1)).alias("snippet"), F.lit("duckduckgo").alias("provider"), "query", "date_searched",
    )
    first = Window.partitionBy("query", "url").orderBy("ord")
    rows = rows.where("url <> ''").withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    best = Window.partitionBy("query").orderBy("ord")
    return rows.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= limit).drop("_n")


