"""Search results: relevance, best and alternate careers pages, job boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import metadata, text, urls


def relevance(title: Column, url: Column, snippet: Column, company: Column) -> Column:
    """The score of a result for a company; -100 on a blocked domain."""
    body, site = F.lower(F.concat_ws(" ", title, url, snippet)), urls.host(url)
    tokens = F.filter(F.split(F.lower(company), "[^a-z0-9]+"), lambda t: F.length(t) > 2)
    own = F.exists(tokens, lambda t: F.contains(site, t))
    dots = F.length(site) - F.length(F.replace(site, F.lit("."), F.lit("")))
    points = lambda condition, n: F.when(condition, F.lit(n)).otherwise(F.lit(0))
    total = (
        points(urls.contains_any(body, L.CAREER_KEYWORDS), 20) + points(own, 25) + points(dots <= 2, 5)
        + points(F.lower(snippet).contains("official"), 3)
    )
    return F.when(urls.is_blocked_host(site), F.lit(-100)).otherwise(total)


def ranked_results(results: DataFrame, company: Column | None = None) -> DataFrame:
    """Results with their relevance, best first, then by title."""
    firm = F.lit("") if company is None else company
    score = relevance(F.col("title"), F.col("url"), F.col("snippet"), firm)
    return results.withColumn("relevance_score", score).orderBy(F.desc("relevance_score"), "title")


def by_company(results: DataFrame) -> DataFrame:
    """Results with the normalised company that their query names."""
    return results.withColumn("company_key", text.normalized(text.company_of_query(F.col("query")))).where("company_key <> ''")


def best_page(results: DataFrame, least: int = 15) -> DataFrame:
    """Per company_key the first result in (-score, url) that qualifies.

    It must reach ``least`` and be a job or search page, or exceed it by 10.
    """
    page = urls.is_job_posting(F.col("url")) | urls.is_careers_search(F.col("url"))
    score = F.col("relevance_score")
    order = Window.partitionBy("company_key").orderBy(F.desc("relevance_score"), "url")
    fit = results.where((score >= least) & (page | (score >= least + 10)))
    return fit.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def alternate_pages(results: DataFrame, best: DataFrame, least: int = 15) -> DataFrame:
    """(company_key, urls): other job and search pages, in stored order, once each."""
    page = urls.is_job_posting(F.col("url")) | urls.is_careers_search(F.col("url"))
    fit = results.where((F.col("relevance_score") >= least) & page)
    fit = fit.join(best.select("company_key", F.col("url").alias("_best")), "company_key", "left")
    fit = fit.where(F.col("_best").isNull() | (F.col("url") != F.col("_best")))
    first = fit.groupBy("company_key", "url").agg(F.min("ord").alias("ord"))
    listed = F.array_sort(F.collect_list(F.struct("ord", "url")))
    return first.groupBy("company_key").agg(F.transform(listed, lambda x: x["url"]).alias("urls"))


def replaces(current: Column, candidate: Column, score: Column) -> Column:
    """Should a candidate page take a source's place?"""
    better = relevance(F.lit(""), current, F.lit(""), F.lit("")) + 10
    return (candidate != current) & (
        (urls.is_job_posting(candidate) & ~urls.is_job_posting(current))
        | (urls.is_careers_search(candidate) & ~urls.is_careers_search(current)) | (score >= better)
    )


def enriched_registry(sources: DataFrame, results: DataFrame, least: int = 15) -> DataFrame:
    """Sources with better careers pages and alternates found by search; others as they are."""
    scored = by_company(results).withColumn("relevance_score", relevance(
        F.col("title"), F.col("url"), F.col("snippet"), text.company_of_query(F.col("query"))
    ))
    best = best_page(scored, least)
    others = alternate_pages(scored, best, least)
    rows = sources.withColumn("company_key", text.normalized(F.col("company")))
    rows = rows.join(best.select("company_key", F.col("url").alias("_url"), F.col("relevance_score").alias("_score")), "company_key", "left")
    rows = rows.join(others, "company_key", "left")
    new = F.when(F.col("_url").isNotNull() & replaces(F.col("careers_url"), F.col("_url"), F.col("_score")), F.col("_url"))
    note = F.concat(F.lit("Careers URL updated from search: "), new, F.lit("."))
    every = F.array_distinct(F.concat(F.coalesce("alternate_careers_urls", F.array().cast("array<string>")), F.coalesce("urls", F.array().cast("array<string>"))))
    final = F.coalesce(new, F.col("careers_url"))
    return rows.withColumns({
        "notes": F.when(new.isNotNull(), text.appended_note(F.col("notes"), note)).otherwise(F.col("notes")),
        "alternate_careers_urls": F.filter(every, lambda u: (u != "") & (u != final)),
    }).withColumn("careers_url", final).drop("company_key", "_url", "_score", "urls")


def board_postings(results: DataFrame, least: int = 18) -> DataFrame:
    """Job-board postings of search results: first per id, by title, ``least`` at most."""
    link = urls.search_target(F.col("url"))
    rows = results.where(metadata.is_board_result(F.col("title"), F.col("url"), F.col("snippet")) & urls.is_public_board(F.col("url")))
    rows = rows.withColumn("posting_url", F.when(urls.is_aggregator(link), urls.canonical(link)).otherwise(link))
    parsed = metadata.board_title(text.clean_title(F.col("title")), F.col("posting_url"))
    firm = F.when(parsed["company"] != "", parsed["company"]).otherwise(metadata.board_company(F.col("title"), F.col("url")))
    place = metadata.place_of_snippet(F.col("snippet"))
    rows = rows.select(
        "ord", parsed["title"].alias("title"), firm.alias("company"), F.when(place != "", place).otherwise(F.lit("Unknown")).alias("location"),
        "posting_url", urls.stable_id(F.col("posting_url"), parsed["title"], F.col("provider")).alias("posting_id"),
        text.clean_title(F.col("snippet")).alias("snippet"), "provider", "query", "date_searched",
    )
    first = Window.partitionBy("posting_id").orderBy("ord")
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n", "ord")
    return rows.orderBy(F.lower("title"), "posting_id").limit(least)


def as_postings(boards: DataFrame, collected: str) -> DataFrame:
    """Job-board postings as postings, missing fields filled from their snippets."""
    better = metadata.enriched(F.col("title"), F.col("company"), F.col("location"), F.col("posting_url"), F.col("snippet"))
    return boards.withColumns(better).select(
        "title", "company", "location", "posting_url", F.lit(collected).alias("date_collected"),
        F.concat(F.lit("job-board://"), "provider").alias("source_url"), F.lit("").alias("eligibility_text"),
    )


def platform_counts(postings: DataFrame) -> DataFrame:
    return postings.groupBy(urls.platform(F.col("posting_url")).alias("platform")).agg(F.count("*").alias("n"))
