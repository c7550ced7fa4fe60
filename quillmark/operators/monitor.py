"""Companies without openings, and connections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .dedupe import first_of_each, last_of_each, with_order

STATUS = "monitored_no_openings"


def latest_date(postings: DataFrame) -> DataFrame:
    """One row: the largest collection date, empty if there is none."""
    return postings.agg(F.coalesce(F.max(F.when(F.col("date_collected") != "", F.col("date_collected"))), F.lit("")).alias("date_checked"))


def without_openings(sources: DataFrame, filtered: DataFrame, postings: DataFrame, errors: DataFrame, checked: str = "") -> DataFrame:
    """Sources whose company has no included posting, with counts, last error and reason.

    An anti join, and left joins to counts aggregated before.
    """
    included = filtered.where("included").select("company").distinct()
    collected = postings.groupBy("company").agg(F.count("*").alias("candidates_collected"))
    excluded = filtered.where("not included").groupBy("company").agg(F.count("*").alias("excluded_pages"))
    failed = last_of_each(with_order(errors), "company").select("company", F.col("message").alias("collection_error"))
    day = F.lit(checked or latest_date(postings).first()[0])
    rows = sources.join(included, "company", "left_anti").join(collected, "company", "left")
    rows = rows.join(excluded, "company", "left").join(failed, "company", "left")
    n, pages, error = F.coalesce("candidates_collected", F.lit(0)), F.coalesce("excluded_pages", F.lit(0)), F.coalesce("collection_error", F.lit(""))
    reason = (
        F.when(error != "", F.concat(F.lit("Collection failed: "), error))
        .when(pages > 0, F.concat(F.lit("Found "), pages, F.lit(" page(s), but none were specific internship listings.")))
        .when(n > 0, F.lit("Collected candidates did not qualify as specific internship listings."))
        .otherwise(F.lit("No internship posting candidates found on the careers source."))
    )
    return rows.select(
        "company", "website", "careers_url", "has_connection", F.lit(STATUS).alias("status"), reason.alias("reason"),
        n.alias("candidates_collected"), pages.alias("excluded_pages"), error.alias("collection_error"), day.alias("date_checked"),
    ).orderBy(F.lower("company"))


def connections(sources: DataFrame, companies: DataFrame) -> DataFrame:
    """(company, has_connection): a company's last source, and its own list over that."""
    last = last_of_each(with_order(sources), "company").select("company", F.col("has_connection").alias("_source"))
    own = last_of_each(with_order(companies), "name").select(F.col("name").alias("company"), F.col("has_connection").alias("_own"))
    both = last.join(own, "company", "full_outer")
    return both.select("company", F.coalesce("_own", "_source", F.lit(False)).alias("has_connection"))


def first_connection(sources: DataFrame) -> DataFrame:
    return first_of_each(with_order(sources), "company").select("company", F.coalesce("has_connection", F.lit(False)).alias("has_connection"))
