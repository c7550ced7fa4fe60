"""The weekly digest: which postings are sent, and how they are grouped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places
from .scoring import is_recommended


def selected(scored: DataFrame, sent: DataFrame, blocked: DataFrame, markers: list[str]) -> DataFrame:
    """Recommended postings in an allowed place, neither sent nor blocked, best first."""
    rows = scored.where(is_recommended(F.col("score"), F.col("fit_level"))
                        & places.allowed(F.col("location"), F.col("title"), F.lit(""), markers))
    for table in (sent, blocked):
        rows = rows.join(table.select("posting_url").distinct(), "posting_url", "left_anti")
    return rows.orderBy(F.desc("score"), "company", "title")


def grouped(scored: DataFrame) -> DataFrame:
    """Per company, fit levels in the order they are first seen, each with its titles."""
    levels = scored.groupBy("company", "fit_level").agg(F.min("ord").alias("first"), F.array_sort(F.collect_list(F.struct("ord", "title"))).alias("rows"))
    return levels.select("company", "fit_level", "first", F.transform("rows", lambda r: r["title"]).alias("titles")).orderBy("company", "first")


def subject(postings: Column, errors: Column) -> Column:
    """The subject line for so many postings and source errors."""
    noun = F.when(postings == 1, F.lit("match")).otherwise(F.lit("matches"))
    warned = F.when(errors > 0, F.concat(F.lit(" ("), errors, F.lit(" source "), F.when(errors == 1, F.lit("issue")).otherwise(F.lit("issues")), F.lit(")"))).otherwise(F.lit(""))
    return F.concat(F.lit("Weekly internship summary: "), postings, F.lit(" "), noun, warned)


def send_status(requested: bool, recipient: str, error: str | None = None) -> str:
    if not requested:
        return "Not sent: drafting only."
    if not recipient:
        return "Not sent: no recipient is set."
    return f"Not sent: {error}" if error else f"Sent to {recipient}."


def new_count(postings: DataFrame, new: DataFrame) -> DataFrame:
    return postings.join(new.select("posting_url").distinct(), "posting_url", "left_semi").agg(F.count("*").alias("n"))


def best_first(scored: DataFrame) -> DataFrame:
    """The one posting to review first."""
    return scored.orderBy(F.desc("score"), "company", "title").limit(1)


def sent_union(sent: DataFrame, now: DataFrame) -> DataFrame:
    return sent.select("posting_url").union(now.select("posting_url")).distinct()
