"""Statuses and counts of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_status(steps: DataFrame, *keys: str) -> DataFrame:
    """Per run: any failed step makes it failed, any warning partial, else success."""
    status = (
        F.when(F.bool_or(F.col("status") == "failed"), F.lit("failed"))
        .when(F.bool_or(F.col("status") == "warning"), F.lit("partial")).otherwise(F.lit("success"))
    )
    return steps.groupBy(*keys).agg(status.alias("status"), F.count("*").alias("steps"))


def operational(runs: DataFrame, need_email: bool = False) -> DataFrame:
    """Runs that did their work: not failed and, if asked, with the email sent."""
    sent = F.exists("steps", lambda s: (s["name"] == "email") & (s["status"] == "success"))
    return runs.where((F.col("status") != "failed") & (sent if need_email else F.lit(True)))


def once_a_week(events: DataFrame, day: str, *keys: str) -> DataFrame:
    """The first event of each week (from Monday) per key."""
    week = F.date_trunc("week", F.col(day))
    fields = F.struct(*events.columns)
    return events.groupBy(*keys, week.alias("week")).agg(F.min_by(fields, F.struct(day, *keys)).alias("r")).select("r.*", "week")


def by_provider(postings: DataFrame) -> DataFrame:
    return postings.groupBy("provider").agg(F.count("*").alias("n")).orderBy("provider")


def by_company(postings: DataFrame) -> DataFrame:
    return postings.groupBy("company").agg(F.count("*").alias("n")).orderBy("company")
