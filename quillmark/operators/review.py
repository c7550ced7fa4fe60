"""The review dashboard: a star of lookups around the included postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import places, text
from .dedupe import last_of_each, with_order
from .scoring import is_recommended
from .screening import disliked

STATUSES = ["to_review", "applied", "not_interested", "archived"]


def email_status(included: Column, scored: Column, sent: Column, inactive: Column) -> Column:
    return (
        F.when(~included, F.lit("excluded")).when(sent, F.lit("emailed")).when(inactive, F.lit("inactive"))
        .when(~scored, F.lit("not_scored")).otherwise(F.lit("ready"))
    )


def _flag(rows: DataFrame, urls: DataFrame, name: str) -> DataFrame:
    """``name``: is the posting's address among ``urls``?"""
    keys = urls.select("posting_url").distinct().withColumn(name, F.lit(True))
    return rows.join(keys, "posting_url", "left").withColumn(name, F.coalesce(name, F.lit(False)))


def reviewable(
    filtered: DataFrame, scored: DataFrame, reviews: DataFrame, notes: DataFrame, connections: DataFrame, new: DataFrame,
    sent: DataFrame, inactive: DataFrame, dislikes: list[str], markers: list[str], suggestions: DataFrame | None = None,
    monitored: DataFrame | None = None,
) -> DataFrame:
    """Included postings allowed by dislikes and location, with all that is known about them, in review order.

    Every lookup is a left join on an address or a company after the lookup is
    cut to one row a key; the optimizer broadcasts those that are small.
    """
    details = F.coalesce(F.col("eligibility_text"), F.lit(""))
    rows = filtered.where(F.col("included") & (F.size(disliked(F.col("title"), dislikes)) == 0)
                          & places.allowed(F.col("location"), F.col("title"), details, markers))
    last = lambda df, *keep: last_of_each(with_order(df), "posting_url").select("posting_url", *keep)
    rows = rows.join(last(scored, "score", "fit_level", "explanations", "gaps"), "posting_url", "left")
    rows = rows.join(last(reviews, F.col("status").alias("_review")), "posting_url", "left")
    rows = rows.join(last(notes, F.col("notes")), "posting_url", "left").join(connections, "company", "left")
    for table, name in ((new, "is_new"), (sent, "_sent"), (inactive, "_inactive")):
        rows = _flag(rows, table, name)
    if suggestions is not None:
        known = last_of_each(with_order(suggestions.withColumn("_name", text.normalized(F.col("name")))), "_name")
        if monitored is not None:
            own = monitored.select(text.normalized(F.col("name")).alias("_name")).distinct()
            known = known.join(own, "_name", "left_anti")
        overview = F.struct(F.col("name").alias("company_name"), "reason", "source").alias("suggested_company_overview")
        rows = rows.withColumn("_name", text.normalized(F.col("company"))).join(known.select("_name", overview), "_name", "left").drop("_name")
    has_score = F.col("score").isNotNull()
    rows = rows.withColumns({
        "has_connection": F.coalesce("has_connection", F.lit(False)), "notes": F.coalesce("notes", F.lit("")),
        "review_status": text.review_status(F.coalesce("_review", F.lit(""))),
        "email_status": email_status(F.col("included"), has_score, F.col("_sent"), F.col("_inactive")),
        "recommended": F.coalesce(is_recommended(F.col("score"), F.col("fit_level")), F.lit(False)),
    })
    rows = rows.withColumns({
        "summary": text.factual_summary(F.col("title"), F.col("company"), F.col("location"), F.col("notes")),
        "highlights": text.factual_highlights(F.col("title"), F.col("location")),
        "display_location": places.allowed_summary(F.col("location"), details, markers),
        "section": section(),
    })
    return rows.drop("_review", "_sent", "_inactive").orderBy(*review_order())


def review_order() -> list[Column]:
    """Rows still to review come last, as false sorts before true."""
    return [
        F.col("review_status") == "to_review", ~F.col("included"), F.col("email_status") != "ready",
        F.desc(F.coalesce("score", F.lit(0))), F.col("company"), F.col("title"),
    ]


def section() -> Column:
    """Which of the page's five disjoint sections shows a row."""
    status = F.col("review_status")
    return (
        F.when(status == "applied", F.lit("applied")).when(status == "not_interested", F.lit("not_interested"))
        .when(status == "archived", F.lit("archived")).when(F.col("recommended"), F.lit("recommended")).otherwise(F.lit("other"))
    )


def filtered_view(rows: DataFrame, filters: dict[str, str], markers: list[str] | None = None) -> DataFrame:
    """Rows that meet every given filter; a missing one or ``any`` has no effect."""
    asked = {k: v for k, v in filters.items() if v and v != "any"}
    tests = [F.lit(True)]
    for key in ("review_status", "company", "email_status"):
        if key in asked:
            tests.append(F.col(key) == asked[key])
    link = asked.get("connection")
    if link in ("connected", "no_connection"):
        tests.append(F.col("has_connection") == F.lit(link == "connected"))
    if asked.get("included") in ("included", "excluded"):
        tests.append(F.col("included") == F.lit(asked["included"] == "included"))
    if markers is not None:
        tests.append(places.allowed(F.col("location"), F.col("title"), F.lit(""), markers))
    return rows.where(reduce(lambda a, b: a & b, tests))


def parsed_filters(query: dict[str, list[str]]) -> dict[str, str]:
    """The first value of each filter of a query string."""
    keys = ("review_status", "company", "connection", "email_status", "included", "location")
    return {k: query[k][0] for k in keys if query.get(k) and query[k][0]}


def summary(rows: DataFrame) -> DataFrame:
    """Eight counts in one pass."""
    count = lambda condition, name: F.count_if(condition).alias(name)
    return rows.agg(
        F.count("*").alias("total"), count(F.col("included"), "included"), count(~F.col("included"), "excluded"),
        count(F.col("has_connection"), "connected"), count(F.col("email_status") == "ready", "email_ready"),
        count(F.col("email_status") == "emailed", "emailed"), count(F.col("is_new"), "new_postings"),
        count(F.col("review_status") == "to_review", "to_review"),
    )


def company_overview(companies: DataFrame, sources: DataFrame, postings: DataFrame, errors: DataFrame) -> DataFrame:
    """A user's companies with careers page, internships found and last source issue."""
    name = lambda c: text.normalized(F.col(c))
    pages = last_of_each(with_order(sources), "company").select(F.col("company").alias("name"), "careers_url")
    found = postings.groupBy(name("company").alias("_key")).agg(F.count("*").alias("internships_found"))
    keyed = with_order(errors).withColumn("_key", name("company"))
    issues = last_of_each(keyed, "_key").select("_key", F.col("message").alias("source_issue"))
    rows = companies.withColumn("_key", name("name")).join(pages, "name", "left").join(found, "_key", "left").join(issues, "_key", "left")
    return rows.select(
        "name", "website", F.coalesce("careers_url", "website").alias("careers_url"), "has_connection", "connection_name",
        F.coalesce("internships_found", F.lit(0)).alias("internships_found"), F.coalesce("source_issue", F.lit("")).alias("source_issue"),
    )


def open_suggestions(suggestions: DataFrame, companies: DataFrame, dismissed: DataFrame) -> DataFrame:
    """Suggestions that are neither a user's company nor dismissed."""
    rows = suggestions.withColumn("_key", text.normalized(F.col("name")))
    for table in (companies, dismissed):
        rows = rows.join(table.select(text.normalized(F.col("name")).alias("_key")).distinct(), "_key", "left_anti")
    return rows.drop("_key")


def activity(events: DataFrame, limit: int | None = 1000) -> DataFrame:
    """The last events, newest first (all of them, in no order, without a limit), with type, call flag and cost.

    ``api_invoked`` and ``cost`` come from the event, else its details, else
    are inferred; ``details`` is JSON text; ``ord`` is the order of writing.
    """
    at = lambda p: F.get_json_object("details", p)
    called = F.coalesce("api_invoked", at("$.api_invoked").cast("boolean"), (F.col("action") == "scoring") & F.coalesce(at("$.provider") == "gemini", F.lit(False)))
    tokens = F.coalesce(at("$.total_tokens").cast("long"), F.coalesce(at("$.prompt_tokens").cast("long"), F.lit(0)) + F.coalesce(at("$.output_tokens").cast("long"), F.lit(0)))
    counted = at("$.total_tokens").isNotNull() | at("$.prompt_tokens").isNotNull()
    free = F.to_json(F.struct(F.lit(0.0).alias("amount"), F.lit("USD").alias("currency"), F.concat(F.lit("Gemini API free tier ("), tokens, F.lit(" tokens)")).alias("basis")))
    cost = F.coalesce("cost", at("$.cost"), F.when(called & counted, free).otherwise(F.lit('{"status":"unavailable"}')))
    rows = with_order(events).withColumns({"activity_type": text.activity_type(F.col("action")), "cost": cost}).withColumn("api_invoked", called)
    return rows if limit is None else rows.orderBy(F.desc("ord")).limit(limit)


def activity_between(events: DataFrame, kind: str | None, first: str | None, last: str | None) -> DataFrame:
    """Events of a type within a range of dates, both ends included."""
    rows = events if not kind or kind == "all" else events.where(F.col("activity_type") == kind)
    rows = rows.where(F.col("date") >= first) if first else rows
    return rows.where(F.col("date") <= last) if last else rows
