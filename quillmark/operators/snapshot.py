"""Run-over-run changes: new, changed, seen, missing, duplicate."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, urls
from ..sources.schemas import CHANGE, HISTORY
from .dedupe import first_of_each, one_per_role, with_order

CHANGE_FIELDS = [c.split()[0] for c in CHANGE.split(", ")]
HISTORY_FIELDS = [c.split()[0] for c in HISTORY.split(", ")]


@dataclass(frozen=True)
class Detection:
    """Changes of a run, its new postings, and the history that the next run starts from."""

    changes: DataFrame
    new_postings: DataFrame
    history: DataFrame


def detect_changes(current: DataFrame, history: DataFrame) -> Detection:
    """Compares this run's postings with the history.

    A posting meets the history's row of its id; failing that, the first row of
    its role. Unmatched postings are ``new``; rows that were inactive or differ
    in content are ``changed``, others ``seen``; history without a posting is
    ``missing``. When two postings meet one row, both are reported and the
    later id writes the history. Two equi joins on ids and roles, one anti join.
    """
    kept, duplicates = one_per_role(with_order(current))
    now = kept.withColumn("content_hash", text.content_hash(
        F.col("title"), F.col("company"), F.col("location"), F.col("posting_id"), F.col("source_url")
    ))
    old = with_order(history)
    past = F.struct(*HISTORY_FIELDS)
    by_id = old.select(F.col("posting_id"), past.alias("by_id"))
    by_role = first_of_each(old, "role_key").select("role_key", past.alias("by_role"))
    rows = now.join(by_id, "posting_id", "left").join(by_role, "role_key", "left")
    alternate = F.col("by_id").isNull() & (F.col("by_role.posting_id") != F.col("posting_id"))
    rows = rows.withColumn("by_role_only", F.coalesce(alternate, F.lit(False)))
    rows = rows.withColumn("p", F.coalesce(F.col("by_id"), F.when(F.col("by_role_only"), F.col("by_role"))))
    rows = rows.withColumn("moved", F.when(F.col("by_role_only") | ~F.col("p.active"), urls.posting_id(F.col("p.posting_url")) != F.col("posting_id")))
    moved = F.col("moved")
    quoted = lambda name: F.concat(F.lit(f"{name} changed from '"), F.col(f"p.{name}"), F.lit("' to '"), F.col(name), F.lit("'"))
    details = F.array_compact(F.array(
        F.when(F.col("by_role_only") & moved, F.concat(F.lit("URL changed from "), F.col("p.posting_url"), F.lit(" to "), F.col("posting_url"))),
        F.when(F.col("p.title") != F.col("title"), quoted("title")),
        F.when(F.col("p.location") != F.col("location"), quoted("location")),
        F.when(F.col("p.source_url") != F.col("source_url"), F.lit("source URL changed")),
    ))
    content = F.when(F.size(details) > 0, F.concat(F.lit("Posting content changed: "), F.array_join(details, "; "), F.lit("."))).otherwise(F.lit("Posting content changed."))
    reopened = (
        F.when(moved, F.concat(F.lit("Previously missing role reappeared at a new URL and may have reopened: "), F.col("posting_url"), F.lit(".")))
        .otherwise(F.lit("Previously missing role reappeared in collection and may have reopened."))
    )
    differs = F.col("p.content_hash") != F.col("content_hash")
    status = F.when(F.col("p").isNull(), F.lit("new")).when(~F.col("p.active") | differs, F.lit("changed")).otherwise(F.lit("seen"))
    seen = (
        F.when(F.col("by_role_only") & moved, F.concat(F.lit("Same role matched by company, title, and location at an alternate URL: "), F.col("posting_url"), F.lit(".")))
        .otherwise(F.lit("Posting was seen before."))
    )
    reason = (
        F.when(F.col("p").isNull(), F.lit("Posting was not in history.")).when(~F.col("p.active"), reopened)
        .when(differs, content).otherwise(seen)
    )
    matched = rows.withColumns({
        "status": status, "reason": reason, "current_id": F.col("posting_id"),
        "posting_id": F.coalesce("p.posting_id", "posting_id"),
        "first_seen": F.coalesce("p.first_seen", "date_collected"), "last_seen": F.col("date_collected"), "active": F.lit(True),
    })
    gone = old.join(matched.select("posting_id").distinct(), "posting_id", "left_anti")
    absent = (
        F.when(F.col("active"), F.lit("Posting no longer appears in the current collection and is likely closed or expired."))
        .otherwise(F.lit("Posting remains absent from the current collection and is still likely closed or expired."))
    )
    missing = gone.withColumns({"status": F.lit("missing"), "reason": absent})
    changes = duplicates.select(CHANGE_FIELDS).unionByName(matched.select(CHANGE_FIELDS)).unionByName(missing.select(CHANGE_FIELDS))
    last = Window.partitionBy("posting_id").orderBy(F.desc("current_id"))
    written = matched.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(HISTORY_FIELDS)
    after = written.unionByName(gone.withColumn("active", F.lit(False)).select(HISTORY_FIELDS))
    return Detection(changes, matched.where("status = 'new'").drop("p", "by_id", "by_role", "by_role_only", "moved"), after)


def with_role_keys(history: DataFrame) -> DataFrame:
    """History rows of earlier versions get their missing role key."""
    key = text.role_key(F.col("company"), F.col("title"), F.col("location"))
    stored = F.col("role_key") if "role_key" in history.columns else F.lit(None).cast("string")
    return history.withColumn("role_key", F.when(F.coalesce(stored, F.lit("")) != "", stored).otherwise(key))


def inactive_urls(history: DataFrame) -> DataFrame:
    return history.where("not active").select("posting_url").distinct()


def status_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("status").agg(F.count("*").alias("n")).orderBy("status")
