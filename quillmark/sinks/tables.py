"""Writers: JSON lines, state tables, upserts, logs, reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.review import STATUSES


def json_lines(df: DataFrame, path: str, *order: str) -> None:
    """Overwrites a table of JSON lines with sorted keys."""
    rows = df.select(sorted(df.columns))
    (rows.orderBy(*order) if order else rows).write.mode("overwrite").json(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def split_filtered(filtered: DataFrame, included: str, excluded: str) -> None:
    """Included and excluded postings to tables of their own."""
    json_lines(filtered.where("included"), included, "company", "title", "posting_url")
    json_lines(filtered.where("not included"), excluded, "company", "title", "posting_url")


def state(df: DataFrame, path: str, *order: str) -> None:
    """Overwrites a state table that ``df`` may have been read from."""
    rows = df.orderBy(*order) if order else df
    rows.write.mode("overwrite").parquet(f"{path}.new")
    spark = df.sparkSession
    old, new = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.new"))
    fs = old.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(old, True)
    fs.rename(new, old)


def upserted(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the rows of ``changes`` in place of those of the same key."""
    return table.join(changes.select(key), key, "left_anti").select(table.columns).unionByName(changes.select(table.columns))


def with_status(reviews: DataFrame, url: str, status: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"status must be one of {', '.join(STATUSES)}")
    return upserted(reviews, reviews.sparkSession.createDataFrame([(url, status)], "posting_url string, status string"), "posting_url")


def with_note(notes: DataFrame, url: str, note: str) -> DataFrame:
    """Notes with one set; a blank one is removed; 10,000 characters at most."""
    if len(note) > 10_000:
        raise ValueError("a note has 10,000 characters at most")
    if not note.strip():
        return notes.where(F.col("posting_url") != url)
    return upserted(notes, notes.sparkSession.createDataFrame([(url, note.strip())], "posting_url string, notes string"), "posting_url")


def with_dismissed(dismissed: DataFrame, name: str) -> DataFrame:
    return dismissed.select("name").union(dismissed.sparkSession.createDataFrame([(name,)], "name string")).distinct()


def activity(spark: SparkSession, path: str, action: str, subject: str, details: str = "{}", now: str | None = None) -> None:
    """Appends one event; ``now`` is an ISO time, else the current one."""
    at = F.lit(now).cast("timestamp") if now else F.current_timestamp()
    row = spark.range(1).select(
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").alias("timestamp"), F.date_format(at, "yyyy-MM-dd").alias("date"),
        F.lit(action).alias("action"), F.lit(subject).alias("subject"), F.lit(details).alias("details"),
    )
    append_lines(row.coalesce(1), path)


def report(rows: DataFrame, title: str, heading: str, line, counts: dict[str, int] | None = None):
    """Lines of a Markdown report: a section per ``heading`` value; rows come in order.

    ``line`` makes a row's lines. Rows are taken one partition at a time, so the
    driver never holds the table.
    """
    yield f"# {title}"
    for name, n in (counts or {}).items():
        yield f"- {name}: {n}"
    last = None
    for row in rows.toLocalIterator():
        if row[heading] != last:
            last = row[heading]
            yield ""
            yield f"## {last}"
        yield from line(row)


def review_lines(row) -> list[str]:
    reasons = "; ".join(row["reasons"] or [])
    return ["", f"- **{row['title']}** ({row['location']})", f"  - Link: {row['posting_url']}", f"  - Why: {reasons}"]


def digest_lines(row) -> list[str]:
    return ["", f"- **{row['title']}** ({row['score']}, {row['fit_level']})", f"  - Location: {row['location']}", f"  - Link: {row['posting_url']}"]
