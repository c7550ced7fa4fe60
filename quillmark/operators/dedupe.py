"""Merging and de-duplicating postings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import metadata, text, urls

FIELDS = ["title", "company", "location", "posting_url", "date_collected", "source_url", "eligibility_text"]


def with_order(df: DataFrame, name: str = "ord") -> DataFrame:
    """Numbers rows in reading order, where the caller has no order of its own."""
    return df if name in df.columns else df.withColumn(name, F.monotonically_increasing_id())


def merged_by(df: DataFrame, key: Column) -> DataFrame:
    """One row per key: the first in ``ord``, better field values of later rows folded in.

    The fold goes over one key's rows in order, since a better value depends on
    the value so far; equal rows of a key are collapsed before the shuffle, so
    a hot key gathers only its distinct rows.
    """
    rows = df.withColumn("_key", key).groupBy("_key", *FIELDS).agg(F.min("ord").alias("ord"))
    listed = rows.groupBy("_key").agg(F.array_sort(F.collect_list(F.struct("ord", *FIELDS))).alias("_rows"))

    def fold(kept: Column, other: Column) -> Column:
        better = metadata.merged(kept, other)
        return F.struct(kept["ord"].alias("ord"), *(better.get(c, kept[c]).alias(c) for c in FIELDS))

    rest = F.slice("_rows", F.lit(2), F.size("_rows"))
    return listed.select(F.aggregate(rest, F.col("_rows")[0], fold).alias("r")).select("r.*")


def with_keys(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "posting_id": urls.posting_id(F.col("posting_url")),
        "role_key": text.role_key(F.col("company"), F.col("title"), F.col("location")),
    })


def source_preference() -> Column:
    """Orders a role's addresses; the largest is kept."""
    link = F.lower("posting_url")
    board = urls.contains_any(link, ["linkedin.com", "indeed.com"])
    specific = urls.contains_any(link, ["/job/", "/jobs/", "greenhouse.io", "lever.co"])
    return F.struct(
        (~F.col("source_url").startswith("job-board://")).cast("int").alias("a"), (~board).cast("int").alias("b"),
        specific.cast("int").alias("c"), F.length(link).alias("d"), F.col("posting_id").alias("e"),
    )


def ranked_roles(df: DataFrame) -> DataFrame:
    """The first row per role and address, with ``_rank`` 1 for the one its role keeps."""
    first = Window.partitionBy("role_key", "posting_id").orderBy("ord")
    best = Window.partitionBy("role_key").orderBy(F.desc(source_preference()))
    rows = with_keys(df).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumn("_rank", F.row_number().over(best)).withColumn("_kept", F.first(F.struct(
        "posting_id", "title", "company", "posting_url", "date_collected"
    )).over(best))


def one_per_role(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept postings, duplicate changes) of postings with an ``ord``.

    An address under two roles stays with the role seen later first.
    """
    ranked = ranked_roles(with_order(df))
    seen = Window.partitionBy("posting_id").orderBy(F.desc("_role"))
    role = Window.partitionBy("role_key")
    kept = (
        ranked.withColumn("_role", F.min("ord").over(role)).where("_rank = 1")
        .withColumn("_n", F.row_number().over(seen)).where("_n = 1").drop("_n", "_rank", "_kept", "_role")
    )
    reason = F.concat(F.lit("Duplicate role merged from alternate URL "), F.col("posting_url"), F.lit(" using company, title, and location signals."))
    losers = ranked.where("_rank > 1").select(
        F.lit("duplicate").alias("status"), "_kept.posting_id", "_kept.title", "_kept.company", "_kept.posting_url",
        F.col("_kept.date_collected").alias("first_seen"), F.col("_kept.date_collected").alias("last_seen"), reason.alias("reason"),
    )
    return kept, losers


def merge_candidates(primary: DataFrame, secondary: DataFrame | None = None) -> DataFrame:
    """Postings of both tables, career pages first, one per address and role, sorted."""
    rows = with_order(primary.select(FIELDS)).withColumn("_table", F.lit(0))
    if secondary is not None:
        rows = rows.unionByName(with_order(secondary.select(FIELDS)).withColumn("_table", F.lit(1)))
    rows = rows.withColumn("ord", F.struct("_table", "ord")).drop("_table")
    found = urls.canonical(F.col("posting_url"))
    merged = merged_by(rows, F.when(found != "", found).otherwise(F.lower("posting_url")))
    better = metadata.enriched(F.col("title"), F.col("company"), F.col("location"), F.col("posting_url"), F.lit(""))
    kept, _ = one_per_role(merged.withColumns(better))
    return kept.select(FIELDS).orderBy(F.lower("company"), F.lower("title"), "posting_url")


def first_of_each(df: DataFrame, *keys: str) -> DataFrame:
    """The first row in ``ord`` of each key."""
    order = Window.partitionBy(*keys).orderBy("ord")
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def last_of_each(df: DataFrame, *keys: str) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("ord"))
    return df.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
