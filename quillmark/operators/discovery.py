"""Company discovery: queries, candidates, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import metadata, text, urls
from .dedupe import with_order


def queries(spark: SparkSession, industries: list[str], companies: list[str], likes: list[str], limit: int = 15) -> DataFrame:
    """Search queries in order, once each whatever their case, ``limit`` at most."""
    rows = [(i, "industry", x) for i, x in enumerate(industries)]
    rows += [(1000 + i, "company", x) for i, x in enumerate(companies) if x.lower() not in ("test", "existing", "new co")]
    rows += [(2000 + i, "like", x) for i, x in enumerate(likes[:3])]
    df = spark.createDataFrame(rows, "ord int, kind string, value string")
    term = text.query_term(F.col("value"))
    query = (
        F.when(F.col("kind") == "industry", F.concat(term, F.lit(" companies summer 2027 internship careers")))
        .when(F.col("kind") == "company", F.concat(F.lit("companies similar to "), "value", F.lit(" summer internship careers")))
        .otherwise(F.concat(term, F.lit(" internship companies careers")))
    )
    once = df.withColumn("query", query).groupBy(F.lower(F.trim("query")).alias("k")).agg(F.min_by("query", "ord").alias("query"), F.min("ord").alias("ord"))
    return once.orderBy("ord").limit(limit).select("ord", "query")


def is_blocked(url: Column, title: Column) -> Column:
    return urls.is_blocked_host(urls.host(url)) | urls.contains_any(F.lower(F.concat_ws(" ", url, title)), L.DISCOVERY_BLOCKED)


def candidates(results: DataFrame, interests: list[str], dislikes: list[str]) -> DataFrame:
    """Companies that search results name, of interest and not disliked."""
    title, url = F.col("title"), F.col("url")
    site = urls.website(url)
    body = F.lower(F.concat_ws(" ", "title", "url", "snippet", "query"))
    tags = F.array_compact(F.array(*(F.when(body.contains(t), F.lit(t)) for t in sorted(interests)))) if interests else F.array().cast("array<string>")
    tags = F.when(F.size(tags) > 0, F.slice(tags, 1, 4)).otherwise(F.array(F.lit("discovered")))
    snippet = F.when(F.coalesce("snippet", F.lit("")) == "", F.lit("No snippet available.")).otherwise(F.col("snippet"))
    reason = F.concat(F.lit("Found via internet search ("), "provider", F.lit(") for query '"), "query", F.lit("'. "), snippet)
    rows = with_order(results).where(~is_blocked(url, title)).select(
        "ord", metadata.company_of_result(title, url).alias("name"), site.alias("website"),
        F.when(urls.looks_like_careers(url), url).otherwise(site).alias("careers_url"), tags.alias("industry_tags"), reason.alias("reason"),
        F.concat(F.lit("internet_search:"), "provider").alias("source"), F.lit("discovered").alias("origin"),
        F.lit(True).alias("should_add_to_source_registry"), F.lit("suggested").alias("review_status"),
        title.alias("evidence_title"), url.alias("evidence_url"), F.col("snippet").alias("evidence_snippet"),
    )
    said = F.lower(F.concat_ws(" ", F.array_join("industry_tags", " "), "reason"))
    return rows.where((F.col("name") != "") & urls.contains_any(said, interests) & ~urls.contains_any(said, dislikes))


def merged_suggestions(curated: DataFrame, found: DataFrame) -> DataFrame:
    """One suggestion per normalised name: the first, curated before found.

    Its careers page and evidence are the first that looks like a careers page,
    if its own doesn't.
    """
    rows = curated.withColumn("_t", F.lit(0)).unionByName(found.withColumn("_t", F.lit(1)))
    fields = [c for c in rows.columns if c not in ("ord", "_t")]
    rows = rows.withColumns({"_key": text.normalized(F.col("name")), "_ord": F.struct("_t", "ord")})
    row = F.struct(*fields)
    careers = urls.looks_like_careers(F.col("careers_url"))
    page = F.when(careers & (F.col("_t") == 1), F.struct("careers_url", "evidence_title", "evidence_url", "evidence_snippet"))
    both = rows.groupBy("_key").agg(
        F.min_by(row, "_ord").alias("r"), F.min_by(careers, "_ord").alias("ok"), F.min_by(page, F.when(page.isNotNull(), F.col("_ord"))).alias("p"),
        F.min("_ord").alias("_ord"),
    )
    better = ~F.col("ok") & F.col("p").isNotNull()
    swap = {c: F.when(better, F.col(f"p.{c}")).otherwise(F.col(f"r.{c}")) for c in ("careers_url", "evidence_title", "evidence_url", "evidence_snippet")}
    return both.select("_ord", "_key", *(swap.get(c, F.col(f"r.{c}")).alias(c) for c in fields)).orderBy(F.col("industry_tags")[0], "name").drop("_ord", "_key")


def into_registry(sources: DataFrame, suggestions: DataFrame) -> DataFrame:
    """Sources, and wanted suggestions whose name no source has."""
    names = sources.select(text.normalized(F.col("company")).alias("_key")).distinct()
    new = suggestions.where("should_add_to_source_registry").withColumn("_key", text.normalized(F.col("name"))).join(names, "_key", "left_anti")
    new = new.select(
        F.col("name").alias("company"), "website", "careers_url", F.lit("company_careers").alias("source_type"), "origin",
        F.lit(False).alias("has_connection"), F.col("reason").alias("notes"), F.array().cast("array<string>").alias("alternate_careers_urls"),
        F.lit("auto").alias("collector"),
    )
    return sources.select(new.columns).unionByName(new).orderBy("origin", "company")


def seeded(companies: DataFrame, seeds: DataFrame) -> DataFrame:
    """A source per company: its seed's pages, else its website."""
    rows = companies.withColumn("_key", text.normalized(F.col("name"))).join(
        seeds.select(text.normalized(F.col("company")).alias("_key"), F.col("careers_url").alias("_url"), F.col("source_type").alias("_type"), F.col("notes").alias("_notes")), "_key", "left"
    )
    return rows.select(
        F.col("name").alias("company"), "website", F.coalesce("_url", "website").alias("careers_url"),
        F.coalesce("_type", F.lit("company_careers")).alias("source_type"), F.lit("seed").alias("origin"), "has_connection",
        F.coalesce("_notes", F.lit("")).alias("notes"), F.array().cast("array<string>").alias("alternate_careers_urls"), F.lit("auto").alias("collector"),
    )


def registry_totals(sources: DataFrame) -> DataFrame:
    return sources.agg(
        F.count("*").alias("sources"), F.count_if(F.col("origin") == "seed").alias("seeds"), F.count_if("has_connection").alias("connected")
    )
