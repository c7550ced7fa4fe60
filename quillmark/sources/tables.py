"""Readers of the engine's tables: JSON lines, JSON arrays, keyed JSON objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.snapshot import with_role_keys
from . import schemas


def exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder at the path, in whatever store it names?"""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def json_lines(spark: SparkSession, path: str, schema: str, tolerant: bool = False) -> DataFrame:
    """A JSON-lines table; a missing one is empty, a malformed line fails unless ``tolerant``.

    Blank lines are skipped. The schema is given, so nothing is read twice.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "DROPMALFORMED" if tolerant else "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, schema: str, required: bool = False) -> DataFrame:
    """A table stored as one JSON array."""
    if not required and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def postings(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.POSTING).withColumn("eligibility_text", F.coalesce("eligibility_text", F.lit("")))


def filtered_postings(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.FILTERED).withColumn("eligibility_text", F.coalesce("eligibility_text", F.lit("")))


def scored_postings(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.SCORED)


def monitored(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.MONITORED)


def collection_errors(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.ERROR)


def board_postings(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.BOARD_POSTING)


def search_results(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path, schemas.SEARCH_RESULT)


def search_results_by_company(spark: SparkSession, path: str) -> DataFrame:
    """(company_key, results): each company's results by falling score, then address."""
    rows = search_results(spark, path).withColumn("company_key", text.normalized(text.company_of_query(F.col("query")))).where("company_key <> ''")
    item = F.struct((-F.col("relevance_score")).alias("_s"), "url", "title", "snippet", "provider", "query", "date_searched", "relevance_score")
    return rows.groupBy("company_key").agg(F.array_sort(F.collect_list(item)).alias("results"))


def source_registry(spark: SparkSession, path: str) -> DataFrame:
    """The registry; later columns get their defaults. It must exist."""
    rows = json_array(spark, path, schemas.SOURCE, required=True)
    return rows.withColumns({
        "alternate_careers_urls": F.coalesce("alternate_careers_urls", F.array().cast("array<string>")), "collector": F.coalesce("collector", F.lit("auto")),
    })


def history(spark: SparkSession, path: str) -> DataFrame:
    return with_role_keys(json_array(spark, path, schemas.HISTORY))


def discovered(spark: SparkSession, path: str) -> DataFrame:
    return json_array(spark, path, schemas.DISCOVERED)


def sent_history(spark: SparkSession, path: str) -> DataFrame:
    rows = json_array(spark, path, "sent_posting_urls array<string>")
    return rows.select(F.explode("sent_posting_urls").alias("posting_url")).distinct()


def _keyed(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) of a file that is one JSON object; entries of another shape are dropped."""
    if not exists(spark, path):
        return spark.createDataFrame([], f"key string, value {value}")
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    rows = whole.select(F.explode("m").alias("key", "raw")).where("raw like '{%'")
    return rows.select("key", F.from_json("raw", value).alias("value"))


def reviews(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark, path, "struct<status:string>").select(F.col("key").alias("posting_url"), "value.status")


def notes(spark: SparkSession, path: str) -> DataFrame:
    return _keyed(spark, path, "struct<notes:string>").select(F.col("key").alias("posting_url"), F.coalesce("value.notes", F.lit("")).alias("notes"))


def activity_events(spark: SparkSession, path: str) -> DataFrame:
    """The activity log; malformed lines are dropped."""
    return json_lines(spark, path, schemas.ACTIVITY, tolerant=True)


def location_markers(spark: SparkSession, path: str) -> list[str]:
    """Place words, one a line, lower case; ``#`` starts a comment. A user's own short list."""
    if not exists(spark, path):
        return []
    rows = spark.read.text(path).select(F.lower(F.trim("value")).alias("v")).where("v <> '' and not v like '#%'")
    return [r["v"] for r in rows.collect()]


def attachments(spark: SparkSession, folder: str) -> DataFrame:
    """Name, size and time of the files in a folder; their content isn't read."""
    rows = spark.read.format("binaryFile").load(folder)
    return rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
