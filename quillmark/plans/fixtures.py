"""Posting tables made from the test tables, with expressions that Spark and DuckDB both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TITLE = """CASE o_orderkey % 13 WHEN 0 THEN 'Research Intern' WHEN 1 THEN 'Summer Analyst 2027' WHEN 2 THEN 'Internships'
 WHEN 3 THEN 'Search internships' WHEN 4 THEN 'Careers' WHEN 5 THEN 'Software Engineer' WHEN 6 THEN 'Student Research Assistant'
 WHEN 7 THEN 'Operations Internship for MBA students' WHEN 8 THEN 'Why this internship matters' WHEN 9 THEN 'Summer  Tax Intern Role'
 WHEN 10 THEN 'Graduate Engineer internship 2026' WHEN 11 THEN 'Life at the summer associate desk'
 ELSE 'Marketing internship at Acme Holdings' END"""
URL = """CASE o_orderkey % 8 WHEN 0 THEN concat('https://jobs.example.com/job/team/', o_custkey, '?utm_source=a&id=', o_orderkey)
 WHEN 1 THEN concat('https://www.example.org/careers/', o_custkey, '/') WHEN 2 THEN concat('https://Example.net/Jobs/', o_custkey, '#top')
 WHEN 3 THEN concat('https://www.linkedin.com/jobs/view/', o_custkey, '?trk=x') WHEN 4 THEN concat('https://www.indeed.com/viewjob?jk=A', o_custkey)
 WHEN 5 THEN concat('https://boards.greenhouse.io/acme-labs/jobs/', o_custkey) WHEN 6 THEN concat('https://example.com/students/blog/', o_custkey)
 ELSE concat('https://example.com/search-jobs?keyword=intern&page=', o_custkey) END"""
PLACE = """CASE o_orderkey % 9 WHEN 0 THEN 'New York' WHEN 1 THEN 'Remote' WHEN 2 THEN 'Hybrid (Remote)' WHEN 3 THEN 'San Jose, Costa Rica'
 WHEN 4 THEN 'San Jose, CA' WHEN 5 THEN 'Flexible' WHEN 6 THEN 'Unknown' WHEN 7 THEN 'Berlin' ELSE 'New York | Berlin' END"""
ELIGIBILITY = """CASE o_orderkey % 5 WHEN 0 THEN 'Open to undergraduate and master students' WHEN 1 THEN 'PhD candidates'
 WHEN 2 THEN 'Office in New York' WHEN 3 THEN 'Bachelor degree' ELSE '' END"""
COLUMNS = {
    "ord": "o_orderkey", "title": TITLE, "company": "concat('Company ', o_custkey % 40)", "location": PLACE, "posting_url": URL,
    "date_collected": "concat('2026-07-0', o_orderkey % 9 + 1)",
    "source_url": "CASE WHEN o_orderkey % 5 = 0 THEN 'job-board://web' ELSE 'https://www.example.org' END",
    "eligibility_text": ELIGIBILITY, "seen_on": "o_orderdate", "state": "o_orderstatus",
}
#: The same table as SQL.
POSTINGS = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items()) + " FROM orders"
MARKERS = ["new york", "san jose"]
DISLIKES = ["Tax roles", "Software engineering"]
LIKES = ["Quantitative research", "High growth companies", "Operations"]
INDUSTRIES = ["finance", "market-making"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(*(f"{e} AS {c}" for c, e in COLUMNS.items()))


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One company source per small customer number, with a connection for some."""
    return table(spark, sf_dir, "customer").selectExpr(*(f"{e} AS {c}" for c, e in SOURCE_COLUMNS.items()))


SOURCE_COLUMNS = {
    "ord": "c_custkey", "company": "concat('Company ', c_custkey % 60)", "website": "concat('https://c', c_custkey % 60, '.example.com')",
    "careers_url": "concat('https://c', c_custkey % 60, '.example.com/careers')", "has_connection": "c_custkey % 3 = 0",
}
SOURCES = "SELECT " + ", ".join(f"{e} AS {c}" for c, e in SOURCE_COLUMNS.items()) + " FROM customer"
