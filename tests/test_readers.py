"""Readers of HTML sources that must not lose records."""

import pytest

from quillmark.sources import feeds


def page_of(spark, html, url="https://acme.com/x"):
    return spark.createDataFrame([(url, html, "Acme", url)], "page_url string, html string, company string, careers_url string")


def test_closed_sources_are_checked(spark):
    for name, good, bad in (
        ("closed_company", "<p>The company is no longer <b>operating</b></p>", "<p>Applications closed</p>"),
        ("parked_company_domain", "<script>window.location.href = '/lander'</script>", "<script>window.location = '/jobs'</script>"),
    ):
        assert feeds.read_html(name, page_of(spark, good), "d").count() == 0
        with pytest.raises(Exception, match="no longer says"):
            feeds.read_html(name, page_of(spark, bad), "d").count()
    with pytest.raises(Exception, match="no longer says"):
        feeds.confirmed_empty(page_of(spark, "open"), "closed").count()


def test_embedded_records_with_nested_objects(spark):
    html = """<script id="__NEXT_DATA__" type="application/json">{"a":[{"title":"Data Intern 2027","url":"/job/b/2","location":{"name":"Rome"},"note":"{x};"}],
"allRecipes":[{"pageTitle":"Claims Analyst","link":"/job/c/3","employmentType":"Summer internship","location":"Oslo","content":{"b":1}}]}</script>"""
    read = lambda name: [(r["title"], r["location"], r["posting_url"]) for r in feeds.read_html(name, page_of(spark, html), "d").collect()]
    assert read("embedded_json") == [("Data Intern 2027", "Rome", "https://acme.com/job/b/2")]
    assert read("lemonade_jobs") == [("Claims Analyst", "Oslo", "https://acme.com/job/c/3")]


def test_pwc_paths_and_wix_titles(spark):
    html = """<script>var x = "/job/US-New-York/Tax-Intern---Summer-2027?id=1"</script><meta content="Data Intern 2027 | Wix Careers" property="og:title"><title>Other</title>"""
    read = lambda name: [(r["title"], r["location"], r["posting_url"]) for r in feeds.read_html(name, page_of(spark, html, "https://acme.com/position/1"), "d").collect()]
    assert read("pwc_jobs") == [("Tax-Intern - Summer-2027", "New York", "https://acme.com/job/US-New-York/Tax-Intern---Summer-2027?id=1")]
    assert read("wix_positions") == [("Data Intern 2027", "Unknown", "https://acme.com/position/1")]


def test_sitemaps_are_read_whole_or_fail(spark):
    site = lambda n: "".join(f"<loc>https://acme.com/position/{i}</loc>" * 2 for i in range(n))
    assert feeds.sitemap_urls(page_of(spark, site(100))).count() == 100
    with pytest.raises(Exception, match="more than 100"):
        feeds.sitemap_urls(page_of(spark, site(101))).count()
