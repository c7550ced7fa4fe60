"""Scalar rules on tables of cases."""

import pytest
from pyspark.sql import functions as F

from quillmark.functions import listing, metadata, places, text, urls


def apply(spark, rows, columns, expression):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{c} string" for c in columns))
    return [r[0] for r in df.orderBy("i").select(expression(*(F.col(c) for c in columns)).alias("v")).collect()]


def test_canonical_urls(spark):
    cases = {
        "HTTPS://Ex.com/Jobs/1/?utm_source=a&b=2&a=1&b=3&c=&REF=z#x": "https://ex.com/jobs/1/?b=2&b=3&a=1",
        "https://www.linkedin.com/jobs/view/123?x=1": "https://www.linkedin.com/jobs/view/123", "https://il.indeed.com/viewjob?jk=ABC&from=x": "https://www.indeed.com/viewjob?jk=abc",
        "  foo/Bar ": "foo/bar", "https://e.com/a?q=a%20b+c~d": "https://e.com/a?q=a+b+c~d", "": "", "https://e.com/?gh_src=1": "https://e.com", "https://e.com/a?bad=%zz": "https://e.com/a?bad=%25zz",
    }
    assert apply(spark, [(u,) for u in cases], ["u"], urls.canonical) == list(cases.values())


def test_other_urls(spark):
    one = lambda f, *rows: apply(spark, [(r,) for r in rows], ["u"], f)
    assert one(urls.navigation, "HTTP://Ex.com/A/?b=1#c", "/x/") == ["http://ex.com/A/?b=1", "/x"]
    assert one(urls.search_target, "//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com%2Fb%3Fc%3D1%23d", "https://a.com/#x", "nothing") == ["https://a.com/b?c=1", "https://a.com/", ""]
    assert one(urls.platform, "https://x.lever.co/a", "https://a.myworkdayjobs.com/x", "https://b.com") == ["lever", "workday", "other"]
    assert one(urls.domain_key, "https://careers.acme-labs.com/x", "https://www.jobs.de/") == ["acme-labs", "de"]
    assert one(urls.is_job_detail, "https://a.com/jobs/it/123", "https://jobs.lever.co/a", "https://jobs.lever.co/a/b") == [True, False, True]
    assert one(urls.repaired, "https://careers.blackrock.com/search-jobs&p=2", "https://a.com/search-jobs&p=2") == ["https://careers.blackrock.com/search-jobs?p=2", "https://a.com/search-jobs&p=2"]
    assert apply(spark, [("https://a.com/de/x", "https://a.com/en"), ("https://a.com/en-us/x", "https://a.com/en-us"), ("https://a.com/jobs", "https://a.com/en")], ["u", "r"], urls.is_other_locale) == [True, False, False]


@pytest.mark.parametrize("title,url,category", [
    ("Summer Analyst 2027", "https://x.com/a", "specific_listing"), ("Research Intern", "https://x.com/jobs/123", "specific_listing"), ("Research Intern", "https://x.com/", "specific_listing"),
    ("סטודנט הנדסה", "https://x.com", "specific_listing"), ("life at x", "https://x.com/job/a/b", "blog_or_story"), ("Search internships", "https://x.com/search-jobs", "generic_search_page"),
    ("Internships", "https://x.com/internships", "generic_program_page"), ("Software Engineer", "https://x.com/job/1/2", "not_internship"), ("Intern", "https://x.com/blog-post", "blog_or_story"),
    ("Our interns", "https://x.com/students/", "not_internship"), ("Summer internship", "https://x.com/students/", "generic_program_page"), ("Robotics internship", "https://x.com/internships-programs/robotics", "specific_listing"),
    ("one two three four five six seven eight nine ten eleven internship", "https://x.com", "generic_program_page"),
])
def test_classifier(spark, title, url, category):
    found = apply(spark, [(title, url)], ["t", "u"], listing.classified)[0]
    assert found["category"] == category and found["is_specific"] == (category == "specific_listing")


def test_graduates(spark):
    rows = [("MBA intern", ""), ("Intern", "PhD or bachelor's degree"), ("Graduate Engineer", "bachelor"), ("Intern", "J.D. students"), ("Intern", "")]
    assert apply(spark, rows, ["t", "e"], listing.is_graduate_only) == [True, False, True, True, False]


def test_places(spark):
    rows = [("Remote", "", ""), ("Hybrid (Remote)", "", ""), ("San Jose, Costa Rica", "", ""), ("San Jose, CA", "", ""), ("Flexible", "", "office in tel aviv"), ("Flexible", "", "apply online"),
            ("Unknown", "remote intern", ""), ("", "", ""), ("Berlin", "remote", "")]
    got = apply(spark, rows, ["l", "t", "d"], lambda a, b, c: places.allowed(a, b, c, ["san jose", "tel aviv"]))
    assert got == [True, False, False, True, True, False, True, False, False]
    shown = apply(spark, [("San Jose | Berlin | Tel Aviv",), ("Berlin",), ("Flexible",)], ["l"], lambda c: places.allowed_summary(c, F.lit("in tel aviv"), ["san jose", "tel aviv"]))
    assert shown == ["San Jose | Tel Aviv | …", "Berlin", "Tel Aviv | …"]


def test_texts(spark):
    one = lambda f, *rows: apply(spark, [(r,) for r in rows], ["t"], f)
    assert one(text.clean_title, "  a   b\n", " ") == ["a b", "Untitled posting"]
    assert one(text.location_list, "A | b + 3 offices a", "  ") == ["A | b", "Unknown"]
    assert one(text.deadline, "Apply by March 3rd", "4/5/2026 deadline", "none") == ["March 3rd", "4/5/2026", None]
    assert one(text.review_status, " Ignored", "", "applied", "needs_follow_up") == ["not_interested", "to_review", "applied", "to_review"]
    assert one(text.company_of_query, "Acme summer 2027 internship careers ", "Acme") == ["Acme", "Acme"]
    short = one(lambda t: text.summary_text(F.array(t), "none", 40), "One. Two! Three?", "", "a " * 60, "A first sentence of some length here. And another of length.")
    assert short == ["One. Two!", "none", "a " * 17 + "a...", "A first sentence of some length here."]
    keys = apply(spark, [("Acme, Inc.", "Data  Intern!", "Unknown")], ["a", "b", "c"], text.role_key)
    assert keys == ["acme inc|data intern|"]


def test_metadata(spark):
    rows = [("Job Application for Data Intern at Acme", "https://x.com"), ("Intern at Big Co | LinkedIn", "https://linkedin.com/jobs/view/1"), ("Acme - Data Intern", "https://indeed.com/viewjob?jk=1"),
            ("Intern", "https://boards.greenhouse.io/acme-labs-jobs/jobs/1"), ("Intern at ...", "https://jobs.lever.co/palantir/x")]
    got = [(r["title"], r["company"]) for r in apply(spark, rows, ["t", "u"], metadata.board_title)]
    assert got == [("Data Intern", "Acme"), ("Intern", "Big Co"), ("Data Intern", "Acme"), ("Intern", "Acme Labs"), ("Intern at ...", "Palantir")]
    assert apply(spark, [("Nothing here",), ("join us in New York, NY now",), ("Remote role",), ("",)], ["s"], metadata.place_of_snippet) == ["", "New York, NY", "Remote", ""]
    better = apply(spark, [("Unknown", "Paris"), ("Paris", "Paris, France"), ("Paris", "Rome"), ("Paris", "Rome | Oslo")], ["a", "b"], metadata.better_place)
    assert better == ["Paris", "Paris, France", "Paris", "Rome | Oslo"]
    assert apply(spark, [("", "Acme"), ("Unknown Company", "Acme"), ("Acme", "Acme Inc"), ("Acme", "")], ["a", "b"], metadata.better_company) == ["Acme", "Acme", "Acme Inc", "Acme"]
