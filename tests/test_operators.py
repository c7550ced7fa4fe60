"""Operators on small posting tables, by the cases that decide their rules."""

import pytest
from pyspark.sql import functions as F

from quillmark.operators import crawl, dedupe, digest, discovery, monitor, review, rollup, scoring, screening, search, snapshot
from quillmark.sources import schemas


def posting(url="https://example.com/jobs/1", title="2027 Summer Intern", company="Example Co", location="New York", date="2026-07-08", source="https://example.com/careers", text=""):
    return (title, company, location, url, date, source, text)


def table(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "ord int, " + schemas.POSTING)


def history_of(detection, spark):
    rows = detection.history.collect()
    return spark.createDataFrame(rows, schemas.HISTORY)


def statuses(detection):
    return sorted((r["status"], r["posting_id"]) for r in detection.changes.collect())


def test_snapshot_life_cycle(spark):
    none = spark.createDataFrame([], schemas.HISTORY)
    first = snapshot.detect_changes(table(spark, posting(), posting("https://example.com/jobs/2", "Data Intern")), none)
    assert statuses(first) == [("new", "https://example.com/jobs/1"), ("new", "https://example.com/jobs/2")] and first.new_postings.count() == 2
    past = history_of(first, spark)
    assert statuses(snapshot.detect_changes(table(spark, posting(), posting("https://example.com/jobs/2", "Data Intern")), past)) == [("seen", "https://example.com/jobs/1"), ("seen", "https://example.com/jobs/2")]
    second = snapshot.detect_changes(table(spark, posting(title="2027 Summer Intern II")), past)
    assert statuses(second) == [("changed", "https://example.com/jobs/1"), ("missing", "https://example.com/jobs/2")]
    assert "title changed from" in second.changes.where("status = 'changed'").first()["reason"]
    third = snapshot.detect_changes(table(spark, posting("https://example.com/jobs/9", "Data Intern")), history_of(second, spark))
    row = third.changes.where("status = 'changed'").first()
    assert row["posting_id"] == "https://example.com/jobs/2" and "new URL" in row["reason"]
    assert {r["posting_id"]: r["active"] for r in third.history.collect()} == {"https://example.com/jobs/2": True, "https://example.com/jobs/1": False}


def test_two_postings_for_one_history_row(spark):
    old = snapshot.detect_changes(table(spark, posting("https://example.com/jobs/5")), spark.createDataFrame([], schemas.HISTORY))
    now = table(spark, posting("https://example.com/jobs/5", title="Other"), posting("https://example.com/jobs/6"))
    found = snapshot.detect_changes(now, history_of(old, spark))
    assert statuses(found) == [("changed", "https://example.com/jobs/5")] * 2
    assert [(r["posting_id"], r["posting_url"]) for r in found.history.collect()] == [("https://example.com/jobs/5", "https://example.com/jobs/6")]


def test_role_dedupe_prefers_career_pages(spark):
    rows = table(spark, posting("https://www.linkedin.com/jobs/view/7", source="job-board://web"), posting("https://example.com/jobs/1?utm_source=a"), posting("https://example.com/jobs/1"))
    kept, losers = dedupe.one_per_role(rows)
    assert [r["posting_id"] for r in kept.collect()] == ["https://example.com/jobs/1"]
    assert [r["posting_id"] for r in losers.collect()] == ["https://example.com/jobs/1"]


def test_merge_takes_better_fields(spark):
    rows = table(spark, posting(location="Unknown", text="a"), posting("https://EXAMPLE.com/jobs/1#x", location="Paris, France", text="much longer"))
    merged = dedupe.merge_candidates(rows).collect()
    assert len(merged) == 1 and merged[0]["location"] == "Paris, France" and merged[0]["eligibility_text"] == "much longer"


def test_screening_precedence(spark):
    rows = table(spark, posting(), posting(title="Tax Intern 2027"), posting(title="MBA Intern 2027"), posting(location="Berlin"), posting(title="Careers"), posting(title="Intern 2027", text="bachelor or MBA"))
    got = screening.screened(rows, ["Tax roles"], ["new york"]).orderBy("ord").collect()
    assert [r["included"] for r in got] == [True, False, False, False, False, True]
    assert got[0]["reasons"][0] == "Listing type: Specific internship listing." and "target year" in got[0]["reasons"][-1]
    assert "Matched: Tax roles." in got[1]["reasons"][-1]
    assert screening.excluded_by_type(screening.screened(rows, [], ["new york"])).first()["n"] == 2


def test_scoring(spark):
    sources = spark.createDataFrame([("Example Co", True), ("Example Co", False)], "company string, has_connection boolean").coalesce(1)
    kept = screening.screened(table(spark, posting(), posting("https://example.com/jobs/2", "Quant Intern")), [], ["new york"])
    rows = scoring.scored(kept, sources, ["Quant research", "High growth"], ["new media"], ["Crypto"], ["new york"]).collect()
    assert [(r["score"], r["fit_level"]) for r in rows] == [(75, "strong"), (63, "medium")]
    assert rows[0]["explanations"][-1] == "Company has a known connection." and rows[1]["gaps"] == ["Does not explicitly mention Summer 2027."]
    answers = [('{"score": 80, "fit_level": "odd", "explanations": ["a"]}',), ('```json\n{"score": 10, "fit_level": "weak"}\n```',), ('{"score": 180}',), ("no",)]
    parsed = spark.createDataFrame(answers, "raw string").select(scoring.parsed_response(F.col("raw")).alias("p")).collect()
    assert [p["p"] and p["p"]["fit_level"] for p in parsed] == ["strong", "weak", None, None]


def test_monitor_and_connections(spark):
    sources = spark.createDataFrame([(1, "A", "w", "c", True), (2, "B", "w", "c", False), (3, "C", "w", "c", False)], "ord int, company string, website string, careers_url string, has_connection boolean")
    seen = spark.createDataFrame([("A", True, "2026-07-01"), ("B", False, "2026-07-02")], "company string, included boolean, date_collected string")
    errors = spark.createDataFrame([(1, "C", "old"), (2, "C", "timed out")], "ord int, company string, message string")
    rows = {r["company"]: r for r in monitor.without_openings(sources, seen, seen, errors).collect()}
    assert set(rows) == {"B", "C"} and rows["C"]["reason"] == "Collection failed: timed out" and rows["B"]["excluded_pages"] == 1 and rows["B"]["date_checked"] == "2026-07-02"
    own = spark.createDataFrame([(1, "B", True)], "ord int, name string, has_connection boolean")
    assert {r["company"]: r["has_connection"] for r in monitor.connections(sources, own).collect()} == {"A": True, "B": True, "C": False}


def test_search_ranking_and_registry(spark):
    results = spark.createDataFrame([
        (1, "Careers", "https://acme.com/careers", "official", "p", "Acme summer 2027 internship careers", "d"), (2, "Job", "https://acme.com/job/1", "", "p", "Acme summer 2027 internship careers", "d"),
        (3, "In", "https://linkedin.com/x", "", "p", "Acme summer 2027 internship careers", "d"), (4, "More", "https://acme.com/search-jobs", "", "p", "acme  summer 2027 internship careers", "d"),
    ], "ord int, title string, url string, snippet string, provider string, query string, date_searched string")
    ranked = search.ranked_results(results, F.lit("Acme")).collect()
    assert [r["relevance_score"] for r in ranked] == [53, 50, 50, -100]
    sources = spark.createDataFrame([("Acme", "https://acme.com", "https://acme.com", "", ["https://acme.com/search-jobs"]), ("Other", "w", "c", "n", [])], "company string, website string, careers_url string, notes string, alternate_careers_urls array<string>")
    rows = {r["company"]: r for r in search.enriched_registry(sources, results).collect()}
    assert rows["Acme"]["careers_url"] == "https://acme.com/careers" or rows["Acme"]["careers_url"] == "https://acme.com/job/1"
    assert rows["Other"]["careers_url"] == "c" and rows["Other"]["alternate_careers_urls"] == []
    boards = search.board_postings(results.withColumn("url", F.concat(F.lit("https://boards.greenhouse.io/acme/jobs/"), "ord")))
    assert boards.count() == 4 and search.as_postings(boards, "2026-07-01").first()["source_url"] == "job-board://p"


def test_review_dashboard(spark):
    url = "https://example.com/jobs/1"
    kept = screening.screened(table(spark, posting(), posting("https://example.com/jobs/2", "Data Intern 2027")), [], ["new york"])
    scored = spark.createDataFrame([(url, 80, "strong", ["a"], ["b"])], "posting_url string, score int, fit_level string, explanations array<string>, gaps array<string>")
    keys = lambda *u: spark.createDataFrame([(x,) for x in u], "posting_url string")
    rows = review.reviewable(
        kept, scored, spark.createDataFrame([(url, "applied")], "posting_url string, status string"), spark.createDataFrame([(url, "call")], "posting_url string, notes string"),
        spark.createDataFrame([("Example Co", True)], "company string, has_connection boolean"), keys(url), keys(), keys("https://example.com/jobs/2"), [], ["new york"],
        spark.createDataFrame([(1, "example  CO", "why", "src")], "ord int, name string, reason string, source string"), spark.createDataFrame([], "name string"),
    )
    got = rows.collect()
    assert [(r["review_status"], r["email_status"], r["section"], r["is_new"]) for r in got] == [("applied", "ready", "applied", True), ("to_review", "inactive", "other", False)]
    assert got[0]["suggested_company_overview"]["reason"] == "why" and got[0]["notes"] == "call"
    assert review.filtered_view(rows, {"review_status": "applied", "company": "any", "connection": "connected"}).count() == 1
    assert review.summary(rows).first().asDict() == {"total": 2, "included": 2, "excluded": 0, "connected": 2, "email_ready": 1, "emailed": 0, "new_postings": 1, "to_review": 1}


def test_activity(spark):
    events = spark.createDataFrame([(1, "t", "2026-07-01", "scoring", "s", '{"provider":"gemini","total_tokens":5}', None, None), (2, "t", "2026-07-02", "email", "s", '{"cost":"free","api_invoked":true}', None, None), (3, "t", "2026-07-03", "x", "s", None, None, "top")],
                                   "ord int, " + schemas.ACTIVITY)
    rows = review.activity(events, 2).collect()
    assert [(r["ord"], r["activity_type"], r["api_invoked"], r["cost"]) for r in rows] == [(3, "other", False, "top"), (2, "email", True, "free")]
    assert "5 tokens" in review.activity(events).where("ord = 1").first()["cost"]


def test_digest(spark):
    scored = spark.createDataFrame([(1, "a", "B", "Remote", "u1", 80, "strong"), (2, "b", "A", "Remote", "u2", 80, "strong"), (3, "c", "A", "Berlin", "u3", 90, "strong"), (4, "d", "A", "Remote", "u4", 59, "medium")],
                                   "ord int, title string, company string, location string, posting_url string, score int, fit_level string")
    keys = lambda *u: spark.createDataFrame([(x,) for x in u], "posting_url string")
    assert [r["posting_url"] for r in digest.selected(scored, keys(), keys(), []).collect()] == ["u2", "u1"]
    assert [r["posting_url"] for r in digest.selected(scored, keys("u2"), keys("u9"), []).collect()] == ["u1"]
    assert [(r["company"], r["fit_level"], r["titles"]) for r in digest.grouped(scored).collect()] == [("A", "strong", ["b", "c"]), ("A", "medium", ["d"]), ("B", "strong", ["a"])]
    assert digest.best_first(scored).first()["posting_url"] == "u3"


def test_discovery(spark):
    asked = [r["query"] for r in discovery.queries(spark, ["Arospace Defence"], ["Acme", "test"], ["AI"]).collect()]
    assert asked == ["aerospace defense companies summer 2027 internship careers", "companies similar to Acme summer internship careers", "ai internship companies careers"]
    results = spark.createDataFrame([(1, "Robotics intern at Acme", "https://acme.com/job/1", "robotics", "p", "q"), (2, "x", "https://reddit.com", "robotics", "p", "q"), (3, "Beta Careers", "https://beta.io", "robotics", "p", "q"), (4, "Tobacco at Smoke", "https://smoke.com/jobs", "robotics tobacco", "p", "q")],
                                    "ord int, title string, url string, snippet string, provider string, query string")
    found = discovery.candidates(results, ["robotics"], ["tobacco"])
    assert sorted((r["name"], r["careers_url"]) for r in found.collect()) == [("Acme", "https://acme.com/job/1"), ("Beta", "https://beta.io")]
    curated = found.where("name = 'Beta'").withColumn("reason", F.lit("curated"))
    better = found.where("name = 'Beta'").withColumn("careers_url", F.lit("https://beta.io/careers"))
    merged = discovery.merged_suggestions(curated, better).collect()
    assert [(r["name"], r["reason"], r["careers_url"]) for r in merged] == [("Beta", "curated", "https://beta.io/careers")]


HTML = """<nav><a href="/careers?page=2" rel="next">Next</a><a href="#x">skip</a><a href="mailto:a@b.c">mail</a></nav>
<a href="/jobs/research-intern/123">Research <b>Intern</b></a><a href="https://other.org/jobs">Jobs</a><a href="https://boards.greenhouse.io/acme">All jobs</a>
<a href="/de/jobs">Jobs</a><button data-href="/load">Load more</button><iframe src="https://acme.breezy.hr/embed"></iframe><a href="/blog/intern">Intern blog</a>"""


def test_crawl(spark):
    page = spark.createDataFrame([("Acme", "https://acme.com/en/careers", "https://acme.com/en", HTML)], "company string, page_url string, root_url string, html string")
    found = [r["url"] for r in crawl.frontier(page).orderBy("ord").collect()]
    assert found == ["https://acme.com/careers?page=2", "https://acme.com/jobs/research-intern/123", "https://boards.greenhouse.io/acme", "https://acme.com/load", "https://acme.breezy.hr/embed"]
    rows = crawl.link_postings(page, "2026-07-01").collect()
    assert [(r["title"], r["posting_url"]) for r in rows] == [("Research Intern", "https://acme.com/jobs/research-intern/123")]
    text = page.select(crawl.semantic_text(F.lit("<p>a &amp;  b</p><div>c<br>d</div>"))).first()[0]
    assert text == "a & b\nc\nd"
    site = {"https://a.com": '<a rel="next" href="/2">n</a>', "https://a.com/2": '<a href="/2">next</a>'}
    assert [u for u, _ in crawl.crawl(site.get, ["https://a.com", "https://a.com"])] == ["https://a.com", "https://a.com/2"]


def test_rollups(spark):
    steps = spark.createDataFrame([(1, "success"), (1, "warning"), (2, "failed"), (2, "warning"), (3, "success")], "run int, status string")
    assert {r["run"]: r["status"] for r in rollup.run_status(steps, "run").collect()} == {1: "partial", 2: "failed", 3: "success"}
    days = spark.createDataFrame([("a", "2026-07-05"), ("a", "2026-07-06"), ("a", "2026-07-07")], "k string, d string").withColumn("d", F.col("d").cast("timestamp"))
    assert sorted(str(r["d"].date()) for r in rollup.once_a_week(days, "d", "k").collect()) == ["2026-07-05", "2026-07-06"]


@pytest.mark.parametrize("title,hits", [("Taxes intern", ["Tax roles"]), ("Software Engineer", ["Software engineering"]), ("Software sales", []), ("Engineering", [])])
def test_dislikes(spark, title, hits):
    assert spark.range(1).select(screening.disliked(F.lit(title), ["Tax roles", "Software engineering"])).first()[0] == hits
