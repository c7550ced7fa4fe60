"""Readers, writers, connectors, the whole run, streams, and every registered query against its SQL."""

import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quillmark.operators import snapshot
from quillmark.plans import queries, workflow
from quillmark.sinks import tables as sinks
from quillmark.sources import feeds, inputs, schemas, tables
from quillmark.streaming import feeds as streams

SF = "/root/testdata/sf0.001"


def write(path, content):
    path.write_text(content if isinstance(content, str) else json.dumps(content), encoding="utf-8")
    return str(path)


def test_readers(spark, tmp_path):
    row = {"title": "t", "company": "c", "location": "l", "posting_url": "u", "date_collected": "d", "source_url": "s"}
    path = write(tmp_path / "p.jsonl", json.dumps(row) + "\n\n" + json.dumps(row | {"eligibility_text": "e"}) + "\n")
    assert [r["eligibility_text"] for r in tables.postings(spark, path).collect()] == ["", "e"]
    assert tables.postings(spark, str(tmp_path / "none")).count() == 0
    bad = write(tmp_path / "bad.jsonl", json.dumps(row) + "\nnot json\n")
    with pytest.raises(Exception):
        tables.postings(spark, bad).collect()
    log = write(tmp_path / "log.jsonl", '{"timestamp":"t","date":"d","action":"email","subject":"s"}\nbroken\n')
    assert tables.activity_events(spark, log).count() == 1
    assert [r["status"] for r in tables.reviews(spark, write(tmp_path / "r.json", {"u": {"status": "applied"}, "v": "x"})).collect()] == ["applied"]
    assert {r["posting_url"]: r["notes"] for r in tables.notes(spark, write(tmp_path / "n.json", {"u": {"notes": "hi"}})).collect()} == {"u": "hi"}
    assert tables.sent_history(spark, write(tmp_path / "s.json", {"sent_posting_urls": ["a", "a", "b"]})).count() == 2
    assert tables.location_markers(spark, write(tmp_path / "m.txt", "# x\n Berlin \n\nTel Aviv\n")) == ["berlin", "tel aviv"]
    source = {"company": "A", "website": "w", "careers_url": "c", "source_type": "x", "origin": "seed", "has_connection": True, "notes": ""}
    registry = tables.source_registry(spark, write(tmp_path / "reg.json", [source])).first()
    assert registry["collector"] == "auto" and registry["alternate_careers_urls"] == []
    with pytest.raises(Exception):
        tables.source_registry(spark, str(tmp_path / "none")).collect()
    old = {c.split()[0]: ("A B" if c.endswith("string") else True) for c in schemas.HISTORY.split(", ")} | {"role_key": ""}
    assert tables.history(spark, write(tmp_path / "h.json", [old])).first()["role_key"] == "a b|a b|a b"
    assert tables.attachments(spark, str(tmp_path / "m.txt")).first()["name"] == "m.txt"
    hits = "\n".join(json.dumps({"title": "t", "url": u, "snippet": "", "provider": "p", "query": "Acme summer 2027 internship careers", "date_searched": "d", "relevance_score": s}) for u, s in (("b", 1), ("a", 1), ("c", 9)))
    assert [r["url"] for r in tables.search_results_by_company(spark, write(tmp_path / "q.jsonl", hits)).first()["results"]] == ["c", "a", "b"]


def test_inputs(tmp_path):
    companies, industries = inputs.companies_table("| Name | Website | Known | C |\n|---|---|---|---|\n| A | w | yes | Bo |\n| B | v | | |\n- finance\n")
    assert [c["has_connection"] for c in companies] == [True, False] and industries == ["finance"]
    for broken in ("- x", "| A | w |", "| A | w | maybe |"):
        with pytest.raises(inputs.InputError):
            inputs.companies_table(broken)
    assert inputs.preferences("## Things I like\n1. **AI**\n- Go\n## Things I don't like\n- Tax\n") == (["AI", "Go"], ["Tax"])
    assert inputs.courses("## Program\n- **Major:** Math\n## core\n- **M1:** Algebra\n") == ({"Major": "Math"}, [{"code": "M1", "title": "Algebra", "category": "Core"}])
    assert inputs.companies_table(inputs.companies_markdown(companies, industries)) == (companies, industries)
    assert inputs.preferences(inputs.preferences_markdown(["a"], ["b"])) == (["a"], ["b"])
    assert inputs.env_file(write(tmp_path / ".env", "A=1\n# c\nB='x y'\n")) == {"A": "1", "B": "x y"}
    (tmp_path / "resume.md").write_text("line\n" * 2000)
    assert len(inputs.resume_text(str(tmp_path))) <= 4000


def test_sinks(spark, tmp_path):
    reviews = spark.createDataFrame([("u", "applied")], "posting_url string, status string")
    assert {r[0]: r[1] for r in sinks.with_status(sinks.with_status(reviews, "u", "archived"), "v", "applied").collect()} == {"u": "archived", "v": "applied"}
    with pytest.raises(ValueError):
        sinks.with_status(reviews, "u", "nope")
    notes = spark.createDataFrame([("u", "x")], "posting_url string, notes string")
    assert sinks.with_note(notes, "u", " ").count() == 0
    path = str(tmp_path / "state")
    for n in (1, 2, 3):
        old = spark.read.parquet(path) if tables.exists(spark, path) else spark.createDataFrame([], "n int")
        sinks.state(old.union(spark.createDataFrame([(n,)], "n int")), path)
    assert spark.read.parquet(path).count() == 3
    sinks.activity(spark, str(tmp_path / "log"), "email", "s", now="2026-07-01T10:00:00Z")
    sinks.activity(spark, str(tmp_path / "log"), "email", "s")
    assert tables.activity_events(spark, str(tmp_path / "log")).count() == 2
    rows = spark.createDataFrame([("A", "t", "l", "u", ["r"])], "company string, title string, location string, posting_url string, reasons array<string>")
    assert "## A" in list(sinks.report(rows, "Report", "company", sinks.review_lines, {"n": 1}))


PAYLOADS = {
    "phenom_api": {"refineSearch": {"totalHits": 1, "data": {"jobs": [{"jobId": "7", "title": "Data Intern 2027", "location": "Oslo", "descriptionTeaser": "<p>a</p>"}]}}},
    "mckinsey_jobs": {"numFound": 1, "docs": [{"jobID": "1", "title": "Summer Associate 2027", "friendlyURL": "x-1", "cities": ["Oslo", "Rome"], "yourBackground": "b"}]},
    "lever_api": [{"id": "1", "text": "Research Intern", "hostedUrl": "https://jobs.lever.co/a/1", "categories": {"location": "Oslo"}}],
    "greenhouse_api": {"jobs": [{"title": "Research Intern", "absolute_url": "https://boards.greenhouse.io/a/jobs/1", "location": {"name": "X"}, "offices": [{"name": "Oslo"}], "content": "c"}]},
    "jibe_jobs": {"totalCount": 1, "jobs": [{"data": {"req_id": "1", "title": "Acme Research Intern", "full_location": "Oslo"}}]},
    "adp_workforce_now": {"meta": {"totalNumber": 1}, "jobRequisitions": [{"itemID": "1", "requisitionTitle": "Research Intern", "customFieldGroup": {"stringFields": [{"nameCode": {"codeValue": "ExternalJobID"}, "stringValue": "9"}]}, "requisitionLocations": [{"nameCode": {"shortName": "Oslo"}}]}]},
    "eightfold_pcsx": {"data": {"count": 1, "positions": [{"id": "1", "name": "Research Intern", "positionUrl": "/job/1", "locations": ["Oslo"]}]}},
    "general_dynamics_jobs": {"Results": [{"Title": "Research Intern", "Link": {"Url": "/x-opportunity"}, "LocationNames": ["Oslo"]}]},
    "ashby_api": {"jobs": [{"title": "Research Intern", "jobUrl": "https://jobs.ashbyhq.com/a/1", "location": "Oslo", "isListed": True}, {"title": "Hidden Intern 2027", "jobUrl": "https://x/2", "isListed": False}]},
    "workday_api": {"total": 1, "jobPostings": [{"title": "Research Intern", "externalPath": "/job/Oslo/x_1", "locationsText": "Oslo", "bulletFields": ["1"]}]},
    "oracle_recruiting_api": {"items": [{"TotalJobsCount": 1, "requisitionList": [{"Id": "1", "Title": "Research Intern", "PrimaryLocation": "Oslo"}]}]},
    "goldman_higher": {"data": {"roleSearch": {"totalCount": 1, "items": [{"roleId": "1", "jobTitle": "Summer Analyst 2027", "locations": [{"city": "Oslo", "state": "", "country": "Norway"}]}]}}},
    "ibm_careers": {"hits": {"hits": [{"_source": {"title": "Research Intern", "url": "https://x.com/job/1", "field_keyword_19": "Oslo"}}]}},
    "elbit_jobs": [{"id": "1", "title": "Student engineer", "url": "https://x.com/job/1", "city": "Oslo"}],
    "bank_of_america_jobs": {"totalMatches": 1, "jobsList": [{"jobRequisitionId": "1", "jcrURL": "/en-us/job-detail/1/x", "postingTitle": "Summer Analyst 2027", "location": "Oslo"}]},
    "consider_board": {"jobs": [{"company": {"name": "Acme"}, "jobs": [{"title": "Research Intern", "url": "https://x.com/jobs/1", "locations": ["Oslo"], "companyName": "Acme"}]}], "meta": {"size": 60}},
}


@pytest.mark.parametrize("name", sorted(feeds.FEEDS))
def test_feed(spark, name):
    payloads = feeds.fetched(spark, feeds.FEEDS[name], lambda ask: json.dumps(PAYLOADS[name]), "Acme")
    rows = payloads.withColumns({"company": F.col("source"), "careers_url": F.lit("https://acme.com/careers?keywords=Acme")})
    got = feeds.read_feed(name, rows, "2026-07-01").collect()
    assert len(got) == 1 and "Oslo" in got[0]["location"] and got[0]["posting_url"].startswith("https://") and got[0]["company"] == "Acme"


def test_paging_ends_and_fails():
    feed = feeds.FEEDS["lever_api"]
    sizes = iter([100, 100, 3])
    assert [n for n, _ in feeds.pages(feed, lambda ask: json.dumps([{"id": str(i)} for i in range(next(sizes))]))] == [0, 1, 2]
    with pytest.raises(feeds.FeedError):
        list(feeds.pages(feed, lambda ask: json.dumps([{}] * 100)))
    with pytest.raises(feeds.FeedError):
        list(feeds.pages(feed, lambda ask: "{}"))
    short = feeds.FEEDS["workday_api"]
    starts = []

    def page(ask):
        starts.append(ask["start"])
        return json.dumps({"total": 25, "jobPostings": [{}] * (15 if ask["start"] == 0 else 10)})

    assert len(list(feeds.pages(short, page))) == 2 and starts == [0, 15]
    tries = []

    def flaky():
        tries.append(1)
        if len(tries) < 3:
            raise RuntimeError("HTTP 503")
        return "ok"

    assert feeds.with_retry(flaky, sleep=lambda s: None) == "ok" and len(tries) == 3


def test_html_connectors(spark, tmp_path):
    html = """<script type="application/ld+json">{"@graph":[{"@type":"JobPosting","title":"Research Intern","url":"/job/a/1","jobLocation":[{"address":{"addressLocality":"Oslo"}},{"address":{"addressLocality":"Rome"}}]}]}</script>
<script id="__NEXT_DATA__">{"props":{"deep":[{"title":"Data Intern 2027","url":"/job/b/2","location":"Rome"}]}}</script>
<h1>Marketing internship</h1><p>Responsibilities</p><tr class="data-row"><td><a href="/job/c/3" class="jobTitle-link">Bio Intern 2027</a></td><td class="colLocation">Bern</td></tr>"""
    pages = spark.createDataFrame([("https://acme.com/x", html, "Acme", "https://acme.com/x")], "page_url string, html string, company string, careers_url string")
    read = lambda name: [(r["title"], r["location"], r["posting_url"]) for r in feeds.read_html(name, pages, "2026-07-01").collect()]
    assert read("json_ld") == [("Research Intern", "Oslo | Rome", "https://acme.com/job/a/1")]
    assert read("embedded_json") == [("Data Intern 2027", "Rome", "https://acme.com/job/b/2")]
    assert read("semantic_detail") == [("Marketing internship", "Unknown", "https://acme.com/x")]
    assert read("bayer_successfactors") == [("Bio Intern 2027", "Bern", "https://acme.com/job/c/3")]
    assert read("successfactors_html") == [("Bio Intern 2027", "Unknown", "https://acme.com/job/c/3")]
    with pytest.raises(Exception):
        feeds.confirmed_empty(pages, "closed").count() or pages.where(F.assert_true(F.col("html").contains("closed")).isNotNull()).collect()
    direct = spark.createDataFrame([("Acme", "https://acme.com/job/research-intern/12"), ("B", "https://b.com/careers")], "company string, careers_url string")
    assert [r["title"] for r in feeds.direct_posting(direct, "d").collect()] == ["Research Intern"]
    tried = direct.select(feeds.strategies(F.col("company"), F.lit("https://boards.greenhouse.io/a"), F.lit(""), F.lit("auto")).alias("s")).first()["s"]
    assert tried[0] == "greenhouse_api" and tried[-1] == "generic_links"
    (tmp_path / "acme").mkdir()
    write(tmp_path / "acme" / "0.json", PAYLOADS["lever_api"])
    spark.dataSource.register(feeds.StoredPages)
    stored = spark.read.format("stored_pages").load(str(tmp_path))
    rows = stored.withColumns({"company": F.col("source"), "careers_url": F.lit("https://jobs.lever.co/a")})
    assert feeds.read_feed("lever_api", rows, "d").count() == 1
    found = spark.createDataFrame([('{"items":[{"title":"A","link":"https://a.com/#x","snippet":"s"},{"title":"B","link":""}]}', "q", "d")], "payload string, query string, date_searched string")
    assert [r["url"] for r in feeds.search_payload(found, "google").collect()] == ["https://a.com/"]
    page = '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fa.com">A &amp; B</a><a class="result__snippet">snip</a><a class="result__a" href="https://a.com">again</a>'
    got = feeds.search_page(spark.createDataFrame([(page, "q", "d")], "html string, query string, date_searched string")).collect()
    assert [(r["title"], r["url"], r["snippet"]) for r in got] == [("A & B", "https://a.com", "snip")]


def postings_of(spark, *numbers):
    rows = [(f"Data Intern 2027 {n}", "Acme", "Remote", f"https://acme.com/jobs/{n}", "2026-07-01", "https://acme.com", "") for n in numbers]
    return spark.createDataFrame(rows, schemas.POSTING)


def test_workflow(spark, tmp_path):
    source = {"website": "w", "careers_url": "c", "source_type": "x", "origin": "seed", "has_connection": True, "notes": ""}
    write(tmp_path / "source_registry.json", [dict(source, company="Acme"), dict(source, company="Idle")])
    own = inputs.Inputs(likes=["Data science"], dislikes=["Tax"])
    sent = []
    first = workflow.run(spark, str(tmp_path), own, [], postings_of(spark, 1, 2), deliver=lambda df: sent.append(df.count()))
    assert first.status == "success", first.steps
    second = workflow.run(spark, str(tmp_path), own, [], postings_of(spark, 2, 3), deliver=lambda df: sent.append(df.count()))
    assert second.status == "success" and sent == [2, 1]
    assert second.steps[1].detail == "missing 1, new 1, seen 1"
    assert [r["company"] for r in tables.monitored(spark, str(tmp_path / "monitored_no_openings.jsonl")).collect()] == ["Idle"]
    failed = workflow.run(spark, str(tmp_path), own, [], postings_of(spark, 4), deliver=lambda df: "mailbox full")
    assert failed.status == "partial" and spark.read.json(str(tmp_path / "runs.jsonl")).count() == 3
    broken = workflow.run(spark, str(tmp_path / "elsewhere"), own, [], postings_of(spark, 4))
    assert broken.status == "failed" and [s.name for s in broken.steps] == ["collection", "detection", "screening"]


def test_streams(spark, tmp_path):
    incoming, log = tmp_path / "in", tmp_path / "log"
    for n, numbers in enumerate([(1, 2), (2, 3)]):
        postings_of(spark, *numbers).coalesce(1).write.mode("append").json(str(incoming))
        query = streams.snapshot_stream(spark, str(incoming), str(tmp_path / "state"), str(tmp_path / "changes"), str(tmp_path / "cp"))
        query.awaitTermination(120)
    found = spark.read.json(str(tmp_path / "changes"))
    assert sorted((r["batch"], r["status"]) for r in found.collect()) == [(0, "new"), (0, "new"), (1, "missing"), (1, "new"), (1, "seen")]
    assert spark.read.parquet(str(tmp_path / "state")).count() == 3
    for _ in range(2):
        sinks.activity(spark, str(log), "email", "s", now="2026-07-01T10:00:00Z")
    query = streams.activity_stream(spark, str(log)).writeStream.format("memory").queryName("events").option("checkpointLocation", str(tmp_path / "cp2")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert spark.table("events").count() == 1
    assert snapshot.status_counts(found).count() == 3


def cell(value):
    return f"{value:.9g}" if isinstance(value, float) else None if value is None else str(value)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{name}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_its_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    if name in queries.ORACLE_SQL:
        found = duck.execute(queries.ORACLE_SQL[name])
        columns = [c[0] for c in found.description]
        assert sorted(columns) == sorted(df.columns)
        order = [columns.index(c) for c in df.columns]
        want = sorted(str([cell(r[i]) for i in order]) for r in found.fetchall())
        assert sorted(str([cell(v) for v in r]) for r in rows) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_summaries(spark):
    from quillmark.plans import summaries

    rows = spark.createDataFrame([("A", "t1", "u1", 80, "strong", 5, "https://x.lever.co/1", True, ["Listing type: X."]), ("B", "t2", "u2", 60, "medium", 9, "https://y.com/2", False, ["Listing type: Y."])],
                                 "company string, title string, url string, score int, fit_level string, relevance_score int, posting_url string, included boolean, reasons array<string>")
    assert "- A: t1 (80, strong)" in summaries.scores(rows) and "By company:" in summaries.collection(rows, rows.limit(0))
    assert "- Y: 1" in summaries.screening_result(rows) and "t2 (9)" in summaries.search_results(rows) and "No Indeed" in summaries.boards(rows)
    assert summaries.block("T", []) == "T\n="


def test_editable_inputs(tmp_path):
    folder = str(tmp_path)
    assert inputs.editable_text(folder, "connections.md") == ""
    inputs.write_editable_text(folder, "connections.md", "hi")
    assert inputs.editable_text(folder, "connections.md") == "hi"
    for name, content in (("../x", "a"), ("course_list.md", "nothing")):
        with pytest.raises(inputs.InputError):
            inputs.write_editable_text(folder, name, content)
    assert inputs.preferences_of({"likes": [" a ", ""], "dislikes": ["b"]}) == (["a"], ["b"])
    with pytest.raises(inputs.InputError):
        inputs.preferences_of({"likes": "a"})
