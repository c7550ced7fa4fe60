"""The engine's registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import listing, metadata, places, text, urls
from ..operators import crawl, dedupe, digest, discovery, monitor, review, rollup, scoring, screening, search, snapshot
from ..shipping import ship
from ..sources import feeds
from . import oracle as O
from .fixtures import DISLIKES, INDUSTRIES, LIKES, MARKERS, POSTINGS, SOURCES, postings, sources, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL."""

    def add(query: Query) -> Query:
        @wraps(query)
        def shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return query(spark, sf_dir)

        QUERIES[query.__name__] = shipped
        if sql is not None:
            ORACLE_SQL[query.__name__] = sql
        return query

    return add


def _screened(spark: SparkSession, sf_dir: str) -> DataFrame:
    return screening.screened(postings(spark, sf_dir), DISLIKES, MARKERS)


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.scored(_screened(spark, sf_dir), sources(spark, sf_dir), LIKES, INDUSTRIES, DISLIKES, MARKERS)


@register(f"SELECT page_id, {O.canonical('url')} AS canonical FROM pages")
def canonical_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", urls.canonical(F.col("url")).alias("canonical"))


@register(f"{O.WITH}, {O.KEYED} SELECT ord, posting_id, role_key FROM keyed")
def posting_keys(spark, sf_dir):
    return dedupe.with_keys(postings(spark, sf_dir)).select("ord", "posting_id", "role_key")


@register(f"{O.WITH}, {O.ROLES} SELECT ord, posting_id, role_key FROM kept")
def role_dedupe(spark, sf_dir):
    return dedupe.one_per_role(postings(spark, sf_dir))[0].select("ord", "posting_id", "role_key")


@register(f"""{O.WITH}, {O.ROLES}, best AS (SELECT * FROM ranked WHERE rnk = 1)
SELECT b.posting_id, r.posting_url AS loser, b.date_collected AS first_seen FROM ranked r JOIN best b USING (role_key) WHERE r.rnk > 1""")
def role_duplicates(spark, sf_dir):
    losers = dedupe.one_per_role(postings(spark, sf_dir))[1]
    url = F.regexp_extract("reason", "alternate URL (.*) using company", 1)
    return losers.select("posting_id", url.alias("loser"), "first_seen")


@register("""WITH k AS (SELECT *, concat(lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)), rtrim(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '/')) AS k FROM pages)
SELECT k AS page_key, arg_max(page_id, (starts_with(url, 'https')::INT, (NOT contains(url, 'utm_'))::INT, length(url), page_id)) AS page_id FROM k GROUP BY k""")
def page_dedupe_preferred(spark, sf_dir):
    url = F.col("url")
    key = F.concat(urls.host(url), F.regexp_replace(urls.path(url), "/+$", ""))
    better = F.struct(url.startswith("https").cast("int"), (~url.contains("utm_")).cast("int"), F.length(url), "page_id")
    return table(spark, sf_dir, "pages").groupBy(key.alias("page_key")).agg(F.max_by("page_id", better).alias("page_id"))


@register("""SELECT concat_ws('|', trim(regexp_replace(lower(p_brand), '[^a-z0-9]+', ' ', 'g')), trim(regexp_replace(lower(p_name), '[^a-z0-9]+', ' ', 'g')),
trim(regexp_replace(lower(p_type), '[^a-z0-9]+', ' ', 'g'))) AS role_key, count(*) AS n FROM part GROUP BY 1""")
def role_key_groups(spark, sf_dir):
    key = text.role_key(F.col("p_brand"), F.col("p_name"), F.col("p_type"))
    return table(spark, sf_dir, "part").groupBy(key.alias("role_key")).agg(F.count("*").alias("n"))


@register(f"{O.WITH}, {O.CLASSIFIED} SELECT ord, is_specific, category, reason FROM classified")
def listing_classifier(spark, sf_dir):
    found = listing.with_classified(postings(spark, sf_dir), F.col("title"), F.col("posting_url"), "c")
    return found.select("ord", "c.is_specific", "c.category", "c.reason")


@register(f"SELECT doc_id, {O.first_in('lower(text)', ['that the', 'the of', 'of the', 'and', 'de la', 'der'])} AS fragment FROM documents")
def first_match_fragment(spark, sf_dir):
    found = urls.first_contained(F.lower("text"), ["that the", "the of", "of the", "and", "de la", "der"])
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("fragment"))


@register(f"{O.WITH} SELECT ord, {O.ALLOWED} AS allowed FROM postings")
def location_policy(spark, sf_dir):
    ok = places.allowed(F.col("location"), F.col("title"), F.col("eligibility_text"), MARKERS)
    return postings(spark, sf_dir).select("ord", ok.alias("allowed"))


@register(f"{O.WITH} SELECT ord, {O.GRADUATE} AS graduate_only FROM postings")
def graduate_rule(spark, sf_dir):
    return postings(spark, sf_dir).select("ord", listing.is_graduate_only(F.col("title"), F.col("eligibility_text")).alias("graduate_only"))


@register("""SELECT p_partkey, concat_ws(', ', CASE WHEN contains(p_name, 'small') AND contains(p_name, 'ring') THEN 'Small rings' END,
CASE WHEN contains(p_name, 'widget') THEN 'Widgets' END) AS conflicts FROM part""")
def dislike_conflict(spark, sf_dir):
    found = screening.disliked(F.col("p_name"), ["Small rings", "Widgets"])
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(found, ", ").alias("conflicts"))


@register(f"{O.WITH}, {O.SCREENED} SELECT ord, included, reasons FROM screened")
def split_included_excluded(spark, sf_dir):
    return _screened(spark, sf_dir).select("ord", "included", F.array_join("reasons", "; ").alias("reasons"))


@register(f"{O.WITH}, {O.SCREENED} SELECT {O.LABEL} AS label, count(*) AS n FROM screened WHERE NOT included GROUP BY 1")
def excluded_by_type(spark, sf_dir):
    return screening.excluded_by_type(_screened(spark, sf_dir))


@register(f"""{O.WITH}, {O.SCORED} SELECT title, company, posting_url, score, CASE WHEN score >= 75 THEN 'strong' WHEN score >= 50 THEN 'medium' ELSE 'weak' END AS fit_level, len(good) AS n_preferences, count(*) AS n
FROM scored GROUP BY ALL""")
def fit_score(spark, sf_dir):
    said = F.try_element_at(F.filter("explanations", lambda e: e.startswith("Matches preferences: ")), F.lit(1))
    n = F.when(said.isNull(), 0).otherwise(F.size(F.split(said, ", "))).cast("long")
    rows = _scored(spark, sf_dir).withColumn("n_preferences", n)
    return rows.groupBy("title", "company", "posting_url", "score", "fit_level", "n_preferences").agg(F.count("*").alias("n"))


@register(f"""{O.WITH}, {O.SCORED} SELECT DISTINCT title, company, posting_url, score FROM scored WHERE score >= 60
AND posting_url NOT IN (SELECT posting_url FROM postings WHERE seen_on < '1995-06-01') AND posting_url NOT IN (SELECT posting_url FROM postings WHERE seen_on >= '2000-06-01' AND state = 'P')
AND CASE WHEN lower(trim(location)) IN ('', 'unknown') THEN {O.text_allowed(O.join_texts('title'))} WHEN {O.any_in('lower(location)', L.FLEXIBLE_MARKERS)}
 THEN {O.any_in(O.join_texts('location', 'title'), MARKERS)} OR {O.text_allowed(O.join_texts('location', 'title'))} ELSE {O.text_allowed('lower(trim(location))')} END""")
def email_selection(spark, sf_dir):
    all_ = postings(spark, sf_dir)
    rows = digest.selected(_scored(spark, sf_dir), all_.where("seen_on < '1995-06-01'"), all_.where("seen_on >= '2000-06-01' and state = 'P'"), MARKERS)
    return rows.select("title", "company", "posting_url", "score").distinct()


@register(f"""{O.WITH}, {O.SCORED} SELECT company, CASE WHEN score >= 75 THEN 'strong' WHEN score >= 50 THEN 'medium' ELSE 'weak' END AS fit_level, count(*) AS n FROM scored GROUP BY ALL""")
def company_fit_grouping(spark, sf_dir):
    rows = digest.grouped(dedupe.with_order(_scored(spark, sf_dir)))
    return rows.select("company", "fit_level", F.size("titles").cast("long").alias("n"))


@register("""WITH s AS (SELECT concat('C', c_custkey) AS company, c_custkey FROM customer),
 f AS (SELECT concat('C', o_custkey) AS company, o_orderstatus = 'F' AS included FROM orders), e AS (SELECT concat('C', user_id) AS company, event_id, event_type FROM events WHERE event_type = 'error')
SELECT s.company, (SELECT count(*) FROM f WHERE f.company = s.company) AS candidates_collected, (SELECT count(*) FROM f WHERE f.company = s.company AND NOT included) AS excluded_pages,
 coalesce((SELECT arg_max(concat('error ', event_id), event_id) FROM e WHERE e.company = s.company), '') AS collection_error
FROM s WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.company = s.company AND included)""")
def monitored_anti_join(spark, sf_dir):
    company = table(spark, sf_dir, "customer").selectExpr("concat('C', c_custkey) company", "'' website", "'' careers_url", "false has_connection")
    seen = table(spark, sf_dir, "orders").selectExpr("concat('C', o_custkey) company", "o_orderstatus = 'F' included", "'' date_collected")
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("concat('C', user_id) company", "concat('error ', event_id) message", "event_id ord")
    rows = monitor.without_openings(company, seen, seen, errors, "2026-07-01")
    return rows.select("company", "candidates_collected", "excluded_pages", "collection_error")


@register(f"""WITH sources AS ({SOURCES}) SELECT company, arg_min(has_connection, ord) AS first_link, arg_max(has_connection, ord) AS last_link FROM sources GROUP BY company""")
def connection_lookup(spark, sf_dir):
    rows = sources(spark, sf_dir)
    none = spark.createDataFrame([], "name string, has_connection boolean")
    last = monitor.connections(rows, none).withColumnRenamed("has_connection", "last_link")
    return monitor.first_connection(rows).withColumnRenamed("has_connection", "first_link").join(last, "company")


_HALVES = f"""{O.WITH.replace('postings AS', 'everything AS')},
 old_raw AS (SELECT * FROM everything WHERE seen_on < '1999-07-01'), now_raw AS (SELECT * REPLACE (CASE WHEN ord % 10 = 3 THEN concat(title, ' II') ELSE title END AS title) FROM everything WHERE seen_on >= '1997-01-01')"""


def _roles_of(source: str, out: str) -> str:
    names = {"postings": source, "keyed": f"{out}_keyed", "firsts": f"{out}_firsts", "ranked": f"{out}_ranked", "kept": out}
    sql = O.ROLES
    for old, new in names.items():
        for before, after in ((f"{old} AS (", f"{new} AS ("), (f"FROM {old} ", f"FROM {new} "), (f"FROM {old})", f"FROM {new})")):
            sql = sql.replace(before, after)
    return sql


_HASH = "concat_ws('~', title, company, location, posting_id, source_url)"
_CDC = f"""{_HALVES}, {_roles_of('old_raw', 'h0')}, {_roles_of('now_raw', 'n0')},
 h AS (SELECT *, ord % 7 <> 0 AS active, {_HASH} AS hash FROM h0), n AS (SELECT *, {_HASH} AS hash FROM n0),
 hr AS (SELECT role_key, arg_min(posting_id, ord) AS alt FROM h GROUP BY role_key),
 m AS (SELECT n.*, coalesce(h1.posting_id, h2.posting_id) AS pid, coalesce(h1.active, h2.active) AS pactive, coalesce(h1.hash, h2.hash) AS phash, coalesce(h1.date_collected, h2.date_collected) AS pfirst
  FROM n LEFT JOIN h h1 ON h1.posting_id = n.posting_id LEFT JOIN hr ON hr.role_key = n.role_key AND h1.posting_id IS NULL AND hr.alt <> n.posting_id LEFT JOIN h h2 ON h2.posting_id = hr.alt)"""


def _detection(spark, sf_dir) -> snapshot.Detection:
    """The postings seen before mid-1999 as history, those since 1997, some retitled, as this run."""
    rows = postings(spark, sf_dir)
    old = dedupe.one_per_role(rows.where("seen_on < '1999-07-01'"))[0]
    digest_ = text.content_hash(F.col("title"), F.col("company"), F.col("location"), F.col("posting_id"), F.col("source_url"))
    history = old.select(
        "ord", "posting_id", "title", "company", "location", "posting_url", "source_url", F.col("date_collected").alias("first_seen"),
        F.col("date_collected").alias("last_seen"), digest_.alias("content_hash"), (F.col("ord") % 7 != 0).alias("active"), "role_key",
    )
    retitled = F.when(F.col("ord") % 10 == 3, F.concat("title", F.lit(" II"))).otherwise(F.col("title"))
    return snapshot.detect_changes(rows.where("seen_on >= '1997-01-01'").withColumn("title", retitled), history)


@register(f"""{_CDC} SELECT CASE WHEN pid IS NULL THEN 'new' WHEN NOT pactive OR phash <> hash THEN 'changed' ELSE 'seen' END AS status, coalesce(pid, posting_id) AS posting_id,
 title, coalesce(pfirst, date_collected) AS first_seen FROM m
UNION ALL SELECT 'missing', posting_id, title, date_collected FROM h WHERE posting_id NOT IN (SELECT pid FROM m WHERE pid IS NOT NULL)
UNION ALL SELECT 'duplicate', b.posting_id, b.title, b.date_collected FROM n0_ranked r JOIN (SELECT * FROM n0_ranked WHERE rnk = 1) b USING (role_key) WHERE r.rnk > 1""")
def snapshot_cdc(spark, sf_dir):
    return _detection(spark, sf_dir).changes.select("status", "posting_id", "title", "first_seen")


@register(f"""{_CDC} SELECT posting_id, title, active FROM (SELECT coalesce(pid, posting_id) AS posting_id, title, true AS active FROM m
 QUALIFY row_number() OVER (PARTITION BY coalesce(pid, m.posting_id) ORDER BY m.posting_id DESC) = 1)
UNION ALL SELECT posting_id, title, false FROM h WHERE posting_id NOT IN (SELECT pid FROM m WHERE pid IS NOT NULL)""")
def snapshot_history(spark, sf_dir):
    return _detection(spark, sf_dir).history.select("posting_id", "title", "active")


@register("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_state_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("ord", F.col("event_id"))
    return dedupe.last_of_each(rows, "user_id").select("user_id", "event_id", "event_type")


@register("SELECT conv_id AS posting_url, arg_max(text, (length(trim(text)), -turn)) AS eligibility_text FROM conversations GROUP BY conv_id")
def merge_preference_fold(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").selectExpr(
        "turn ord", "'t' title", "'c' company", "'Unknown' location", "cast(conv_id as string) posting_url", "'' date_collected", "'' source_url", "text eligibility_text"
    )
    return dedupe.merged_by(rows, F.col("posting_url")).select(F.col("posting_url").cast("long").alias("posting_url"), "eligibility_text")


_RESULTS = "SELECT page_id, regexp_extract(html, '<h1>(.*?)</h1>', 1) AS title, url, 'An official page' AS snippet, regexp_extract(url, '://([^./]*)', 1) AS company FROM pages"
_SCORE = f"""CASE WHEN {O.any_in(O.HOST.format('url'), L.BLOCKED_DOMAINS)} THEN -100 ELSE CASE WHEN {O.any_in("lower(concat_ws(' ', title, url, snippet))", L.CAREER_KEYWORDS)} THEN 20 ELSE 0 END
 + CASE WHEN length(company) > 2 AND contains({O.HOST.format('url')}, lower(company)) THEN 25 ELSE 0 END
 + CASE WHEN length({O.HOST.format('url')}) - length(replace({O.HOST.format('url')}, '.', '')) <= 2 THEN 5 ELSE 0 END + 3 END"""


def _results(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1).alias("title"), "url", F.lit("An official page").alias("snippet"),
        F.regexp_extract("url", "://([^./]*)", 1).alias("company"),
    )


@register(f"SELECT page_id, {_SCORE} AS relevance_score FROM ({_RESULTS})")
def search_relevance(spark, sf_dir):
    return search.ranked_results(_results(spark, sf_dir), F.col("company")).select("page_id", "relevance_score")


@register(f"SELECT page_id, {_SCORE} AS relevance_score FROM ({_RESULTS}) ORDER BY relevance_score DESC, page_id LIMIT 5")
def search_top5(spark, sf_dir):
    return search.ranked_results(_results(spark, sf_dir), F.col("company")).orderBy(F.desc("relevance_score"), "page_id").limit(5).select("page_id", "relevance_score")


_TIERS = "SELECT l_partkey AS company_key, l_orderkey * 8 + l_linenumber AS ord, l_quantity::INT AS relevance_score, concat('https://e.com/', CASE WHEN l_linenumber % 2 = 0 THEN 'job/' ELSE 'page/' END, l_orderkey, '/', l_linenumber) AS url FROM lineitem"


def _tiers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_partkey company_key", "l_orderkey * 8 + l_linenumber ord", "int(l_quantity) relevance_score",
        "concat('https://e.com/', CASE WHEN l_linenumber % 2 = 0 THEN 'job/' ELSE 'page/' END, l_orderkey, '/', l_linenumber) url",
    )


@register(f"""SELECT company_key, url, relevance_score FROM ({_TIERS}) WHERE relevance_score >= 15 AND (contains(url, '/job/') OR relevance_score >= 25)
QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY relevance_score DESC, url) = 1""")
def tiered_top1(spark, sf_dir):
    return search.best_page(_tiers(spark, sf_dir)).select("company_key", "url", "relevance_score")


@register(f"""WITH t AS ({_TIERS}), b AS (SELECT company_key, url AS best FROM t WHERE relevance_score >= 15 AND (contains(url, '/job/') OR relevance_score >= 25)
 QUALIFY row_number() OVER (PARTITION BY company_key ORDER BY relevance_score DESC, url) = 1), f AS (SELECT t.company_key, t.url, min(ord) AS ord FROM t LEFT JOIN b USING (company_key)
 WHERE relevance_score >= 15 AND contains(t.url, '/job/') AND (best IS NULL OR t.url <> best) GROUP BY ALL) SELECT company_key, string_agg(url, ' ' ORDER BY ord, url) AS urls FROM f GROUP BY company_key""")
def alternates_list(spark, sf_dir):
    rows = _tiers(spark, sf_dir)
    return search.alternate_pages(rows, search.best_page(rows)).select("company_key", F.array_join("urls", " ").alias("urls"))


def _review_rows(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents").selectExpr(
        "concat('https://e.com/job/', doc_id) posting_url", "concat('Intern ', doc_id) title", "source company", "'Remote' location", "'' date_collected",
        "'' source_url", "'' eligibility_text", "true included", "cast(array() as array<string>) reasons", "doc_id",
    )
    labels = table(spark, sf_dir, "labels")
    scored_ = labels.selectExpr(
        "concat('https://e.com/job/', doc_id) posting_url", "50 + 30 * quality score", "case when quality = 1 then 'strong' else 'medium' end fit_level",
        "cast(array() as array<string>) explanations", "cast(array() as array<string>) gaps",
    )
    reviews = labels.selectExpr("concat('https://e.com/job/', doc_id) posting_url", "case when toxic = 1 then 'ignored' when quality = 1 then 'applied' else ' ' end status")
    url = lambda rows: rows.selectExpr("concat('https://e.com/job/', doc_id) posting_url")
    notes = labels.limit(0).selectExpr("'' posting_url", "'' notes")
    links = spark.createDataFrame([(f"src{i}", i % 2 == 0) for i in range(20)], "company string, has_connection boolean")
    docs_ids = table(spark, sf_dir, "documents")
    return review.reviewable(
        docs, scored_, reviews, notes, links, url(docs_ids.where("lang = 'en'")), url(docs_ids.where("source = 'src3'")), url(docs_ids.where("n_chars > 4000")), [], MARKERS
    )


_STAR = """WITH r AS (SELECT d.doc_id, d.source AS company, 50 + 30 * l.quality AS score, CASE WHEN l.toxic = 1 THEN 'not_interested' WHEN l.quality = 1 THEN 'applied' ELSE 'to_review' END AS review_status,
 CASE WHEN d.source = 'src3' THEN 'emailed' WHEN d.n_chars > 4000 THEN 'inactive' WHEN l.doc_id IS NULL THEN 'not_scored' ELSE 'ready' END AS email_status, d.lang = 'en' AS is_new,
 regexp_extract(d.source, '[0-9]+')::INT % 2 = 0 AS has_connection, coalesce(50 + 30 * l.quality >= 60, false) AS recommended FROM documents d LEFT JOIN labels l USING (doc_id))"""


@register(f"""{_STAR} SELECT doc_id, score, review_status, email_status, is_new, has_connection, CASE WHEN review_status <> 'to_review' THEN review_status WHEN recommended THEN 'recommended' ELSE 'other' END AS section FROM r""")
def dashboard_star(spark, sf_dir):
    return _review_rows(spark, sf_dir).select("doc_id", "score", "review_status", "email_status", "is_new", "has_connection", "section")


@register(f"{_STAR} SELECT doc_id FROM r WHERE review_status = 'to_review' AND has_connection AND email_status = 'ready'")
def dashboard_filter(spark, sf_dir):
    asked = review.parsed_filters({"review_status": ["to_review"], "connection": ["connected"], "email_status": ["ready"], "company": ["any"]})
    return review.filtered_view(_review_rows(spark, sf_dir), asked).select("doc_id")


@register(f"""{_STAR} SELECT count(*) AS total, count(*) AS included, 0::BIGINT AS excluded, count(*) FILTER (has_connection) AS connected, count(*) FILTER (email_status = 'ready') AS email_ready,
 count(*) FILTER (email_status = 'emailed') AS emailed, count(*) FILTER (is_new) AS new_postings, count(*) FILTER (review_status = 'to_review') AS to_review FROM r""")
def conditional_summary(spark, sf_dir):
    return review.summary(_review_rows(spark, sf_dir))


_TYPES = {"click": "scoring", "error": "collection", "purchase": "email", "signup": "posting_note_updated", "view": "anything"}
_ACTION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _TYPES.items()) + " END"


def _activity(spark, sf_dir) -> DataFrame:
    rows = table(spark, sf_dir, "events").selectExpr(
        "event_id ord", "cast(ts as string) timestamp", "date_format(ts, 'yyyy-MM-dd') date", f"{_ACTION} action", "cast(user_id as string) subject",
        "case when event_id % 3 = 0 then concat('{\"provider\":\"gemini\",\"total_tokens\":', get_json_object(props, '$.k'), '}') else props end details",
        "case when event_id % 10 = 0 then true end api_invoked", "cast(null as string) cost",
    )
    return review.activity(rows, None)


@register(f"""SELECT event_id AS ord, CASE event_type WHEN 'click' THEN 'scoring' WHEN 'error' THEN 'collection' WHEN 'purchase' THEN 'email' WHEN 'signup' THEN 'note edit' ELSE 'other' END AS activity_type,
 event_id % 10 = 0 OR (event_type = 'click' AND event_id % 3 = 0) AS api_invoked,
 CASE WHEN (event_id % 10 = 0 OR event_type = 'click') AND event_id % 3 = 0 THEN concat('Gemini API free tier (', props->>'$.k', ' tokens)') ELSE 'unavailable' END AS basis FROM events""")
def activity_log_enrich(spark, sf_dir):
    basis = F.coalesce(F.get_json_object("cost", "$.basis"), F.get_json_object("cost", "$.status"))
    return _activity(spark, sf_dir).select("ord", "activity_type", "api_invoked", basis.alias("basis"))


@register("SELECT event_id AS ord FROM events WHERE event_type = 'error' AND ts::DATE BETWEEN '2024-01-03' AND '2024-01-09'")
def activity_range_filter(spark, sf_dir):
    return review.activity_between(_activity(spark, sf_dir), "collection", "2024-01-03", "2024-01-09").select("ord")


@register("""SELECT l_orderkey, CASE WHEN bool_or(l_returnflag = 'R') THEN 'failed' WHEN bool_or(l_linestatus = 'O') THEN 'partial' ELSE 'success' END AS status, count(*) AS steps FROM lineitem GROUP BY 1""")
def status_rollup(spark, sf_dir):
    steps = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey", "case when l_returnflag = 'R' then 'failed' when l_linestatus = 'O' then 'warning' else 'ok' end status")
    return rollup.run_status(steps, "l_orderkey")


@register("SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'except', k FROM (SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)")
def union_distinct_sets(spark, sf_dir):
    one = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"))
    two = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))
    whole = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"))
    sets = {"union": one.union(two).distinct(), "except": whole.exceptAll(two.distinct()).distinct(), "intersect": one.intersect(two)}
    parts = [df.select(F.lit(op).alias("op"), "k") for op, df in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("""SELECT page_id, i::INTEGER AS ord, m[1] AS href, m[2] AS text FROM (SELECT page_id, unnest(range(len(a))) AS i, unnest(list_transform(a, lambda x: [regexp_extract(x, 'href="([^"]*)"', 1), regexp_extract(x, '>(.*)<', 1)])) AS m
 FROM (SELECT page_id, regexp_extract_all(html, '<a href="[^"]*">[^<]*</a>') AS a FROM pages))""")
def html_links(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.posexplode(crawl.page_links("html")).alias("ord", "link"))
    return rows.select("page_id", "ord", "link.href", "link.text")


@register("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS plain FROM pages")
def html_plain_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.strip_tags(F.col("html")).alias("plain"))


@register(None)
def html_semantic_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", crawl.semantic_text(F.col("html")).alias("plain"))


@register("SELECT page_id, trim(regexp_replace(regexp_extract(html, '<h1>(.*?)</h1>', 1), '\\s+', ' ', 'g')) AS title FROM pages")
def h1_title_extract(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", text.clean_text(F.regexp_extract("html", "(?s)<h1>(.*?)</h1>", 1)).alias("title"))


@register(None)
def crawl_frontier(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("url page_url", "url root_url", "html")
    return crawl.frontier(rows)


@register(f"{O.WITH} SELECT CASE WHEN contains(posting_url, 'linkedin.com/jobs/view/') THEN 'linkedin' WHEN contains(posting_url, 'indeed.com') THEN 'indeed' WHEN contains(posting_url, 'greenhouse.io') THEN 'greenhouse' ELSE 'other' END AS platform, count(*) AS n FROM postings GROUP BY 1")
def platform_counts(spark, sf_dir):
    return search.platform_counts(postings(spark, sf_dir))


@register(f"""{O.WITH}, p AS (SELECT *, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t FROM postings) SELECT ord, CASE WHEN contains(t, ' at Acme') THEN split_part(t, ' at ', 1) WHEN contains(t, ' at ') THEN 'Life' ELSE t END AS role,
 CASE WHEN contains(t, ' at ') THEN split_part(t, ' at ', 2) WHEN contains(posting_url, 'greenhouse') THEN 'Acme Labs' ELSE '' END AS company FROM p""")
def board_title_parse(spark, sf_dir):
    found = metadata.board_title(F.col("title"), F.col("posting_url"))
    return postings(spark, sf_dir).select("ord", found["title"].alias("role"), found["company"].alias("company"))


@register(None)
def sentence_summary(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.summary_text(F.array("text"), "Nothing to say.").alias("summary"))


@register("SELECT user_id, date_trunc('week', ts)::TIMESTAMP AS week, min(event_id) AS event_id FROM events GROUP BY 1, 2")
def week_guard(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "ts", "event_id")
    return rollup.once_a_week(rows, "ts", "user_id").select("user_id", "week", "event_id")


@register("SELECT sum(l_orderkey)::BIGINT AS prompt_tokens, sum(l_partkey)::BIGINT AS output_tokens, sum(l_orderkey + l_partkey)::BIGINT AS total_tokens FROM lineitem")
def token_usage_sum(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey prompt_tokens", "l_partkey output_tokens", "l_orderkey + l_partkey total_tokens")
    return scoring.usage_totals(rows)


@register(f"""{O.WITH} SELECT ord, concat_ws(chr(10), concat('Role: ', title), concat('Company: ', company), concat('Location: ', location), concat('Work Arrangement: ', CASE WHEN location = 'Unknown' THEN 'Unknown'
 WHEN contains(lower(location), 'remote') THEN 'Remote' ELSE 'Unknown' END), concat('Program or Team: ', CASE WHEN contains(title, 'Software Engineer') THEN 'Software Engineer' WHEN contains(title, 'Operations') THEN 'Operations' WHEN contains(title, 'Analyst') THEN 'Analyst'
 WHEN contains(title, 'MBA') THEN 'Mba' WHEN contains(title, 'Graduate') THEN 'Graduate' ELSE 'Unknown' END), concat('Timing: ', CASE WHEN contains(title, '2027') THEN '2027' WHEN contains(title, '2026') THEN '2026' ELSE 'Unknown' END),
 'Responsibilities: Unknown (posting body not stored)', 'Qualifications: Unknown (posting body not stored)', 'Application Deadline: Unknown') AS summary FROM postings""")
def factual_summary(spark, sf_dir):
    rows = postings(spark, sf_dir)
    return rows.select("ord", text.factual_summary(F.col("title"), F.col("company"), F.col("location"), F.lit("")).alias("summary"))


@register("SELECT source AS company, count(*) AS n FROM documents GROUP BY 1")
def company_counts(spark, sf_dir):
    return rollup.by_company(table(spark, sf_dir, "documents").withColumnRenamed("source", "company"))


@register("SELECT lower(p_name) AS q, min(p_partkey) AS first FROM part GROUP BY 1")
def ordered_distinct(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.lower("p_name").alias("q"), F.col("p_partkey").alias("ord"))
    return dedupe.first_of_each(rows, "q").select("q", F.col("ord").alias("first"))


@register("""WITH r AS (SELECT page_id AS ord, regexp_extract(url, '://([^/]*)', 1) AS site, split_part(replace(regexp_extract(url, '://([^/]*)', 1), 'www.', ''), '.', 1) AS name FROM pages)
SELECT name, arg_min(ord, ord) AS ord FROM r GROUP BY name""")
def discovery_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id ord", "url")
    columns = ["website", "reason", "source", "origin", "review_status", "evidence_title", "evidence_url", "evidence_snippet"]
    found = rows.select("ord", metadata.company_of_result(F.lit("page"), F.col("url")).alias("raw"), "url", F.lit(True).alias("should_add_to_source_registry"))
    found = found.select(
        "ord", urls.domain_key(F.col("url")).alias("name"), F.col("url").alias("careers_url"), F.array(F.lit("x")).alias("industry_tags"),
        "should_add_to_source_registry", *(F.col("ord").cast("string").alias(c) for c in columns),
    )
    merged = discovery.merged_suggestions(found.limit(0), found)
    return merged.select("name", F.col("website").cast("long").alias("ord"))


@register(f"""WITH sources AS ({SOURCES}) SELECT count(*) AS sources, count(*) FILTER (ord % 2 = 0) AS seeds, count(*) FILTER (has_connection) AS connected FROM sources""")
def registry_totals(spark, sf_dir):
    rows = sources(spark, sf_dir).withColumn("origin", F.when(F.col("ord") % 2 == 0, "seed").otherwise("discovered"))
    return discovery.registry_totals(rows)


def _payloads(spark, sf_dir, record: str, wrap: str) -> DataFrame:
    """One stored page per customer: the postings of its orders as a service would send them."""
    rows = postings(spark, sf_dir).join(table(spark, sf_dir, "orders").selectExpr("o_orderkey ord", "o_custkey"), "ord")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("ord", F.expr(record).alias("r")))), lambda x: x["r"])
    pages = rows.groupBy("o_custkey").agg(F.first("company").alias("company"), listed.alias("records"))
    return pages.select(F.lit(0).alias("page"), "company", F.concat(F.lit("https://c.example.com/"), "o_custkey").alias("careers_url"), F.to_json(F.expr(wrap)).alias("payload"))


_FEED = r"""{head}, f AS (SELECT c.*, concat('https://c.example.com/', o.o_custkey) AS src, {url} AS link, trim(regexp_replace(title, '\s+', ' ', 'g')) AS tt FROM classified c JOIN orders o ON o.o_orderkey = c.ord WHERE {keep}),
 one AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY src, link ORDER BY ord) = 1) SELECT tt AS title, company, location, link AS posting_url, src AS source_url FROM one WHERE is_specific"""


@register(_FEED.format(head=f"{O.WITH}, {O.CLASSIFIED}", url="posting_url", keep="state <> 'P'"))
def connector_listed_jobs(spark, sf_dir):
    record = "struct(title, posting_url AS jobUrl, location, state <> 'P' AS isListed)"
    pages = _payloads(spark, sf_dir, record, "struct(records AS jobs)")
    return feeds.read_feed("ashby_api", pages, "2026-07-01").select("title", "company", "location", "posting_url", "source_url")


@register(_FEED.format(head=f"{O.WITH}, {O.CLASSIFIED}", url="posting_url", keep="true"))
def connector_office_locations(spark, sf_dir):
    record = "struct(title, posting_url AS absolute_url, struct('elsewhere' AS name) AS location, array(struct('x' AS name, location AS location)) AS offices)"
    pages = _payloads(spark, sf_dir, record, "struct(records AS jobs)")
    return feeds.read_feed("greenhouse_api", pages, "2026-07-01").select("title", "company", "location", "posting_url", "source_url")


@register("""SELECT page_id, CASE WHEN contains(site, 'example.net') THEN 'json_ld,embedded_json,semantic_detail,generic_links' WHEN contains(site, 'example.org') THEN 'lever_api,embedded_json,generic_links'
 ELSE 'greenhouse_api,json_ld,embedded_json,generic_links' END AS tried FROM (SELECT page_id, regexp_extract(url, '://([^/]*)', 1) AS site FROM pages)""")
def connector_routing(spark, sf_dir):
    rows = table(spark, sf_dir, "pages")
    url = F.replace(F.replace("url", F.lit("example.org"), F.lit("lever.co")), F.lit("example.com"), F.lit("greenhouse.io"))
    return rows.select("page_id", F.array_join(feeds.strategies(F.lit("Acme"), url, F.lit("company_careers"), F.lit("auto")), ",").alias("tried"))


@register("""SELECT page_id, i::INTEGER AS ord, concat(regexp_extract(url, '^[a-z]+://[^/?#]*', 0), m) AS target FROM (SELECT page_id, url, unnest(range(len(a))) AS i, unnest(a) AS m
 FROM (SELECT page_id, url, regexp_extract_all(html, '<a href="([^"]*)">', 1) AS a FROM pages)) WHERE starts_with(m, '/')""")
def link_resolution(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", "url", F.posexplode(crawl.page_links("html")).alias("ord", "link"))
    return rows.where(F.col("link.href").startswith("/")).select("page_id", "ord", crawl.resolved("url", "link.href").alias("target"))


@register(f"{O.WITH} SELECT ord, CASE WHEN trim(location) = '' THEN 'Unknown' ELSE array_to_string(list_transform(string_split(location, '|'), lambda p: trim(p)), ' | ') END AS places FROM postings")
def location_lists(spark, sf_dir):
    return postings(spark, sf_dir).select("ord", text.location_list(F.col("location")).alias("places"))


@register(f"""{O.WITH} SELECT ord, CASE location WHEN 'Flexible' THEN CASE WHEN contains(lower(eligibility_text), 'new york') THEN 'New York | …' ELSE location END WHEN 'New York | Berlin' THEN 'New York | …' ELSE location END AS shown FROM postings""")
def allowed_location_summary(spark, sf_dir):
    return postings(spark, sf_dir).select("ord", places.allowed_summary(F.col("location"), F.col("eligibility_text"), MARKERS).alias("shown"))


@register("SELECT n_nationkey AS id, CASE n_regionkey WHEN 0 THEN 'to_review' WHEN 1 THEN 'not_interested' WHEN 2 THEN 'applied' ELSE 'to_review' END AS status FROM nation")
def review_status_map(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, ["Interested", " ignored", "APPLIED", "", "needs_follow_up"])), F.col("n_regionkey") + 1)
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"), text.review_status(raw).alias("status"))


FLAGSHIP = "email_selection"
__all__ = ["FLAGSHIP", "ORACLE_SQL", "POSTINGS", "QUERIES"]


from . import field_queries  # noqa: E402, F401
