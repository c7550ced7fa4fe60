"""Queries over single fields and small lookups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import listing, metadata, text, urls
from ..operators import dedupe, digest, discovery, monitor, review, snapshot
from . import oracle as O
from .fixtures import SOURCES, postings, sources, table
from .queries import register

#: Addresses of every form, which both engines make.
ADDRESS = """CASE page_id % 10 WHEN 0 THEN url WHEN 1 THEN concat('//duckduckgo.com/l/?uddg=https%3A%2F%2Fexample.com%2Fjob%2F', page_id)
 WHEN 2 THEN concat('HTTPS://Boards.Greenhouse.io/acme/jobs/', page_id, '#frag') WHEN 3 THEN concat('https://jobs.lever.co/acme/', page_id, '?x=1')
 WHEN 4 THEN concat('example.com/de-DE/jobs/', page_id) WHEN 5 THEN concat('https://careers.blackrock.com/search-jobs&p=', page_id)
 WHEN 6 THEN concat('  https://Example.com/fr/Jobs/', page_id, '/?q=1#x ') WHEN 7 THEN concat('https://www.goldmansachs.com/en-US/job/', page_id)
 WHEN 8 THEN concat('https://jobs.ashbyhq.com/acme/', page_id) ELSE concat('http://duckduckgo.com/about/', page_id, '#a') END"""
_SCHEME = "regexp_extract({}, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)"
_HOST = "regexp_extract({}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)"
_QUERY = "regexp_extract({}, '^[^?#]*\\?([^#]*)', 1)"
_PATH = O.URL_PATH
_FORMS = f"WITH f AS (SELECT page_id, {ADDRESS} AS a FROM pages), t AS (SELECT *, trim(a) AS u FROM f)"


def _locale(address: str) -> str:
    return f"lower(regexp_extract({_PATH.format(address)}, '(?i)^/*([a-z]{{2}}(?:-[a-z]{{2}})?)(?:/|$)', 1))"


def _addresses(spark, sf_dir):
    return table(spark, sf_dir, "pages").selectExpr("page_id", f"{ADDRESS} a")


def _or(parts: list[str]) -> str:
    return "(" + " OR ".join(parts) + ")"


@register(f"""{_FORMS} SELECT page_id, regexp_replace(concat(CASE WHEN {_SCHEME.format('u')} <> '' THEN concat(lower({_SCHEME.format('u')}), ':') ELSE '' END,
 CASE WHEN {_HOST.format('u')} <> '' THEN concat('//', lower({_HOST.format('u')})) ELSE '' END, {_PATH.format('u')}, CASE WHEN {_QUERY.format('u')} <> '' THEN concat('?', {_QUERY.format('u')}) ELSE '' END), '/+$', '') AS navigation FROM t""")
def navigation_url(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", urls.navigation(F.col("a")).alias("navigation"))


@register(f"""{_FORMS}, w AS (SELECT page_id, CASE WHEN starts_with(u, '//') THEN concat('https:', u) ELSE u END AS u FROM t),
 x AS (SELECT page_id, CASE WHEN ends_with({_HOST.format('u')}, 'duckduckgo.com') AND starts_with({_PATH.format('u')}, '/l/') THEN url_decode(regexp_extract(u, 'uddg=([^&#]*)', 1)) ELSE u END AS u FROM w)
SELECT page_id, CASE WHEN {_SCHEME.format('u')} = '' OR {_HOST.format('u')} = '' THEN '' ELSE regexp_replace(u, '#.*$', '') END AS target FROM x""")
def search_target_url(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", urls.search_target(F.col("a")).alias("target"))


@register(f"{_FORMS} SELECT page_id, CASE WHEN regexp_matches(u, '(?i)^https?://') THEN u ELSE concat('https://', u) END AS whole FROM t")
def scheme_added(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", urls.with_scheme(F.col("a")).alias("whole"))


@register(f"""{_FORMS}, b AS (SELECT *, '(?i)https?://(?:job-boards|boards)\\.greenhouse\\.io/([^/]+)/jobs/(\\d+)' AS g, '(?i)https?://jobs\\.lever\\.co/([^/]+)/([^/?#]+)' AS l FROM t)
SELECT page_id, CASE WHEN contains(lower(a), 'greenhouse.io') THEN 'greenhouse' ELSE 'lever' END AS platform,
 CASE WHEN contains(lower(a), 'greenhouse.io') THEN regexp_extract(a, '(?i)greenhouse\\.io/([^/]+)/jobs/', 1) ELSE regexp_extract(a, '(?i)lever\\.co/([^/]+)/', 1) END AS board,
 page_id::VARCHAR AS job FROM b WHERE contains(lower(a), 'greenhouse.io') OR contains(a, 'jobs.lever.co')""")
def board_and_job(spark, sf_dir):
    a = F.col("a")
    found = F.coalesce(urls.greenhouse_board(a), urls.lever_board(a))
    rows = _addresses(spark, sf_dir).select("page_id", urls.platform(a).alias("platform"), found.alias("b")).where("b is not null")
    return rows.select("page_id", "platform", "b.board", "b.job")


@register(f"""WITH f AS (SELECT page_id, CASE WHEN page_id % 4 = 0 THEN '' ELSE url END AS u, concat('  Data Intern, ', page_id % 7, ' (m/f) ') AS title FROM pages)
SELECT page_id, coalesce(nullif({O.canonical('u')}, ''), concat('brave:data-intern-', page_id % 7, '-m-f')) AS stable FROM f""")
def stable_result_id(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", "case when page_id % 4 = 0 then '' else url end u", "concat('  Data Intern, ', page_id % 7, ' (m/f) ') title")
    return rows.select("page_id", urls.stable_id(F.col("u"), F.col("title"), F.lit("brave")).alias("stable"))


@register(f"{_FORMS} SELECT page_id, {_locale('a')} <> '' AND {_locale('a')} <> 'en-us' AS other FROM t")
def other_locale(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", urls.is_other_locale(F.col("a"), F.lit("https://example.com/en-US/jobs")).alias("other"))


@register(f"""{_FORMS}, h AS (SELECT page_id, split_part(lower({_HOST.format('a')}), ':', 1) AS h FROM t)
SELECT page_id, {_or([f"h = '{d}' OR ends_with(h, '.{d}')" for d in L.TRUSTED_HOSTS])} AS trusted FROM h""")
def trusted_host(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", urls.is_trusted_host(urls.host(F.col("a"))).alias("trusted"))


@register(f"{_FORMS} SELECT page_id, CASE WHEN page_id % 10 = 5 THEN concat('https://careers.blackrock.com/search-jobs?p=', page_id) ELSE a END AS mended FROM t")
def repaired_paging(spark, sf_dir):
    return _addresses(spark, sf_dir).select("page_id", urls.repaired(F.col("a")).alias("mended"))


@register(f"""{_FORMS}, p AS (SELECT *, regexp_replace(lower({_PATH.format('a')}), '/+$', '') AS low, lower({_HOST.format('a')}) AS h FROM t),
 d AS (SELECT *, regexp_matches(low, '/(?:job|jobs)/(?:[^/]+/)*\\d+(?:/|$)') OR {O.any_in('low', ['/job/', '/jobdetails/', '/job-detail/'])}
 OR ({O.any_in('h', ['lever.co', 'ashbyhq.com'])} AND len(list_filter(string_split(low, '/'), lambda x: x <> '')) >= 2) AS detail FROM p)
SELECT page_id, detail, detail OR regexp_matches(lower({_PATH.format('a')}), '/jobs/(?:r[-_]\\d+|\\d+)(?:/|$)') AS direct, {O.any_in('lower(a)', L.CAREER_PATH_MARKERS)} AS careers,
 split_part(regexp_replace(regexp_replace(replace(h, 'www.', ''), '^careers\\.', ''), '^jobs\\.', ''), '.', 1) AS domain FROM d""")
def job_page_rules(spark, sf_dir):
    a = F.col("a")
    return _addresses(spark, sf_dir).select(
        "page_id", urls.is_job_detail(a).alias("detail"), urls.is_direct_source(a).alias("direct"), urls.looks_like_careers(a).alias("careers"), urls.domain_key(a).alias("domain")
    )


_LINKS = "WITH f AS (SELECT page_id, {0} AS href, CASE page_id % 6 WHEN 0 THEN ' Careers ' WHEN 1 THEN 'Summer Analyst' WHEN 2 THEN 'Privacy Notice' WHEN 3 THEN 'Read more' WHEN 4 THEN 'Job openings' ELSE '' END AS label FROM pages)"
_HREF = "CASE WHEN page_id % 7 = 0 THEN 'mailto:a@b.co' WHEN page_id % 7 = 1 THEN '' WHEN page_id % 7 = 2 THEN concat('/Blog-x/job/', page_id) WHEN page_id % 7 = 3 THEN concat(' /Job/', page_id) ELSE url END"


@register(f"""{_LINKS.format(_HREF)}, l AS (SELECT page_id, lower(trim(label)) AS n, lower(trim(href)) AS h FROM f)
SELECT page_id, NOT {_or([f"starts_with(h, '{p}')" for p in L.LINK_EXCLUDED_PREFIXES])} AND h <> '' AND n NOT IN ({', '.join(map(O.quoted, L.LINK_EXCLUDED_TITLES))})
 AND NOT {O.any_in('h', L.LINK_EXCLUDED_URLS)} AND ({O.any_in('n', L.LINK_TEXT_KEYWORDS)} OR {O.any_in('h', L.LINK_URL_KEYWORDS)}) AS likely FROM l""")
def likely_job_link(spark, sf_dir):
    label = "case page_id % 6 when 0 then ' Careers ' when 1 then 'Summer Analyst' when 2 then 'Privacy Notice' when 3 then 'Read more' when 4 then 'Job openings' else '' end label"
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{_HREF} href", label)
    return rows.select("page_id", listing.is_likely_job_link(F.col("label"), F.col("href")).alias("likely"))


@register(f"""{O.WITH} SELECT ord, {O.any_in(O.HOST.format('posting_url'), L.BOARD_DOMAINS)} OR {O.any_in("lower(concat_ws(' ', title, posting_url, eligibility_text))", L.BOARD_KEYWORDS)} AS board,
 {O.any_in(O.HOST.format('posting_url'), L.BLOCKED_DOMAINS)} OR {O.any_in("lower(concat_ws(' ', posting_url, title))", L.DISCOVERY_BLOCKED)} AS blocked FROM postings""")
def result_rules(spark, sf_dir):
    title, url = F.col("title"), F.col("posting_url")
    return postings(spark, sf_dir).select(
        "ord", metadata.is_board_result(title, url, F.col("eligibility_text")).alias("board"), discovery.is_blocked(url, title).alias("blocked")
    )


_PAIRS = {
    "t1": "CASE ord % 4 WHEN 0 THEN concat('Job Application for ', title, ' at Acme') WHEN 1 THEN '' WHEN 2 THEN concat(title, ' at Acme') ELSE title END",
    "t2": "CASE WHEN ord % 7 = 0 THEN '' ELSE title END",
    "c1": "CASE ord % 5 WHEN 0 THEN '' WHEN 1 THEN ' Unknown  Company' WHEN 2 THEN '...' ELSE company END",
    "c2": "CASE ord % 3 WHEN 0 THEN concat(company, ' Holdings') WHEN 1 THEN '' ELSE 'untitled posting' END",
    "p1": "CASE ord % 4 WHEN 0 THEN 'Unknown' WHEN 1 THEN '' ELSE location END",
    "p2": "CASE ord % 3 WHEN 0 THEN concat(location, ' | Paris') WHEN 1 THEN 'unknown' ELSE concat('Greater ', location) END",
    "e1": "CASE ord % 2 WHEN 0 THEN concat(eligibility_text, '     ') ELSE '' END", "e2": "CASE ord % 3 WHEN 0 THEN 'Bachelor' ELSE eligibility_text END",
}
_NORM = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"
_NO_FIRM = "(trim({0}) = '' OR " + _NORM + f" IN ({', '.join(map(O.quoted, L.MISSING_COMPANIES))}))"
_NO_PLACE = "(trim({0}) = '' OR " + _NORM + f" IN ({', '.join(map(O.quoted, L.MISSING_PLACES))}))"


@register(f"""{O.WITH}, p AS (SELECT ord, {', '.join(f'{e} AS {c}' for c, e in _PAIRS.items())} FROM postings)
SELECT ord, CASE WHEN t2 <> '' AND (t1 = '' OR regexp_matches(t1, '(?i)^job application for (.+) at (.+)$') OR starts_with(t1, 'Job Application for') OR (length(t2) < length(t1) AND contains(t1, ' at '))) THEN t2 ELSE t1 END AS title,
 CASE WHEN c2 <> '' AND ({_NO_FIRM.format('c1')} OR (NOT {_NO_FIRM.format('c2')} AND c1 <> c2 AND length(c2) > length(c1))) THEN c2 ELSE c1 END AS company,
 CASE WHEN ({_NO_PLACE.format('p1')} AND NOT {_NO_PLACE.format('p2')}) OR (contains(p2, '|') AND NOT contains(p1, '|') AND NOT {_NO_PLACE.format('p2')})
 OR (trim(p1) <> '' AND contains(lower(trim(p2)), lower(trim(p1))) AND length(trim(p2)) > length(trim(p1))) THEN p2 ELSE p1 END AS location,
 CASE WHEN length(trim(e2)) > length(trim(e1)) THEN e2 ELSE e1 END AS eligibility_text FROM p""")
def field_preferences(spark, sf_dir):
    rows = postings(spark, sf_dir).selectExpr("ord", *(f"{e} {c}" for c, e in _PAIRS.items()))
    c = F.col
    return rows.select(
        "ord", metadata.better_title(c("t1"), c("t2")).alias("title"), metadata.better_company(c("c1"), c("c2")).alias("company"),
        metadata.better_place(c("p1"), c("p2")).alias("location"), metadata.richer_text(c("e1"), c("e2")).alias("eligibility_text"),
    )


_SNIPPET = """CASE ord % 6 WHEN 0 THEN concat('Location:  ', location, '. Apply') WHEN 1 THEN 'We work in New York, NY and more' WHEN 2 THEN 'Boston, MA | Remote' WHEN 3 THEN 'Join us, hybrid role'
 WHEN 4 THEN 'office: Summer | x' ELSE 'nothing here' END"""
_FOUND = [f"trim(regexp_replace(regexp_extract(s, {O.quoted('(?i)' + p)}, 1), '\\s+', ' ', 'g'))" for p in L.SNIPPET_PLACE_PATTERNS]


@register(f"""{O.WITH}, s AS (SELECT ord, trim(regexp_replace({_SNIPPET}, '\\s+', ' ', 'g')) AS s FROM postings)
SELECT ord, coalesce(list_filter([{', '.join(_FOUND)}], lambda x: x <> '' AND lower(x) NOT IN ({', '.join(map(O.quoted, L.NOT_PLACES))}))[1], '') AS place FROM s""")
def snippet_place(spark, sf_dir):
    return postings(spark, sf_dir).selectExpr("ord", f"{_SNIPPET} s").select("ord", metadata.place_of_snippet(F.col("s")).alias("place"))


_RESULT = """CASE page_id % 6 WHEN 0 THEN concat('Analyst at Firm ', page_id % 5) WHEN 1 THEN 'Acme Careers and more' WHEN 2 THEN ' Beta -  Internships 2027' WHEN 3 THEN 'Gamma | LinkedIn'
 WHEN 4 THEN 'Delta Jobs' ELSE 'Welcome' END"""
_TIDY = "trim(regexp_replace({0}, '\\s+', ' ', 'g'), ' -|:')"


@register(f"""WITH f AS (SELECT page_id, {ADDRESS} AS a, {_RESULT} AS t FROM pages), k AS (SELECT *, lower(t) AS low,
 split_part(regexp_replace(regexp_replace(replace(lower({_HOST.format('a')}), 'www.', ''), '^careers\\.', ''), '^jobs\\.', ''), '.', 1) AS key FROM f)
SELECT page_id, CASE WHEN contains(low, ' at ') THEN {_TIDY.format("regexp_replace(t, '^.* at ', '')")} {' '.join(f"WHEN contains(low, '{w}') THEN " + _TIDY.format(f"substr(t, 1, instr(low, '{w}') - 1)") for w in (' careers', ' internships', ' jobs', ' | linkedin'))}
 ELSE CASE key {' '.join(f"WHEN '{k}' THEN {O.quoted(v)}" for k, v in L.DOMAIN_COMPANIES.items())} ELSE {_TIDY.format("replace(key, '-', ' ')")} END END AS company FROM k""")
def company_of_result(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").selectExpr("page_id", f"{ADDRESS} a", f"{_RESULT} t")
    return rows.select("page_id", metadata.company_of_result(F.col("t"), F.col("a")).alias("company"))


_TITLED = "array_to_string(list_transform(string_split({0}, ' '), lambda w: concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ')"
_DATES = "CASE ord % 5 WHEN 0 THEN 'Apply by: march 5th' WHEN 1 THEN concat('Deadline  0', ord % 9, '/12/2027 ok') WHEN 2 THEN 'June 30 deadline' WHEN 3 THEN 'no date' ELSE 'due 7/4 and before May 1' END"


def _deadline(column: str) -> str:
    one, two = (f"regexp_extract(lower({column}), {O.quoted(p)}, 1)" for p in L.DEADLINE_PATTERNS)
    return f"CASE WHEN {one} <> '' THEN {_TITLED.format(f'trim({one})')} WHEN {two} <> '' THEN {_TITLED.format(f'trim({two})')} END"


@register(f"{O.WITH}, d AS (SELECT ord, {_DATES} AS d FROM postings) SELECT ord, {_deadline('d')} AS deadline FROM d")
def application_deadline(spark, sf_dir):
    return postings(spark, sf_dir).selectExpr("ord", f"{_DATES} d").select("ord", text.deadline(F.col("d")).alias("deadline"))


_NOTE = "CASE ord % 4 WHEN 0 THEN '' WHEN 1 THEN concat('Seen at ', company, '. More') ELSE 'Old note.' END"
_TERM = "CASE ord % 4 WHEN 0 THEN 'Finanacial  Services' WHEN 1 THEN 'Arospace-Defence' WHEN 2 THEN 'Aropace and defence' ELSE title END"
_MEND = "replace(replace(replace(lower(q), 'finanacial', 'financial'), 'arospace', 'aerospace'), 'defence', 'defense')"
_MEND2 = "replace(replace(replace(replace(lower(q), 'finanacial', 'financial'), 'aropace', 'aerospace'), 'defence', 'defense defence'), '-', ' ')"


@register(f"""{O.WITH}, n AS (SELECT ord, company, {_NOTE} AS note, concat('Seen at ', company, '.') AS more, {_TERM} AS q, CASE ord % 3 WHEN 0 THEN 'AI scoring unavailable: quota' ELSE 'fine' END AS x FROM postings)
SELECT ord, company AS firm, CASE WHEN note = '' THEN more WHEN contains(note, more) THEN note ELSE concat(note, ' ', more) END AS note, {_MEND} AS term,
 array_to_string(list_filter(string_split(trim(regexp_replace({_MEND2}, '\\s+', ' ', 'g')), ' '), lambda w: length(w) > 3), ' ') AS terms, {O.any_in('lower(x)', L.DIAGNOSTIC_MARKERS)} AS diagnostic FROM n""")
def note_and_query_text(spark, sf_dir):
    rows = postings(spark, sf_dir).selectExpr("ord", "company", f"{_NOTE} note", "concat('Seen at ', company, '.') more", f"{_TERM} q", "case ord % 3 when 0 then 'AI scoring unavailable: quota' else 'fine' end x")
    asked = F.concat(F.col("company"), F.lit(" Summer 2027 internship  careers "))
    return rows.select(
        "ord", text.company_of_query(asked).alias("firm"), text.appended_note(F.col("note"), F.col("more")).alias("note"), text.query_term(F.col("q")).alias("term"),
        F.array_join(text.interest_terms(F.col("q")), " ").alias("terms"), text.is_diagnostic(F.col("x")).alias("diagnostic"),
    )


@register("""WITH c AS (SELECT n_nationkey::BIGINT AS n, (n_nationkey % 4)::BIGINT AS e FROM nation)
SELECT n, concat('Weekly internship summary: ', n, CASE WHEN n = 1 THEN ' match' ELSE ' matches' END, CASE WHEN e = 0 THEN '' WHEN e = 1 THEN ' (1 source issue)' ELSE concat(' (', e, ' source issues)') END) AS subject FROM c""")
def digest_subject(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) n", "cast(n_nationkey % 4 as bigint) e")
    return rows.select("n", digest.subject(F.col("n"), F.col("e")).alias("subject"))


@register(f"{O.WITH} SELECT coalesce(max(nullif(date_collected, '')), '') AS date_checked FROM postings WHERE state = 'O'")
def latest_collection(spark, sf_dir):
    return monitor.latest_date(postings(spark, sf_dir).where("state = 'O'"))


@register(f"{O.WITH} SELECT count(*) AS n FROM postings WHERE posting_url IN (SELECT posting_url FROM postings WHERE state = 'P')")
def new_postings(spark, sf_dir):
    rows = postings(spark, sf_dir)
    return digest.new_count(rows, rows.where("state = 'P'"))


@register("SELECT l_orderkey AS title, l_partkey AS company, l_linenumber * 10 + l_partkey % 7 AS score FROM lineitem ORDER BY score DESC, company, title LIMIT 1")
def best_first(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey title", "l_partkey company", "l_linenumber * 10 + l_partkey % 7 score")
    return digest.best_first(rows)


@register(f"{O.WITH} SELECT posting_url FROM postings WHERE state = 'P' UNION SELECT posting_url FROM postings WHERE state = 'F'")
def sent_history(spark, sf_dir):
    rows = postings(spark, sf_dir)
    return digest.sent_union(rows.where("state = 'P'"), rows.where("state = 'F'"))


@register(f"""{O.WITH}, sources AS ({SOURCES}), own AS (SELECT DISTINCT concat('COMPANY  ', c_custkey % 70) AS name FROM customer), o AS (SELECT name, {_NORM.format('name')} AS k FROM own),
 last AS (SELECT company, arg_max(careers_url, ord) AS careers_url FROM sources GROUP BY 1),
 found AS (SELECT {_NORM.format('company')} AS k, count(*) AS n FROM postings GROUP BY 1), e AS (SELECT concat('company ', user_id % 45) AS k, arg_max(concat('error ', event_id), event_id) AS m FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT o.name, coalesce(last.careers_url, 'https://site') AS careers_url, coalesce(found.n, 0) AS internships_found, coalesce(e.m, '') AS source_issue
FROM o LEFT JOIN last ON last.company = o.name LEFT JOIN found USING (k) LEFT JOIN e USING (k)""")
def company_overview(spark, sf_dir):
    own = table(spark, sf_dir, "customer").selectExpr("concat('COMPANY  ', c_custkey % 70) name", "'https://site' website", "false has_connection", "'' connection_name").distinct()
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").selectExpr("concat('Company ', user_id % 45) company", "concat('error ', event_id) message", "event_id ord")
    rows = review.company_overview(own, sources(spark, sf_dir), postings(spark, sf_dir), errors)
    return rows.select("name", "careers_url", "internships_found", "source_issue")


@register("""WITH s AS (SELECT DISTINCT concat('  Firm ', p_partkey % 90) AS name FROM part), k AS (SELECT name, trim(lower(name)) AS k FROM s)
SELECT name FROM k WHERE k NOT IN (SELECT concat('firm ', s_suppkey) FROM supplier WHERE s_suppkey < 20) AND k NOT IN (SELECT concat('firm ', c_custkey) FROM customer WHERE c_custkey BETWEEN 40 AND 50)""")
def open_suggestions(spark, sf_dir):
    found = table(spark, sf_dir, "part").selectExpr("concat('  Firm ', p_partkey % 90) name").distinct()
    own = table(spark, sf_dir, "supplier").where("s_suppkey < 20").selectExpr("concat('FIRM ', s_suppkey) name")
    gone = table(spark, sf_dir, "customer").where("c_custkey between 40 and 50").selectExpr("concat('Firm  ', c_custkey, ' ') name")
    return review.open_suggestions(found, own, gone)


@register("""WITH c AS (SELECT concat('Firm ', s_suppkey) AS company, s_suppkey AS k FROM supplier), d AS (SELECT concat('firm ', c_custkey) AS k, concat('https://seed/', c_custkey) AS u FROM customer WHERE c_custkey % 3 = 0)
SELECT company, coalesce(d.u, 'https://site') AS careers_url, CASE WHEN d.u IS NULL THEN 'company_careers' ELSE 'greenhouse' END AS source_type, CASE WHEN d.u IS NULL THEN '' ELSE 'seeded' END AS notes, c.k % 2 = 0 AS has_connection
FROM c LEFT JOIN d ON lower(c.company) = d.k""")
def seeded_sources(spark, sf_dir):
    own = table(spark, sf_dir, "supplier").selectExpr("concat('Firm ', s_suppkey) name", "'https://site' website", "s_suppkey % 2 = 0 has_connection")
    seeds = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").selectExpr("concat('FIRM  ', c_custkey) company", "concat('https://seed/', c_custkey) careers_url", "'greenhouse' source_type", "'seeded' notes")
    return discovery.seeded(own, seeds).select("company", "careers_url", "source_type", "notes", "has_connection")


@register("""SELECT * FROM (VALUES (0, 'financial services companies summer 2027 internship careers'), (1, 'aerospace companies summer 2027 internship careers'),
 (1000, 'companies similar to Acme summer internship careers'), (2000, 'quant internship companies careers')) v(ord, query)""")
def discovery_queries(spark, sf_dir):
    return discovery.queries(spark, ["Finanacial Services", "Arospace", "financial services"], ["Acme", "Test", "ACME"], ["Quant", "quant "], 4)


@register(f"{O.WITH}, {O.KEYED} SELECT ord, CASE WHEN ord % 3 = 0 THEN 'kept' ELSE role_key END AS role_key FROM keyed")
def role_key_backfill(spark, sf_dir):
    old = postings(spark, sf_dir).withColumn("role_key", F.expr("case ord % 3 when 0 then 'kept' when 1 then '' end"))
    return snapshot.with_role_keys(old).select("ord", "role_key")


@register(f"{O.WITH} SELECT DISTINCT posting_url FROM postings WHERE state <> 'O'")
def inactive_addresses(spark, sf_dir):
    return snapshot.inactive_urls(postings(spark, sf_dir).withColumn("active", F.col("state") == "O"))


@register("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1")
def change_status_counts(spark, sf_dir):
    return snapshot.status_counts(table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status")))


@register(f"""{O.WITH}, {O.KEYED}, m AS (SELECT posting_id, count(DISTINCT (title, company, location, eligibility_text)) AS n, min(ord) AS ord FROM keyed GROUP BY 1) SELECT posting_id, ord FROM m""")
def merged_postings(spark, sf_dir):
    rows = dedupe.merged_by(postings(spark, sf_dir), urls.posting_id(F.col("posting_url")))
    return rows.select(urls.posting_id(F.col("posting_url")).alias("posting_id"), "ord")
