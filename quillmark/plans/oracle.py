"""The rules again as SQL for DuckDB, written apart from the operators."""

from __future__ import annotations

from ..functions import lexicon as L
from .fixtures import DISLIKES, INDUSTRIES, LIKES, MARKERS, POSTINGS, SOURCES

TIDY = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def any_in(text: str, words: list[str]) -> str:
    return "(" + (" OR ".join(f"contains({text}, {quoted(w)})" for w in words) or "false") + ")"


def matches(text: str, patterns: list[str]) -> str:
    return f"regexp_matches({text}, {quoted('|'.join(f'(?:{p})' for p in patterns))}, 'i')"


def first_in(text: str, words: list[str], guard: str = "") -> str:
    whens = " ".join(f"WHEN contains({text}, {quoted(w)}){guard if w == 'search intern' else ''} THEN {quoted(w)}" for w in words)
    return f"CASE {whens} END"


URL_PATH = r"regexp_extract({}, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1)"
HOST = r"lower(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"


def job_url(u: str) -> str:
    way = f"rtrim({URL_PATH.format(u)}, '/')"
    slashes = f"(length({way}) - length(replace({way}, '/', '')))"
    return f"""CASE WHEN {any_in(u, [*L.BLOG_URL_FRAGMENTS, "linkedin.com/jobs/search", "indeed.com/jobs?", "indeed.com/q-"])} THEN false
 WHEN ends_with({way}, '/jobs') AND regexp_matches({u}, '[?&](id|jobid)=[0-9]+(&|#|$)') THEN true
 WHEN NOT {any_in(u, L.SPECIFIC_URL_FRAGMENTS)} THEN false
 WHEN contains({u}, '/job/') AND {slashes} >= 3 THEN true WHEN contains({u}, '/job-detail/') AND {slashes} >= 4 THEN true
 WHEN contains({u}, '/jobdetail/') AND {slashes} >= 2 THEN true WHEN contains({u}, '/jobs/') AND ends_with({way}, '/jobs') THEN false
 WHEN contains({u}, 'linkedin.com/jobs/view/') OR contains({u}, 'indeed.com/viewjob') THEN true
 WHEN contains({u}, '/jobs/') AND {slashes} >= 2 THEN true
 WHEN {any_in(u, ["jobid=", "requisition", "reqid=", "gh_jid=", "careersection"])} THEN true
 WHEN contains({u}, '/careers/details/') AND {slashes} >= 3 THEN true
 ELSE contains({u}, '/opening/') OR contains({u}, '/position/') END"""


def role_title(t: str) -> str:
    words = f"len(string_split({t}, ' '))"
    role = matches(t, [rf"\b{r}\b" for r in L.ROLE_TITLE_TERMS])
    return f"""CASE WHEN regexp_matches({t}, '\\bstudents?\\b') THEN {role} WHEN regexp_matches({t}, '\\b20(26|27)\\b') THEN true
 WHEN regexp_matches({t}, '\\bsummer\\b') AND regexp_matches({t}, '\\bintern') THEN {words} >= 3
 ELSE regexp_matches({t}, '\\bsummer associate\\b') OR regexp_matches({t}, '\\bassociate consultant internship?\\b')
  OR (regexp_matches({t}, '\\binternship\\b') AND {words} >= 2) OR (regexp_matches({t}, '\\bintern') AND {role}) END"""


CLASSIFIED = f"""
 base AS (SELECT *, {TIDY.format('lower(title)')} AS t, lower(trim(posting_url)) AS u FROM postings),
 parts AS (SELECT *, {job_url('u')} AS job, {role_title('t')} AS role,
  {first_in('t', L.GENERIC_TITLE_FRAGMENTS, " AND (starts_with(t, 'search intern') OR starts_with(t, 'search for intern'))")} AS frag,
  {first_in('u', L.GENERIC_URL_FRAGMENTS)} AS place, regexp_matches(rtrim({URL_PATH.format('u')}, '/'), '/internships?-programs/[^/]+$') AS program FROM base),
 general AS (SELECT *, CASE WHEN t IN ({', '.join(map(quoted, L.GENERIC_EXACT_TITLES))}) THEN concat('Title matches a generic careers page: ''', t, '''.')
  WHEN frag IS NOT NULL THEN concat('Title looks like a program navigation page (''', frag, ''').')
  WHEN place IS NOT NULL AND NOT job AND NOT (program AND role) THEN concat('URL looks like a general careers page (''', place, ''').')
  WHEN regexp_full_match(t, '(search )?internships?') THEN 'Title is a generic internships search label.'
  WHEN len(string_split(t, ' ')) >= {L.LONG_TITLE_WORDS} AND NOT job THEN 'Title looks like page copy rather than a job posting title.' END AS why FROM parts),
 verdicts AS (SELECT *, CASE WHEN {any_in('u', L.BLOG_URL_FRAGMENTS)} OR {any_in('t', L.STORY_MARKERS)} THEN 'blog_or_story'
  WHEN NOT ({matches("concat(t, ' ', u)", L.INTERNSHIP_PATTERNS)} OR regexp_matches(t, '\\bstudents?\\b')) THEN 'not_internship'
  WHEN why IS NOT NULL AND {any_in("concat(t, ' ', u)", L.SEARCH_MARKERS)} THEN 'generic_search_page' WHEN why IS NOT NULL THEN 'generic_program_page'
  WHEN job OR role THEN 'specific_listing' ELSE 'generic_program_page' END AS category FROM general),
 classified AS (SELECT *, category = 'specific_listing' AS is_specific, CASE category WHEN 'blog_or_story' THEN 'URL or title looks like a blog or employee story page.'
  WHEN 'not_internship' THEN 'Does not mention internship-related terms.' ELSE CASE WHEN why IS NOT NULL THEN why
  WHEN job THEN 'URL points to a specific job posting path.' WHEN NOT role THEN 'Mentions internships but lacks a specific role title or job posting URL.'
  WHEN contains(t, '2027') OR contains(t, '2026') THEN 'Title includes a target internship year.'
  WHEN contains(t, 'summer') AND contains(t, 'intern') THEN 'Title includes a summer internship role.' ELSE 'Title includes a specific internship role.' END END AS reason FROM verdicts)"""


def text_allowed(x: str) -> str:
    return f"""CASE WHEN {x} = '' OR (contains({x}, 'costa rica') AND contains({x}, 'san jose')) THEN false
 WHEN {any_in(x, L.REMOTE_MARKERS)} AND NOT regexp_matches({x}, '[()]') THEN true ELSE {any_in(x, MARKERS)} END"""


def join_texts(*cells: str) -> str:
    return f"lower(array_to_string(list_filter([{', '.join(f'trim({c})' for c in cells)}], lambda p: p <> ''), ' '))"


ALLOWED = f"""CASE WHEN lower(trim(location)) IN ('', 'unknown') THEN {text_allowed(join_texts('title', 'eligibility_text'))}
 WHEN {any_in('lower(location)', L.FLEXIBLE_MARKERS)} THEN {any_in(join_texts('location', 'title', 'eligibility_text'), MARKERS)}
  OR {text_allowed(join_texts('location', 'title'))} ELSE {text_allowed('lower(trim(location))')} END"""
GRADUATE = f"""CASE WHEN {matches("concat(title, ' ', eligibility_text)", L.STRICT_GRADUATE_PATTERNS)} THEN true
 WHEN {matches("concat(title, ' ', eligibility_text)", L.UNDERGRADUATE_PATTERNS)} THEN false
 ELSE {matches("concat(title, ' ', eligibility_text)", L.GRADUATE_PATTERNS)} END"""
#: What the title words of the fixture's dislikes come down to.
DISLIKED = "CASE WHEN regexp_matches(lower(title), '\\btax(es)?\\b') THEN 'Tax roles' WHEN contains(lower(title), 'software') AND regexp_matches(lower(title), '\\bengineer') THEN 'Software engineering' END"
assert DISLIKES == ["Tax roles", "Software engineering"]

LABEL = "CASE category " + " ".join(f"WHEN {quoted(k)} THEN {quoted(v)}" for k, v in L.CATEGORY_LABELS.items()) + " END"
SCREENED = f"""{CLASSIFIED},
 judged AS (SELECT *, {GRADUATE} AS grad, {DISLIKED} AS dis, {ALLOWED} AS ok FROM classified),
 screened AS (SELECT *, is_specific AND NOT grad AND dis IS NULL AND ok AS included, concat_ws('; ', concat('Listing type: ', {LABEL}, '.'), reason,
  CASE WHEN NOT is_specific THEN NULL WHEN grad THEN {quoted(L.GRADUATE_REASON)} WHEN dis IS NOT NULL THEN concat({quoted(L.PREFERENCE_REASON)}, ' Matched: ', dis, '.')
  WHEN NOT ok THEN {quoted(L.LOCATION_REASON)} WHEN contains(x, 'summer 2027') THEN 'Mentions target year terms: 2027, summer 2027.'
  WHEN contains(x, '2027') THEN 'Mentions target year terms: 2027.' END) AS reasons
  FROM (SELECT *, lower(concat_ws(' ', title, company, location, posting_url, source_url)) AS x FROM judged))"""


def likes_of(text: str) -> list[str]:
    from ..operators.scoring import preference_terms

    return [f"CASE WHEN {any_in(text, preference_terms(p))} THEN {quoted(p)} END" for p in LIKES + INDUSTRIES]


_BODY = "lower(concat_ws(' ', title, company, location, posting_url, replace(reasons, '; ', ' ')))"
_MATCHED = "list_filter([" + ", ".join(likes_of("body")) + "], lambda v: v IS NOT NULL)"
SCORED = f"""{SCREENED}, sources AS ({SOURCES}),
 links AS (SELECT company, arg_min(has_connection, ord) AS link FROM sources GROUP BY company),
 texts AS (SELECT s.*, {_BODY.replace('company,', 's.company,')} AS body, coalesce(l.link, false) AS link FROM screened s LEFT JOIN links l ON s.company = l.company WHERE s.included),
 liked AS (SELECT *, {_MATCHED} AS good, {any_in('body', ['roles'])} OR {any_in('body', ['software', 'engineering'])} AS bad FROM texts),
 scored AS (SELECT *, greatest(0, least(100, 35 + CASE WHEN contains(body, 'intern') THEN 15 ELSE 0 END + CASE WHEN contains(body, '2027') THEN 15 ELSE 0 END
  + least(15, 3 * len(good)) + CASE WHEN link THEN 10 ELSE 0 END - CASE WHEN bad THEN 35 ELSE 0 END))::INTEGER AS score FROM liked)"""
WITH = f"WITH postings AS ({POSTINGS})"


def canonical(url: str) -> str:
    """For addresses of pages: http or https, with a host, plain query values."""
    keep = f"list_filter(string_split(regexp_extract({url}, '[?]([^#]*)', 1), '&'), lambda p: contains(p, '=') AND NOT ends_with(p, '=') AND NOT list_contains([{', '.join(map(quoted, L.TRACKING_PARAMETERS))}], lower(split_part(p, '=', 1))))"
    front = f"regexp_extract({url}, '^[^?#]*', 0)"
    return f"rtrim(lower(concat({front}, CASE WHEN len({keep}) > 0 THEN concat('?', array_to_string({keep}, '&')) ELSE '' END)), '/')"


def posting_canonical(url: str) -> str:
    return f"""CASE WHEN contains(lower({url}), 'linkedin.com/jobs/view/') THEN concat('https://www.linkedin.com/jobs/view/', regexp_extract({url}, 'view/([0-9]+)', 1))
 WHEN contains(lower({url}), 'indeed.com/viewjob') THEN concat('https://www.indeed.com/viewjob?jk=', lower(regexp_extract({url}, 'jk=([A-Za-z0-9]+)', 1))) ELSE {canonical(url)} END"""


def role_text(x: str) -> str:
    return f"trim(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'))"


ROLE_KEY = f"concat_ws('|', {role_text('company')}, {role_text('title')}, {role_text('CASE WHEN location = ' + quoted('Unknown') + ' THEN ' + quoted('') + ' ELSE location END')})"
KEYED = f"keyed AS (SELECT *, {posting_canonical('posting_url')} AS posting_id, {ROLE_KEY} AS role_key FROM postings)"
PREFERENCE = """(CASE WHEN starts_with(source_url, 'job-board://') THEN 0 ELSE 1 END) DESC,
 (CASE WHEN contains(lower(posting_url), 'linkedin.com') OR contains(lower(posting_url), 'indeed.com') THEN 0 ELSE 1 END) DESC,
 (CASE WHEN contains(lower(posting_url), '/job/') OR contains(lower(posting_url), '/jobs/') OR contains(lower(posting_url), 'greenhouse.io') OR contains(lower(posting_url), 'lever.co') THEN 1 ELSE 0 END) DESC,
 length(posting_url) DESC, posting_id DESC"""
ROLES = f"""{KEYED}, firsts AS (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY role_key, posting_id ORDER BY ord) = 1),
 ranked AS (SELECT *, row_number() OVER (PARTITION BY role_key ORDER BY {PREFERENCE}) AS rnk, min(ord) OVER (PARTITION BY role_key) AS role_ord FROM firsts),
 kept AS (SELECT * FROM ranked WHERE rnk = 1 QUALIFY row_number() OVER (PARTITION BY posting_id ORDER BY role_ord DESC) = 1)"""
