"""Word lists and fixed phrases of the posting rules.

Fixed values: results depend on each of them and on their order.
"""

INTERNSHIP_PATTERNS = [
    r"\binternships?\b", r"\bintern\b", r"\bsummer analyst\b", r"\bsummer associate\b",
    r"\bassociate consultant intern\b", r"\bco-?op\b", "סטודנט(?:ית|ים|יות)?", r"סטודנט\s*[/.-]\s*ית",
]
STUDENT_PATTERN = r"\bstudents?\b"
HEBREW_STUDENT_PATTERN = r"סטודנט(?:ית|ים|יות)?|סטודנט\s*[/.-]\s*ית"
GENERIC_EXACT_TITLES = [
    "careers", "events & programs", "find jobs", "internships", "jobs", "students", "students & graduates overview",
    "students and graduates", "internship program", "internship programs",
]
GENERIC_TITLE_FRAGMENTS = [
    "advance internship", "analyst relations", "campus programs", "contract opportunit", "explore programs", "find a role",
    "golden ticket", "internships & programs", "join our talent community", "learn about our", "overview", "saved jobs",
    "search and apply", "search intern", "search opportunit", "see programs in", "student development programs",
    "student programs quiz", "students & graduates", "talent community", "view programs", "why this", "work with us",
]
GENERIC_URL_FRAGMENTS = [
    "/campus-programs", "/entry-level", "/events", "/find-a-role", "/golden-ticket", "/internships-programs",
    "/internships.html", "/programs-events", "/resources?", "/saved-jobs", "/search-jobs", "/students-and-graduates",
    "/students/", "/undergraduate", "/work-with-us/", "beamery.com", "indeed.com/jobs?", "indeed.com/q-",
    "linkedin.com/jobs/search", "talentexchange.",
]
BLOG_URL_FRAGMENTS = ["/blog", "/blog-", "/career-stories", "/life-at-"]
STORY_MARKERS = ["career story", "employee story", "why this vice president", "never stops investing", "life at "]
SEARCH_MARKERS = ["search intern", "search and apply", "search opportunit", "/search-jobs", "/entry-level", "keywords="]
SPECIFIC_URL_FRAGMENTS = [
    "/job/", "/job-detail/", "/jobdetail/", "/jobs/", "/jobs/view/", "/opening/", "/position/", "/careers/details/",
    "/viewjob", "careersection", "gh_jid=", "jobid=", "jk=", "requisition", "reqid=",
]
ROLE_TITLE_TERMS = [
    "analyst", "associate", "consultant", "developer", "engineer", "finance", "operations", "research", "risk",
    "technology", "סטודנט",
]
LONG_TITLE_WORDS = 12
CATEGORY_LABELS = {
    "specific_listing": "Specific internship listing", "generic_program_page": "Generic program page",
    "generic_search_page": "Generic search page", "blog_or_story": "Blog or career story",
    "not_internship": "Not an internship listing",
}

UNDERGRADUATE_PATTERNS = [r"\bundergraduate\b", r"\bbachelor(?:'s|s)?\b", r"\bcollege (?:student|students|degree)\b"]
GRADUATE_PATTERNS = [
    r"\bgraduate (?:degree|program|student|students)\b", r"\badvanced graduate\b", r"\bpostgraduate\b",
    r"\bmaster(?:'s|s)?\b", r"\bmba\b", r"\bph\.?d\.?\b", r"\bdoctoral\b|\bdoctorate\b", r"\bj\.?d\.?\b",
    r"\bll\.?m\.?\b", r"\bm\.?d\.?\b", r"\blaw (?:school|student|students)\b", r"\bmedical (?:school|student|students)\b",
]
STRICT_GRADUATE_PATTERNS = [
    r"\bgraduate engineer\b",
    r"\b(?:must be |currently )?enrolled in (?:an? )?graduate (?:degree )?program\b",
]
GRADUATE_REASON = "Excluded because the role is intended for graduate or advanced-degree students, not undergraduate applicants."
PREFERENCE_REASON = "Excluded because the role title conflicts with an explicit user dislike."
LOCATION_REASON = "Excluded because location does not match the user's preference of location."
TARGET_YEAR_TERMS = ["2027", "summer 2027"]
MENTION_TERMS = [
    "intern", "internship", "summer analyst", "summer associate", "associate consultant intern", "co-op", "coop",
    "campus", "early career", "entry-level", "graduate", "program", "student", "students", "2027", "summer 2027",
]

REMOTE_MARKERS = [
    "remote", "online", "virtual", "work from home", "work-from-home", "wfh", "anywhere", "fully online", "distributed",
    "work remotely",
]
FLEXIBLE_MARKERS = ["any site", "flexible", "multiple locations", "various locations"]
AMBIGUOUS_PLACES = {"costa rica": ["san jose"]}

TITLE_STOPWORDS = [
    "a", "and", "for", "in", "managing", "management", "of", "position", "positions", "role", "roles", "the", "with",
]
PREFERENCE_STOPWORDS = ["and", "can", "company", "have", "high", "hired", "where", "with"]
RECOMMENDED_SCORE = 60

TRACKING_PARAMETERS = ["utm_source", "utm_medium", "utm_campaign", "utm_content", "utm_term", "ref", "source", "gh_src"]
BOARD_SLUGS = {
    "alpineinternships": "Alpine", "aquaticcapitalmanagement": "Aquatic Capital Management", "palantir": "Palantir",
    "thelibragroup": "Libra Group", "virtu": "Virtu Financial", "walleyecapital-external-students": "Walleye Capital",
}
BOARD_SLUG_SUFFIXES = ["-external-students", "-students", "internships", "-jobs"]
MISSING_COMPANIES = ["...", "…", "unknown company", "untitled posting"]
MISSING_PLACES = ["unknown", "untitled posting"]
SNIPPET_PLACE_PATTERNS = [
    r"\b(?:location|based in|office)\s*:\s*([^|.;]+)",
    r"\bin\s+([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*,\s*[A-Z]{2})\b",
    r"\b([A-Z][A-Za-z]+(?:\s+[A-Z][A-Za-z]+)*,\s*[A-Z]{2})\b",
    r"\b(Remote|Hybrid)\b",
]
NOT_PLACES = ["intern", "internship", "summer", "untitled", "untitled posting"]
BOARD_DOMAINS = [
    "greenhouse.io", "lever.co", "myworkdayjobs.com", "icims.com", "smartrecruiters.com", "ashbyhq.com", "workday.com",
    "job-board", "jobs.", "linkedin.com", "indeed.com",
]
BOARD_KEYWORDS = ["intern", "internship", "summer analyst", "/jobs/", "/job/"]
BOARD_QUERIES = [
    "summer {target_year} internship site:greenhouse.io", "summer {target_year} internship site:jobs.lever.co",
    "summer {target_year} internship site:myworkdayjobs.com", "summer {target_year} internship site:linkedin.com/jobs/view",
    '"summer intern" {target_year} site:linkedin.com/jobs/view', "internship {target_year} site:linkedin.com/jobs/view",
    "summer {target_year} internship site:indeed.com/viewjob", '"summer intern" {target_year} site:indeed.com/viewjob',
    "internship analyst {target_year} site:indeed.com/viewjob",
]

CAREER_KEYWORDS = [
    "career", "careers", "intern", "internship", "job", "jobs", "student", "students", "graduate", "university", "campus",
]
BLOCKED_DOMAINS = ["facebook.com", "instagram.com", "linkedin.com", "twitter.com", "x.com", "youtube.com", "wikipedia.org"]
DISCOVERY_BLOCKED = [
    "extern.com", "glassdoor.com", "handshake.com", "indeed.com", "linkedin.com", "medium.com", "quora.com", "reddit.com",
    "university", "wikipedia.org", "youtube.com",
]
DOMAIN_COMPANIES = {
    "blackrock": "BlackRock", "goldmansachs": "Goldman Sachs", "jpmorganchase": "JPMorgan Chase", "jpmorgan": "JPMorgan Chase",
    "morganstanley": "Morgan Stanley", "deloitte": "Deloitte", "ey": "EY", "pwc": "PWC", "bain": "Bain",
    "mckinsey": "McKinsey & Co", "palantir": "Palantir", "anduril": "Anduril", "lockheedmartin": "Lockheed Martin",
    "northropgrumman": "Northrop Grumman", "rtx": "RTX",
}
CAREER_PATH_MARKERS = ["/career", "/job", "/jobs", "/student", "/intern", "internship"]

LINK_TEXT_KEYWORDS = [
    "analyst", "associate consultant", "graduate", "intern", "internship", "job", "opening", "opportunities", "opportunity",
    "position", "program", "role", "student", "summer",
]
LINK_URL_KEYWORDS = ["/job/", "/jobs/", "jobid=", "requisition"]
LINK_EXCLUDED_URLS = ["/blog", "blog-"]
LINK_EXCLUDED_TITLES = ["benefits", "blog: inside bain", "career stories", "careers", "contact us", "privacy notice"]
LINK_EXCLUDED_PREFIXES = ["#", "mailto:", "tel:", "javascript:"]
PAGE_KEYS = ["page", "pageindex", "pageoffset", "pagenumber", "page_number", "pg", "currentpage", "resultsfrom"]
PAGE_NUMBER_KEYS = ["start", "startindex", "startrow", "offset", "from"]
PAGE_TEXTS = ["next", "next page", "older", "older jobs", "more", "more jobs", "load more", "show more"]
LISTING_TEXTS = [
    "all jobs", "all openings", "available jobs", "career opportunities", "careers", "current jobs", "current openings",
    "find jobs", "job opportunities", "jobs", "open jobs", "open positions", "open roles", "search jobs", "see jobs",
    "view jobs", "view openings",
]
TRUSTED_HOSTS = [
    "ashbyhq.com", "breezy.hr", "greenhouse.io", "icims.com", "lever.co", "myworkdayjobs.com", "smartrecruiters.com",
    "successfactors.com", "taleo.net", "teamtailor.com",
]

PROGRAM_KEYWORDS = [
    "software engineering", "software engineer", "quantitative research", "quantitative trading", "data science",
    "data scientist", "business operations", "operations analyst", "financial analyst", "investment banking", "operations",
    "finance", "engineering", "analyst", "mba", "phd", "undergraduate", "graduate",
]
DEADLINE_PATTERNS = [
    r"(?:deadline|apply by|apply before|before|due date|due|by)[:\s]+([a-zA-Z]+\s+\d+(?:st|nd|rd|th)?|\d{1,2}/\d{1,2}(?:/\d{2,4})?)",
    r"\b([a-zA-Z]+\s+\d+(?:st|nd|rd|th)?|\d{1,2}/\d{1,2}(?:/\d{2,4})?)\s+deadline\b",
]
DIAGNOSTIC_MARKERS = [
    "ai scoring unavailable", "ai scoring was temporarily unavailable", "googleapis.com", "google.rpc", "quotaexceeded",
    "quota exceeded", "resource_exhausted", "retryinfo",
]
ACTIVITY_TYPES = {
    "opportunity_status_updated": "posting status", "posting_note_updated": "note edit", "company_list_updated": "company edit",
    "company_suggestion_dismissed": "company edit", "reference_file_updated": "file upload",
    "reference_attachment_uploaded": "file upload", "reference_attachment_deleted": "file upload", "collection": "collection",
    "scoring": "scoring", "email": "email", "preferences_updated": "company edit",
}
