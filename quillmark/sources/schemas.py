"""The tables' schemas."""

POSTING = (
    "title string, company string, location string, posting_url string, date_collected string, source_url string, "
    "eligibility_text string"
)
FILTERED = f"{POSTING}, included boolean, reasons array<string>"
SCORED = (
    "title string, company string, location string, posting_url string, date_collected string, source_url string, "
    "score int, fit_level string, provider string, explanations array<string>, gaps array<string>"
)
SOURCE = (
    "company string, website string, careers_url string, source_type string, origin string, has_connection boolean, "
    "notes string, alternate_careers_urls array<string>, collector string"
)
ERROR = "company string, source_url string, message string"
HISTORY = (
    "posting_id string, title string, company string, location string, posting_url string, source_url string, "
    "first_seen string, last_seen string, content_hash string, active boolean, role_key string"
)
CHANGE = (
    "status string, posting_id string, title string, company string, posting_url string, first_seen string, "
    "last_seen string, reason string"
)
MONITORED = (
    "company string, website string, careers_url string, has_connection boolean, status string, reason string, "
    "candidates_collected long, excluded_pages long, collection_error string, date_checked string"
)
SEARCH_RESULT = (
    "title string, url string, snippet string, provider string, query string, date_searched string, relevance_score int"
)
BOARD_POSTING = (
    "title string, company string, location string, posting_url string, posting_id string, snippet string, "
    "provider string, query string, date_searched string"
)
DISCOVERED = (
    "name string, website string, careers_url string, industry_tags array<string>, reason string, source string, "
    "origin string, should_add_to_source_registry boolean, review_status string, evidence_title string, "
    "evidence_url string, evidence_snippet string"
)
ACTIVITY = "timestamp string, date string, action string, subject string, details string, api_invoked boolean, cost string"
RUN = "started_at string, finished_at string, status string, steps array<struct<name:string,status:string,detail:string>>"
