"""Short texts about a run's tables, from small aggregates."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import discovery, rollup, screening, search, snapshot

TOP = 5


def block(title: str, facts: Iterable[tuple[str, object]], heading: str = "", lines: Iterable[str] = ()) -> str:
    """A title, its facts, and a list under a heading if it has any."""
    out = [title, "=" * len(title), *(f"{name}: {value}" for name, value in facts)]
    items = [f"- {line}" for line in lines]
    return "\n".join(out + (["", f"{heading}:", *items] if items else []))


def collection(postings: DataFrame, errors: DataFrame) -> str:
    counts = [f"{r['company']}: {r['n']}" for r in rollup.by_company(postings).toLocalIterator()]
    return block("Collection summary", [("Postings", postings.count()), ("Source errors", errors.count())], "By company", counts)


def screening_result(filtered: DataFrame) -> str:
    n = filtered.agg(F.count_if("included").alias("kept"), F.count_if(~F.col("included")).alias("out")).first()
    types = [f"{r['label']}: {r['n']}" for r in screening.excluded_by_type(filtered).collect()]
    return block("Filter summary", [("Included", n["kept"]), ("Excluded", n["out"])], "Excluded by listing type", types)


def detection(found: snapshot.Detection) -> str:
    counts = [(r["status"], r["n"]) for r in snapshot.status_counts(found.changes).collect()]
    return block("New posting detection summary", [("Changes recorded", sum(n for _, n in counts)), ("New postings", dict(counts).get("new", 0))], "Status counts", [f"{s}: {n}" for s, n in counts])


def scores(scored: DataFrame) -> str:
    best = scored.orderBy(F.desc("score"), "company", "title").limit(TOP).collect()
    return block("Fit scoring summary", [("Scored postings", scored.count())], "Top scored postings", [f"{r['company']}: {r['title']} ({r['score']}, {r['fit_level']})" for r in best])


def search_results(results: DataFrame) -> str:
    best = results.orderBy(F.desc("relevance_score"), "title").limit(TOP).collect()
    return block("Internet search summary", [("Results", results.count())], "Top results", [f"{r['title']} ({r['relevance_score']}): {r['url']}" for r in best])


def boards(postings: DataFrame) -> str:
    kinds = {r["platform"]: r["n"] for r in search.platform_counts(postings).collect()}
    missing = [f"No {name} listing addresses this time." for key, name in (("linkedin", "LinkedIn"), ("indeed", "Indeed")) if not kinds.get(key)]
    return block("Job board summary", sorted(kinds.items()), "Limitations", missing)


def registry(sources: DataFrame) -> str:
    return block("Source registry summary", discovery.registry_totals(sources).first().asDict().items())


def idle_companies(monitored: DataFrame) -> str:
    rows = monitored.orderBy(F.lower("company")).limit(TOP).collect()
    return block("Monitored companies without openings", [("Companies", monitored.count())], "First", [f"{r['company']}: {r['reason']}" for r in rows])


def usage(totals: DataFrame, model: str) -> str:
    row = totals.first()
    return f"Model usage ({model}): {row['prompt_tokens']} prompt, {row['output_tokens']} output, {row['total_tokens']} total tokens." if row["total_tokens"] else ""
