"""The whole run: collect, screen, detect changes, score, select, report."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from ..functions import lexicon as L
from ..operators import dedupe, digest, monitor, scoring, screening, snapshot
from ..sinks import tables as sinks
from ..sources import tables as sources
from ..sources.inputs import Inputs
from ..sources.schemas import SCORED


@dataclass
class Step:
    name: str
    status: str
    detail: str = ""


@dataclass
class Run:
    steps: list[Step] = field(default_factory=list)

    @property
    def status(self) -> str:
        states = {s.status for s in self.steps}
        return "failed" if "failed" in states else "partial" if "warning" in states else "success"

    def do(self, name: str, work: Callable[[], str]) -> bool:
        """Runs a step; its failure is recorded and ends the run."""
        try:
            self.steps.append(Step(name, "success", work()))
        except Exception as error:  # a step's failure is data of the run log
            self.steps.append(Step(name, "failed", str(error)[:500]))
            return False
        return True


def run(
    spark: SparkSession, data: str, inputs: Inputs, markers: list[str], career: DataFrame, boards: DataFrame | None = None,
    errors: DataFrame | None = None, deliver: Callable[[DataFrame], str | None] | None = None, scorer: Callable[[DataFrame], DataFrame] | None = None,
) -> Run:
    """One scheduled run over collected postings; every table is written under ``data``.

    ``scorer`` may replace the local scores. ``deliver`` gets the selection and
    returns an error or nothing; only after it succeeds are postings marked as
    sent. Each step is one or two Spark jobs over tables read back from storage.
    """
    done = Run()
    path = lambda name: f"{data}/{name}"

    def collect() -> str:
        merged = dedupe.merge_candidates(career, boards)
        sinks.json_lines(merged, path("postings.jsonl"))
        if errors is not None:
            sinks.json_lines(errors, path("collection_errors.jsonl"))
        return f"{sources.postings(spark, path('postings.jsonl')).count()} postings"

    def detect() -> str:
        found = snapshot.detect_changes(sources.postings(spark, path("postings.jsonl")), _history(spark, path("history")))
        sinks.json_lines(found.changes, path("posting_changes.jsonl"))
        sinks.json_lines(found.new_postings.select(dedupe.FIELDS), path("new_postings.jsonl"))
        sinks.state(found.history, path("history"), "company", "title", "posting_id")
        return ", ".join(f"{r['status']} {r['n']}" for r in snapshot.status_counts(sources.json_lines(spark, path("posting_changes.jsonl"), "status string")).collect())

    def screen() -> str:
        rows = screening.screened(sources.postings(spark, path("postings.jsonl")), inputs.dislikes, markers)
        sinks.split_filtered(rows, path("filtered_postings.jsonl"), path("excluded_postings.jsonl"))
        every = sources.filtered_postings(spark, path("filtered_postings.jsonl")).unionByName(sources.filtered_postings(spark, path("excluded_postings.jsonl")))
        idle = monitor.without_openings(_registry(spark, path), every, sources.postings(spark, path("postings.jsonl")), sources.collection_errors(spark, path("collection_errors.jsonl")))
        sinks.json_lines(idle, path("monitored_no_openings.jsonl"))
        return "screened"

    def score() -> str:
        kept = sources.filtered_postings(spark, path("filtered_postings.jsonl"))
        rows = scorer(kept) if scorer else scoring.scored(kept, _registry(spark, path), inputs.likes, inputs.industries, inputs.dislikes, markers)
        sinks.json_lines(rows.select([c.split()[0] for c in SCORED.split(", ") if " " in c]), path("scored_postings.jsonl"))
        return f"scored, {L.RECOMMENDED_SCORE} recommends"

    def email() -> str:
        sent = spark.read.parquet(path("sent")) if sources.exists(spark, path("sent")) else spark.createDataFrame([], "posting_url string")
        rows = digest.selected(sources.scored_postings(spark, path("scored_postings.jsonl")), sent, snapshot.inactive_urls(_history(spark, path("history"))), markers)
        sinks.json_lines(rows, path("email.jsonl"))
        if deliver is None:
            return "drafted"
        chosen = sources.scored_postings(spark, path("email.jsonl"))
        if error := deliver(chosen):
            done.steps.append(Step("delivery", "warning", error))
            return "drafted"
        sinks.state(digest.sent_union(sent, chosen), path("sent"))
        return "sent"

    for name, work in (("collection", collect), ("detection", detect), ("screening", screen), ("scoring", score), ("email", email)):
        if not done.do(name, work):
            break
    log = spark.createDataFrame([(done.status, [(s.name, s.status, s.detail) for s in done.steps])], "status string, steps array<struct<name:string,status:string,detail:string>>")
    sinks.append_lines(log, path("runs.jsonl"))
    return done


def _history(spark: SparkSession, path: str) -> DataFrame:
    if not sources.exists(spark, path):
        return spark.createDataFrame([], snapshot.HISTORY)
    return snapshot.with_role_keys(spark.read.parquet(path))


def _registry(spark: SparkSession, path: Callable[[str], str]) -> DataFrame:
    return sources.source_registry(spark, path("source_registry.json"))
