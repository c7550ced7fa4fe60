"""The location policy: which places are allowed."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicon as L
from .urls import contains_any, let


def joined(*parts: Column) -> Column:
    """The parts that aren't blank, trimmed, joined by a space, lower case."""
    cells = F.array(*(F.trim(F.coalesce(p, F.lit(""))) for p in parts))
    return F.lower(F.array_join(F.filter(cells, lambda p: p != ""), " "))


def is_unknown(location: Column) -> Column:
    return F.lower(F.trim(F.coalesce(location, F.lit("")))).isin("", "unknown")


def text_allowed(text: Column, markers: list[str]) -> Column:
    """Ambiguous places are refused, remote work is allowed, else a marker must occur.

    A remote word beside parentheses needs a marker as well.
    """
    return let(text, lambda t: _allowed_text(t, markers))


def _allowed_text(text: Column, markers: list[str]) -> Column:
    wanted = contains_any(text, markers)
    refused = F.lit(False)
    for country, cities in L.AMBIGUOUS_PLACES.items():
        if country not in markers:
            refused = refused | (text.contains(country) & contains_any(text, cities))
    remote = contains_any(text, L.REMOTE_MARKERS)
    return F.when((text == "") | refused, F.lit(False)).when(remote & ~text.rlike("[()]"), F.lit(True)).otherwise(wanted)


def allowed(location: Column, title: Column, details: Column, markers: list[str]) -> Column:
    """May a posting at this place be shown? ``markers`` are lower-case place words."""
    flexible = let(joined(location), lambda t: contains_any(t, L.FLEXIBLE_MARKERS))
    named = let(joined(location, title, details), lambda t: contains_any(t, markers))
    return (
        F.when(is_unknown(location), text_allowed(joined(title, details), markers))
        .when(flexible, named | text_allowed(joined(location, title), markers))
        .otherwise(text_allowed(joined(location), markers))
    )


def allowed_summary(location: Column, details: Column, markers: list[str]) -> Column:
    """Of a list of places, those allowed; an ellipsis stands for the rest."""
    whole = F.trim(location)
    low = joined(details)
    named = F.array_compact(F.array(*(F.when(low.contains(m), F.lit(m.title())) for m in markers))) if markers else F.array().cast("array<string>")
    parts = F.split(whole, r"\s*(?:\||;|\r?\n|•)\s*")
    parts = F.filter(F.transform(parts, lambda p: F.btrim(p, F.lit(" \t\r\n-–—•"))), lambda p: p != "")
    kept = F.array_distinct(F.filter(parts, lambda p: text_allowed(F.lower(F.trim(p)), markers)))
    rest = F.when(F.size(kept) < F.size(parts), F.lit(" | …")).otherwise(F.lit(""))
    return (
        F.when(whole == "", location)
        .when(contains_any(joined(location), L.FLEXIBLE_MARKERS) & (F.size(named) > 0), F.concat(F.array_join(F.array_distinct(named), " | "), F.lit(" | …")))
        .when((F.size(parts) < 2) | (F.size(kept) == 0), whole)
        .otherwise(F.concat(F.array_join(kept, " | "), rest))
    )
