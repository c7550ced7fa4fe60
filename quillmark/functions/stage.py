"""Keeps a projection from being worked out twice."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def settled(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``df`` and ``columns``, each worked out once a row.

    A later filter on a projected column is pushed below the projection with
    the column's expression in place of its name, and so works it out again,
    level upon level. A generator of one row stops that.
    """
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
