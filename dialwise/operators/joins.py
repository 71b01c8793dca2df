"""Joins of aggregates with what they were made from."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CLASSES = 10_000


def match(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` with null equal to null; the keys appear once."""
    keys = list(keys)
    other = right.withColumnsRenamed({k: f"__r_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(other, on, how).drop(*[f"__r_{k}" for k in keys])


def by_row(left: DataFrame, right: DataFrame, keys: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join of tables that both grow with the rows of a job, never by a broadcast.

    Catalyst counts an array as one element and a wide table's columns by their
    kind, so it can take millions of vectors or of rows for a few MB.
    """
    return left.join(right.hint("merge"), keys, how)


def small(df: DataFrame, limit: int = CLASSES) -> DataFrame | None:
    """The table broadcast, or nothing if it has more rows than ``limit``."""
    rows = df.limit(limit + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= limit else None


def few(df: DataFrame, limit: int = CLASSES) -> DataFrame:
    """A table of classes, checked to be small and then broadcast."""
    found = small(df, limit)
    if found is None:
        raise ValueError(f"more than {limit} classes")
    return found


def few_or_many(df: DataFrame, limit: int = CLASSES) -> DataFrame:
    """A table of groups, broadcast if it is checked to be small."""
    found = small(df, limit)
    return df if found is None else found
