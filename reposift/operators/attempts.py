"""Outcome of operations that were tried several times."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def resolve_attempts(
    attempts: DataFrame, keys: Sequence[str] = ("owner", "repo"), max_attempts: int = 3
) -> DataFrame:
    """Per key the first success among the first ``max_attempts`` tries, else the last failure.

    Attempts are rows of the keys, ``attempt`` (1, 2, …), ``ok`` and ``error``.
    """
    row = F.struct("attempt", "ok", "error")
    first_success = F.min_by(F.when(F.col("ok"), row), F.when(F.col("ok"), F.col("attempt")))
    last = F.max_by(row, "attempt")
    resolved = (
        attempts.filter(F.col("attempt") <= max_attempts)
        .groupBy(*keys)
        .agg(F.coalesce(first_success, last).alias("outcome"))
    )
    return resolved.select(*keys, "outcome.attempt", "outcome.ok", "outcome.error")


def failures(resolved: DataFrame) -> DataFrame:
    """The outcomes without success, as errors to record in the queue."""
    return resolved.filter(~F.col("ok"))
