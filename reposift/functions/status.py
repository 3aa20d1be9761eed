"""Expressions over the columns of the work queue."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# LIKE patterns of the error report and the label of each, first hit wins.
ERROR_BUCKETS = (
    ("%No such file or directory%", "No such file or directory"),
    ("%503 Service Unavailable%", "503 Service Unavailable"),
    ("%cannot open git-upload-pack%", "cannot open git-upload-pack"),
    ("%git-upload-pack not permitted%", "git-upload-pack not permitted"),
    ("%authentication not supported%", "authentication not supported"),
    ("%Duplicate stages not allowed:%", "Duplicate stages not allowed"),
    ("%File name too long%", "File name too long"),
    ("%Nul character not allowed:%", "Nul character not allowed"),
    ("%No space left on device%", "No space left on device"),
)
ERROR_BUCKET_LENGTH = 50
ERROR_LENGTH = 254

# LIKE patterns of passing errors, after which a repository is tried again.
RESET_PATTERNS = (
    "%authentication not supported%",
    "%503 Service Unavailable%",
    "%SSL peer shut down incorrectly%",
    "%No such file or directory%",
    "%Shutdown in progress%",
    "%Socket%closed%",
    "%No space left on device%",
    "%Read timed out after 120,000 ms%",
    "%git-upload-pack not permitted%",
    "%Connection timed out (Connection timed out)%",
    "%cannot open git-upload-pack%",
)


def like_any(text: Column, patterns: Iterable[str], ignore_case: bool = False) -> Column:
    """True if any pattern with ``%`` wildcards matches; null text gives false."""
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | (text.ilike(pattern) if ignore_case else text.like(pattern))
    return F.coalesce(hit, F.lit(False))


def error_text(error: Column) -> Column:
    """Error as the queue keeps it: at most 254 characters, ``unknown`` for null."""
    return F.substring(F.coalesce(error, F.lit("unknown")), 1, ERROR_LENGTH)


def queue_status(
    result: Column | str = "result",
    completed: Column | str = "completed",
    checkout_id: Column | str = "checkout_id",
) -> Column:
    """ERROR, FINISHED, IN_PROGRESS or PENDING, the first that applies."""
    result, completed, checkout_id = (
        F.col(c) if isinstance(c, str) else c for c in (result, completed, checkout_id)
    )
    return (
        F.when(result.isNotNull(), "ERROR")
        .when(completed, "FINISHED")
        .when(checkout_id.isNotNull(), "IN_PROGRESS")
        .otherwise("PENDING")
    )


def error_bucket(result: Column, ignore_case: bool = False) -> Column:
    """Label of the first known pattern in the error, else its first 50 characters."""
    bucket = F.substring(result, 1, ERROR_BUCKET_LENGTH)
    for pattern, label in reversed(ERROR_BUCKETS):
        hit = result.ilike(pattern) if ignore_case else result.like(pattern)
        bucket = F.when(hit, label).otherwise(bucket)
    return bucket


def is_pending() -> Column:
    return ~F.col("completed") & F.col("result").isNull() & F.col("checkout_id").isNull()


def is_in_progress() -> Column:
    return ~F.col("completed") & F.col("result").isNull() & F.col("checkout_id").isNotNull()


def is_failed() -> Column:
    return F.col("result").isNotNull()
