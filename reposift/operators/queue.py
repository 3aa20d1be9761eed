"""The work queue as a table. Every change gives a new DataFrame with one row per repository.

Further columns of the queue pass through all changes. ``reposift.sources.queue_table`` uses them
to store the rows that a change has touched.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift.functions.status import (
    RESET_PATTERNS,
    error_text,
    is_pending,
    like_any,
)
from reposift.operators.ordering import within_first
from reposift.schemas import QUEUE, QUEUE_KEY


_KEY_NAMES = [f"_{k}" for k in QUEUE_KEY]


def _key(ignore_case: bool) -> list[Column]:
    parts = [F.lower(k) if ignore_case else F.col(k) for k in QUEUE_KEY]
    return [part.alias(name) for part, name in zip(parts, _KEY_NAMES)]


def new_queue(pairs: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Queue of the given pairs, all pending; a repeated pair is kept once."""
    if ignore_case:
        spelled = F.min(F.struct(*QUEUE_KEY)).alias("pair")
        pairs = pairs.groupBy(*_key(True)).agg(spelled).select("pair.*")
    else:
        pairs = pairs.select(*QUEUE_KEY).dropDuplicates()
    return pairs.select(
        *QUEUE_KEY,
        F.lit(None).cast("string").alias("checkout_id"),
        F.lit(None).cast("string").alias("result"),
        F.lit(False).alias("completed"),
    )


def load_queue(
    pairs: DataFrame, queue: DataFrame | None = None, ignore_case: bool = False
) -> DataFrame:
    """Insert pairs, ignoring those already there.

    Without ``queue`` the result replaces whatever queue there was; with it, its rows are
    kept as they are.
    """
    fresh = new_queue(pairs, ignore_case)
    if queue is None:
        return fresh
    known = queue.select(*_key(ignore_case))
    same = [F.col(f"fresh.{k}") for k in QUEUE_KEY]
    if ignore_case:
        same = [F.lower(k) for k in same]
    condition = (same[0] == F.col("known._owner")) & (same[1] == F.col("known._repo"))
    added = fresh.alias("fresh").join(known.alias("known"), condition, "left_anti")
    return queue.unionByName(added, allowMissingColumns=True)


def _update(
    queue: DataFrame,
    changes: DataFrame,
    assignments: dict[str, Column],
    ignore_case: bool,
) -> DataFrame:
    """Assign columns in the rows whose key is in ``changes`` (unique on the key columns)."""
    hit = F.col("_hit").isNotNull()
    joined = queue.withColumns(dict(zip(_KEY_NAMES, _key(ignore_case)))).join(
        changes.withColumn("_hit", F.lit(True)), _KEY_NAMES, "left"
    )
    updated = {
        column: F.when(hit, value).otherwise(F.col(column))
        for column, value in assignments.items()
    }
    return joined.withColumns(updated).select(*queue.columns)


def claim(queue: DataFrame, token: int | str, limit: int | None = 1000) -> DataFrame:
    """Stamp the first ``limit`` pending rows by (owner, repo) with ``token``.

    The claimed rows are a range of the key, so its last one decides for each row, without a
    join or a shuffle of the queue (see :func:`reposift.operators.ordering.within_first`).
    ``limit=None`` claims all pending rows. The batch is ``claimed(queue, token)``.
    """
    taken = is_pending()
    if limit is not None:
        taken = taken & within_first(queue.filter(is_pending()), limit, QUEUE_KEY)
    stamped = F.when(taken, F.lit(str(token))).otherwise(F.col("checkout_id"))
    return queue.withColumn("checkout_id", stamped)


def claimed(queue: DataFrame, token: int | str) -> DataFrame:
    """The (owner, repo) pairs that carry the token and are still in progress."""
    mine = (F.col("checkout_id") == str(token)) & ~F.col("completed") & F.col("result").isNull()
    return queue.filter(mine).select(*QUEUE_KEY)


def mark_completed(
    queue: DataFrame, pairs: DataFrame, token: int | str, ignore_case: bool = False
) -> DataFrame:
    """Complete the given pairs under ``token``; failed ones too, their status stays ERROR."""
    changes = pairs.select(*_key(ignore_case)).dropDuplicates()
    values = {"completed": F.lit(True), "checkout_id": F.lit(str(token))}
    return _update(queue, changes, values, ignore_case)


def first_errors(
    errors: DataFrame, seq: str | None = None, ignore_case: bool = False
) -> DataFrame:
    """One error text per pair: the one of the lowest ``seq``, else the smallest text."""
    text = error_text(F.col("error"))
    first = F.min(text) if seq is None else F.min(F.struct(seq, text.alias("text")))["text"]
    return errors.groupBy(*_key(ignore_case)).agg(first.alias("_error"))


def mark_error(
    queue: DataFrame, errors: DataFrame, seq: str | None = None, ignore_case: bool = False
) -> DataFrame:
    """Record errors (owner, repo, error) and release the claim; the first error stays."""
    untouched = F.col("result").isNull()
    values = {
        "result": F.coalesce(F.col("result"), F.col("_error")),
        "checkout_id": F.when(~untouched, F.col("checkout_id")),
    }
    return _update(queue, first_errors(errors, seq, ignore_case), values, ignore_case)


def reset_errors(
    queue: DataFrame,
    patterns: Sequence[str] = RESET_PATTERNS,
    ignore_case: bool = False,
) -> DataFrame:
    """Make rows pending again whose error matches one of the patterns, in one pass."""
    hit = like_any(F.col("result"), patterns, ignore_case)
    return queue.withColumns(
        {
            "checkout_id": F.when(~hit, F.col("checkout_id")),
            "result": F.when(~hit, F.col("result")),
            "completed": F.col("completed") & ~hit,
        }
    )


def release_incomplete(queue: DataFrame) -> DataFrame:
    """Drop the claims on all rows that are not completed."""
    return queue.withColumn("checkout_id", F.when(F.col("completed"), F.col("checkout_id")))


def release_stale(queue: DataFrame, live_tokens: Iterable[int | str]) -> DataFrame:
    """Drop the claims on rows that are not completed, but for those of live tokens."""
    live = [str(token) for token in live_tokens]
    kept = F.col("completed") | (F.col("checkout_id").isin(live) if live else F.lit(False))
    return queue.withColumn("checkout_id", F.when(kept, F.col("checkout_id")))
