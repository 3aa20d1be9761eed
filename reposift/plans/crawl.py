"""Claim a batch of the queue, extract its rows, store them, mark the batch."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.operators.history import REPO, commit_messages, file_history
from reposift.operators.queue import claim, mark_completed, mark_error, release_stale
from reposift.schemas import QUEUE_KEY
from reposift.session import passing_tables, run_token, sized, written_table
from reposift.sources.error_log import log_errors
from reposift.sources.queue_table import (
    apply_change,
    claim_token,
    queue_version,
    touched_rows,
)
from reposift.sources.run_store import new_run, store_records

# Fixed value: repositories per claim, unless told otherwise.
BATCH_REPOSITORIES = 20_000


Rows = Callable[[DataFrame], DataFrame]


def owner_range(batch: DataFrame) -> tuple[str, str] | None:
    """First and last owner of a batch; None if it is empty."""
    low, high = batch.agg(F.min("owner"), F.max("owner")).first()
    return None if low is None else (low, high)


def near_rows(rows: DataFrame, owners: tuple[str, str]) -> DataFrame:
    """The rows between the first and the last owner of a batch.

    A batch is a range of the queue's order, so on tables clustered by owner the scan skips all
    other files and row groups.
    """
    return rows.filter(F.col("owner").between(*map(F.lit, owners)))


def rows_of(batch: DataFrame, owners: tuple[str, str]) -> Rows:
    """A function that keeps the rows whose repository is in the batch."""

    def of(rows: DataFrame) -> DataFrame:
        return near_rows(rows, owners).join(batch, REPO, "left_semi")

    return of


def _crawl(
    spark: SparkSession,
    store: str,
    split: str,
    commits: DataFrame,
    extract: Callable[[DataFrame, tuple[str, str]], DataFrame],
    failures: DataFrame | None,
    limit: int | None,
    token: int | None,
) -> bool:
    """One turn of a crawl. ``extract`` gets the repositories to read and the range of their owners."""
    if not queue_version(spark, store).pending():
        return False
    token = run_token() if token is None else token
    new_run(spark, store, [split], token)
    claim_token(spark, store, token)
    with passing_tables(spark):
        # Only the first ranges with as many pending rows as wanted are read.
        claimed = apply_change(
            spark, store, lambda q: claim(q, token, limit), pick=lambda v: v.with_pending(limit)
        )
        batch = sized(touched_rows(spark, store, claimed.segment).select(*QUEUE_KEY))
        owners = owner_range(batch)
        if owners is None:
            return False
        of_batch = rows_of(batch, owners)

        good, of_good = batch, of_batch
        if failures is not None:
            failures = sized(written_table(of_batch(failures), "failures"))
            failed = failures.select(*REPO).dropDuplicates()
            good = sized(written_table(batch.join(failed, REPO, "left_anti"), "good"))
            of_good = rows_of(good, owners)
        store_records(extract(good, owners), store, split, token)
        if "error" in commits.columns:
            log_errors(of_good(commits).filter(F.col("error").isNotNull()), store, token)

        # The whole batch ends here, so failed repositories are completed as well.
        def ended(latest: DataFrame) -> DataFrame:
            if failures is not None:
                seq = "seq" if "seq" in failures.columns else None
                latest = mark_error(latest, failures, seq)
            return mark_completed(latest, batch, token)

        apply_change(spark, store, ended, pick=lambda v: v.between(*owners))
    return True


def crawl_commit_messages(
    spark: SparkSession,
    store: str,
    commits: DataFrame,
    failures: DataFrame | None = None,
    limit: int | None = BATCH_REPOSITORIES,
    token: int | None = None,
) -> bool:
    """Store the commit messages of the next batch; false if nothing was pending.

    ``failures`` (owner, repo, error and perhaps seq) are repositories that could not be
    read: they give no rows and the queue gets their error. Commits with an ``error`` go to
    the error log only. A larger ``limit`` means fewer passes over ``commits``; None takes
    all pending repositories at once.
    """

    def extract(good: DataFrame, owners: tuple[str, str]) -> DataFrame:
        return commit_messages(rows_of(good, owners)(commits))

    return _crawl(spark, store, "COMMIT_MESSAGES", commits, extract, failures, limit, token)


def crawl_file_history(
    spark: SparkSession,
    store: str,
    commits: DataFrame,
    snapshots: DataFrame,
    extensions: str | Iterable[str] = "js,coffee,ts",
    failures: DataFrame | None = None,
    limit: int | None = BATCH_REPOSITORIES,
    token: int | None = None,
    **options,
) -> bool:
    """Store the file changes of the next batch; false if nothing was pending.

    Snapshots are only cut to the range of the batch: the join with its commits does the rest,
    so no shuffle has a repository alone for its key.

    ``options`` are those of :func:`reposift.operators.history.snapshot_changes`.
    """

    def extract(good: DataFrame, owners: tuple[str, str]) -> DataFrame:
        log, files = near_rows(commits, owners), near_rows(snapshots, owners)
        return file_history(log, files, extensions, repositories=good, **options)

    return _crawl(spark, store, "FILE_METADATA", commits, extract, failures, limit, token)


def recover(spark: SparkSession, store: str, live_tokens: Iterable[int | str] = ()) -> None:
    """Release the claims of turns that died; those of ``live_tokens`` stay."""
    live = list(live_tokens)
    apply_change(spark, store, lambda q: release_stale(q, live))


def drain(turn: Callable[[], bool], before: Callable[[], None] | None = None) -> int:
    """Repeat a crawl until it finds nothing to do; returns how many turns had work.

    ``before`` runs first: give :func:`recover` where a turn may have died after its claim.
    """
    if before is not None:
        before()
    turns = 0
    while turn():
        turns += 1
    return turns
