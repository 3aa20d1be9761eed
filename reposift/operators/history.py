"""Commit messages and file histories from commit and snapshot tables.

Commits are rows (owner, repo, commit_id, tree_id, commit_time_s, author, message), with an
optional ``error`` for commits that could not be read. Snapshots are rows (owner, repo,
commit_id, path, hash_code): every file of every commit's tree.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reposift.functions.paths import has_extension
from reposift.operators.ordering import GROUP_ROWS_PER_TASK, number_rows
from reposift.session import written_table

REPO = ["owner", "repo"]
OLDEST_FIRST = ("commit_time_s", "commit_id")

# Snapshots of one file that are compared in one window group.
SNAPSHOTS_PER_GROUP = 4096


def readable_commits(commits: DataFrame) -> DataFrame:
    """Commits without an error; failed ones vanish, as if they were not in the log."""
    if "error" not in commits.columns:
        return commits
    return commits.filter(F.col("error").isNull()).drop("error")


def scan_commits(
    commits: DataFrame,
    order: Sequence[str] = OLDEST_FIRST,
    max_group: int = GROUP_ROWS_PER_TASK,
) -> DataFrame:
    """Commit log with the ascending ``position`` of each commit in its repository.

    Give the log's own sequence column as ``order`` if there is one; commits of the same
    second have no order of their own otherwise.
    """
    return number_rows(readable_commits(commits), REPO, order, max_group).drop("group_rows")


def commit_messages(commits: DataFrame) -> DataFrame:
    """Message record of every readable commit."""
    return readable_commits(commits).select(
        F.col("owner").alias("repo_owner"),
        F.col("repo").alias("repository"),
        "tree_id",
        "author",
        "commit_id",
        F.col("commit_time_s").cast("long").alias("commit_time_s"),
        F.col("message").alias("long_message"),
    )


def snapshot_changes(
    commits: DataFrame,
    snapshots: DataFrame,
    order: Sequence[str] = OLDEST_FIRST,
    unique: bool = False,
    per_group: int = SNAPSHOTS_PER_GROUP,
    max_group: int = GROUP_ROWS_PER_TASK,
    repositories: DataFrame | None = None,
) -> DataFrame:
    """Changes from each snapshot of a repository to the next one in ascending order.

    The first snapshot is compared with nothing, so all its files are additions. A file that
    is listed twice in a snapshot counts once, with its largest hash; ``unique`` promises that
    neither table repeats a key and saves the work that looks for it. Copies of a file's row in one
    snapshot meet in the window of the file, so no shuffle of the files is spent on them alone.

    ``repositories`` (owner, repo) restricts the log, after repeated commits are merged, and by
    its join the files.

    Rows are grouped by file and by runs of ``per_group`` snapshots, so neither a giant
    repository nor a file with a giant history ends in one task. The last row of a run is
    copied to the next run, where it serves as the previous snapshot. The numbered log, which
    is small beside the snapshots, is written once and used twice.
    """
    order = list(order)
    log = readable_commits(commits).select(
        *REPO, "commit_id", "tree_id", "commit_time_s", *[c for c in order if c not in OLDEST_FIRST]
    )
    files = snapshots.filter(F.col("hash_code").isNotNull()).select(
        *REPO, "commit_id", "path", "hash_code"
    )
    if not unique:
        rest = [c for c in log.columns if c not in [*REPO, "commit_id"]]
        log = log.groupBy(*REPO, "commit_id").agg(*[F.min(c).alias(c) for c in rest])
    if repositories is not None:
        log = log.join(repositories.select(*REPO), REPO, "left_semi")
    log = written_table(number_rows(log, REPO, order, max_group), "log")

    # Only the position travels with the file rows; commit details are joined to the changes.
    position, last = F.col("position"), F.col("group_rows")
    run = F.expr(f"position div {per_group}")
    next_run = F.expr(f"(position + 1) div {per_group}")
    located = files.join(log.select(*REPO, "commit_id", "position", "group_rows"), [*REPO, "commit_id"])
    placed = located.select(
        *REPO,
        "path",
        "hash_code",
        "position",
        (position < last).alias("has_next"),
        F.explode(
            F.when((next_run > run) & (position < last), F.array(run, next_run)).otherwise(
                F.array(run)
            )
        ).alias("run"),
    )

    along = Window.partitionBy(*REPO, "path", "run").orderBy("position", "hash_code")
    if not unique:
        # Of exact copies, and of several hashes in one snapshot, the last is kept.
        following = F.lead("position").over(along)
        placed = placed.withColumn("following", following).filter(
            F.col("following").isNull() | (F.col("following") != position)
        )
    seen = placed.select(
        "*",
        F.lag("position").over(along).alias("prev_position"),
        F.lag("hash_code").over(along).alias("prev_hash"),
        F.lead("position").over(along).alias("next_position"),
    )
    at_home = F.col("run") == run
    next_here = F.col("run") == next_run
    in_previous = F.coalesce(F.col("prev_position") == position - 1, F.lit(False))
    added = at_home & ~in_previous
    modified = at_home & in_previous & (F.col("prev_hash") != F.col("hash_code"))
    in_next = F.coalesce(F.col("next_position") == position + 1, F.lit(False))
    deleted = F.col("has_next") & next_here & ~in_next

    path, new_hash, none = F.col("path"), F.col("hash_code"), F.lit(None).cast("string")

    def change(at, kind, old_path, new_path, old_hash, new_hash):
        return F.struct(
            at.alias("position"),
            F.lit(kind).alias("change_type"),
            old_path.alias("old_path"),
            new_path.alias("new_path"),
            old_hash.alias("old_hash"),
            new_hash.alias("new_hash"),
        )

    here = F.when(added, change(position, "ADD", none, path, none, new_hash)).when(
        modified, change(position, "MODIFY", path, path, F.col("prev_hash"), new_hash)
    )
    gone = F.when(deleted, change(position + 1, "DELETE", path, none, new_hash, none))
    changes = seen.filter(added | modified | deleted).select(
        *REPO, F.inline(F.array_compact(F.array(here, gone)))
    )
    return changes.join(log.drop("group_rows"), [*REPO, "position"]).select(
        *REPO,
        "commit_id",
        "tree_id",
        "commit_time_s",
        "change_type",
        "old_path",
        "new_path",
        "old_hash",
        "new_hash",
    )


def change_records(changes: DataFrame) -> DataFrame:
    """File-change records: a deletion gives its old path and no hash, all else the new ones."""
    deleted = F.col("change_type") == "DELETE"
    return changes.select(
        F.col("owner").alias("repo_owner"),
        F.col("repo").alias("repository"),
        "tree_id",
        F.when(deleted, F.col("old_path")).otherwise(F.col("new_path")).alias("git_path"),
        F.when(~deleted, F.col("new_hash")).alias("hash_code"),
        "commit_id",
        F.col("commit_time_s").cast("long").alias("commit_time_s"),
    )


def filter_extensions(
    files: DataFrame,
    extensions: str | Iterable[str],
    column: str = "path",
    case_sensitive: bool = False,
) -> DataFrame:
    """Files whose extension is in the set; an empty set keeps all."""
    return files.filter(has_extension(F.col(column), extensions, case_sensitive))


def file_history(
    commits: DataFrame,
    snapshots: DataFrame,
    extensions: str | Iterable[str] = (),
    case_sensitive: bool = False,
    **options,
) -> DataFrame:
    """File-change records of every repository, for the wanted extensions.

    A change concerns one path, so the extension filter runs before the comparison.
    ``options`` are those of :func:`snapshot_changes`.
    """
    wanted = filter_extensions(snapshots, extensions, "path", case_sensitive)
    return change_records(snapshot_changes(commits, wanted, **options))
