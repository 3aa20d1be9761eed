"""From the project list to the work queue."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession

from reposift.operators.projects import (
    DEFAULT_FILTERS,
    apply_project_filters,
    parse_projects,
    project_pairs,
)
from reposift.operators.queue import load_queue
from reposift.sources.files import scan_project_lines
from reposift.sources.queue_table import change_queue, publish_queue


def pairs_of_lines(
    lines: DataFrame,
    filters: str | Iterable[str] = DEFAULT_FILTERS,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Distinct (owner, repo) pairs of the lines that parse and pass the filters."""
    return project_pairs(apply_project_filters(parse_projects(lines, languages), filters))


def load_project_queue(
    spark: SparkSession,
    path: str,
    store: str,
    filters: str | Iterable[str] = DEFAULT_FILTERS,
    languages: Sequence[str] | None = None,
    merge: bool = False,
    ignore_case: bool = False,
) -> DataFrame:
    """Load the queue of a store from a project list and return it.

    The queue is replaced, or with ``merge`` only the pairs it lacks are added.
    """
    pairs = pairs_of_lines(scan_project_lines(spark, path), filters, languages)
    if merge:
        return change_queue(spark, store, lambda queue: load_queue(pairs, queue, ignore_case))
    return publish_queue(load_queue(pairs, None, ignore_case), store)
