"""Feed new project-list files to the work queue as they arrive."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from reposift.operators.projects import DEFAULT_FILTERS, top_n_of
from reposift.operators.queue import load_queue
from reposift.plans.project_load import pairs_of_lines
from reposift.session import sized
from reposift.sources.queue_table import change_queue, queue_version


def add_lines(
    lines: DataFrame,
    store: str,
    batch: tuple[str, int],
    filters: str | Iterable[str] = DEFAULT_FILTERS,
    languages: Sequence[str] | None = None,
) -> DataFrame:
    """Add the pairs of one batch of lines, a source and a number, unless the ledger knows it."""
    spark, pairs = lines.sparkSession, pairs_of_lines(lines, filters, languages)

    def loaded(queue: DataFrame) -> DataFrame:
        rows = sum(r.rows for r in queue_version(spark, store).ranges)
        return load_queue(pairs, sized(queue, rows))

    return change_queue(spark, store, loaded, batch=batch)


def ingest_project_lines(
    spark: SparkSession,
    path: str,
    store: str,
    checkpoint: str,
    filters: str | Iterable[str] = DEFAULT_FILTERS,
    languages: Sequence[str] | None = None,
    max_files_per_batch: int | None = None,
) -> StreamingQuery:
    """Add the pairs of all files below ``path`` that the checkpoint does not know yet, then end.

    Each micro-batch inserts the pairs the stored queue lacks, and its number goes to the ledger
    of the queue with them, under the name of the checkpoint: one that is replayed after a
    failure is not applied again. Claims and marks that others make meanwhile stay. No state grows
    with the stream.
    """
    if top_n_of(filters) is not None:
        raise ValueError("a limit over all projects has no meaning for a stream")
    reader = spark.readStream.format("text")
    if max_files_per_batch is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_batch)

    def add(lines: DataFrame, batch_id: int) -> None:
        add_lines(lines, store, (checkpoint, batch_id), filters, languages)

    return (
        reader.load(path)
        .writeStream.foreachBatch(add)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
