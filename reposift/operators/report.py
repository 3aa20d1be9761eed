"""Progress report over the work queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift.functions.status import (
    error_bucket,
    is_failed,
    is_in_progress,
    queue_status,
)


def _count() -> Column:
    return F.count(F.lit(1)).alias("count")


def status_counts(queue: DataFrame) -> DataFrame:
    """Rows per status."""
    return queue.groupBy(queue_status().alias("status")).agg(_count())


def progress_by_token(queue: DataFrame) -> DataFrame:
    """Rows in progress per claim token."""
    return queue.filter(is_in_progress()).groupBy("checkout_id").agg(_count())


def error_counts(queue: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Failed rows per error bucket."""
    bucket = error_bucket(F.col("result"), ignore_case).alias("bucket")
    return queue.filter(is_failed()).groupBy(bucket).agg(_count())


def details(
    status: Column,
    result: Column | None = None,
    checkout_id: Column | None = None,
    ignore_case: bool = False,
) -> Column:
    """What the report tells rows of one status apart by: the claim's token or the error bucket."""
    result = F.col("result") if result is None else result
    checkout_id = F.col("checkout_id") if checkout_id is None else checkout_id
    return (
        F.when(status == "IN_PROGRESS", checkout_id)
        .when(status == "ERROR", error_bucket(result, ignore_case))
        .otherwise("")
    )


def queue_report(queue: DataFrame, time: str, ignore_case: bool = False) -> DataFrame:
    """One report of (section, status, details, count).

    Section 0 is a header row that carries ``time``, 1 the rows per status, 2 the rows in
    progress per token, 3 the failed rows per error bucket. The queue is read once: rows are
    counted by status and detail, and those counts give all sections.
    """
    status = queue_status()
    detail = details(status, ignore_case=ignore_case)
    counted = queue.groupBy(status.alias("status"), detail.alias("details")).agg(_count())
    return report_of_counts(counted, time)


def report_of_counts(counted: DataFrame, time: str) -> DataFrame:
    """The report from rows per status and details (see :func:`queue_report`)."""

    def row(section: int, details: Column) -> Column:
        return F.struct(F.lit(section).alias("section"), details.alias("details"))

    total = row(1, F.lit(""))
    of_detail = F.when(F.col("status") == "IN_PROGRESS", row(2, F.col("details"))).when(
        F.col("status") == "ERROR", row(3, F.col("details"))
    )
    sections = (
        counted.select(
            "status", "count", F.explode(F.array_compact(F.array(total, of_detail))).alias("to")
        )
        .groupBy("to.section", "status", "to.details")
        .agg(F.sum("count").alias("count"))
    )
    header = counted.sparkSession.createDataFrame(
        [(0, "TIME", time, 0)], "section int, status string, details string, count long"
    )
    return header.unionByName(sections)


def in_report_order(report: DataFrame) -> DataFrame:
    """Sections in turn; within one the largest count first, then status and details."""
    return report.orderBy("section", F.desc("count"), "status", "details")
