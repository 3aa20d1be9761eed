"""Text lines and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_project_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the project list as column ``value``, one record per line."""
    return spark.read.text(path)


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All visible files below ``root``: path, length, modification time.

    The contents are not read. Names that start with ``.`` are hidden; Spark also hides
    those that start with ``_``.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return files.select("path", "length", "modificationTime")
