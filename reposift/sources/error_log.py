"""Log of errors that do not put a repository out of the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from reposift.functions.status import error_text
from reposift.sources.folders import complete_versions, write_version

ERROR_LOG = StructType(
    [
        StructField("owner", StringType()),
        StructField("repo", StringType()),
        StructField("error", StringType()),
        StructField("run", LongType()),
    ]
)


def log_errors(errors: DataFrame, store: str, run: int) -> None:
    """Keep the errors (owner, repo, error) of a run; doing it again replaces them."""
    records = errors.select("owner", "repo", error_text(F.col("error")).alias("error"))
    write_version(records, f"{store}/errors", "run", run)


def read_error_log(spark: SparkSession, store: str) -> DataFrame:
    """Errors of all complete runs with their ``run``."""
    folder = f"{store}/errors"
    runs = complete_versions(spark, folder, "run")
    if not runs:
        return spark.createDataFrame([], ERROR_LOG)
    reader = spark.read.schema(ERROR_LOG).option("basePath", folder)
    return reader.parquet(*[f"{folder}/run={run}" for run in runs])


def log_misses(hashes: DataFrame, store: str, run: int) -> None:
    """Keep the hashes (hash_code) that a run looked up in vain."""
    error = F.concat(F.lit("missing object "), "hash_code").alias("error")
    write_version(hashes.select("hash_code", error), f"{store}/misses", "run", run)


def read_misses(spark: SparkSession, store: str) -> DataFrame:
    """Missing hashes of all complete runs with their ``error`` and ``run``."""
    folder = f"{store}/misses"
    runs = complete_versions(spark, folder, "run")
    schema = "hash_code string, error string, run long"
    if not runs:
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema).option("basePath", folder)
    return reader.parquet(*[f"{folder}/run={run}" for run in runs])
