"""Session helpers: a local session for tests, and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

from reposift.sources.folders import delete


def local_session(cores: int | str = "*", memory: str = "8g", **conf: str) -> SparkSession:
    """A single-JVM session for tests and benchmarks. Clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("reposift")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def run_token() -> int:
    """Identifier of a run or a claim: epoch milliseconds, taken once on the driver."""
    return int(time.time() * 1000)


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only a local master, where driver and executors are one process, may fall back on a
    temporary folder of the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    application = spark.sparkContext.applicationId
    if configured:
        return f"{configured.rstrip('/')}/reposift/{application}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="reposift-")
    return _local_dirs[application]


# Rows of keys that a join may send to every executor: about 10 MB, Spark's own limit.
SENT_ROWS = 100_000

_scope: ContextVar[str | None] = ContextVar("scope", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    """Path of a folder below the shared one that nobody else uses."""
    return f"{_scope.get() or shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextmanager
def passing_tables(spark: SparkSession) -> Iterator[None]:
    """Remove at the end what :func:`written_table` wrote inside.

    Results that are lazy must be stored inside too.
    """
    folder = new_folder(spark, "passing")
    outer = _scope.set(folder)
    try:
        yield
    finally:
        _scope.reset(outer)
        delete(spark, folder)


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, pins values that depend on partitioning, survives the loss of
    executors, and gives the planner the true size of the table.
    """
    path = new_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sized(keys: DataFrame, rows: int | None = None) -> DataFrame:
    """``keys``, a table of narrow rows, for one side of a join.

    Spark judges by the bytes of the files whether a table may be sent to every executor, and
    sorted names take a fiftieth of their rows' memory there. So the rows decide, which are counted
    unless they are given: beyond :data:`SENT_ROWS` both sides are shuffled and sorted, and
    nothing passes through the driver.
    """
    rows = keys.count() if rows is None else rows
    return keys.hint("merge") if rows > SENT_ROWS else keys
