"""Contents of the files found by the file history.

The meaning is ours: of the hashes in FILE_METADATA, those that INDEX lacks are looked up,
and what is found goes to CONTENTS and INDEX.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reposift.operators.contents import found_contents, missing_contents, new_hashes
from reposift.operators.history import filter_extensions
from reposift.session import passing_tables, run_token, written_table
from reposift.sources.error_log import log_misses, read_misses
from reposift.sources.run_store import existing_hashes, new_run, read_runs, store_records


def wanted_hashes(
    spark: SparkSession, store: str, extensions: str | Iterable[str] = "js,coffee,ts"
) -> DataFrame:
    """Distinct hashes of the file history that are neither stored nor known to be missing."""
    files = read_runs(spark, store, "FILE_METADATA").filter(F.col("hash_code").isNotNull())
    wanted = filter_extensions(files, extensions, "git_path").select("hash_code").distinct()
    known = existing_hashes(spark, store).unionByName(read_misses(spark, store).select("hash_code"))
    return new_hashes(wanted, known)


def crawl_file_contents(
    spark: SparkSession,
    store: str,
    contents: DataFrame,
    extensions: str | Iterable[str] = "js,coffee,ts",
    token: int | None = None,
) -> bool:
    """Store the contents of all wanted hashes; false if there were none.

    Hashes without content go to the log of misses, and are not wanted again.
    CONTENTS is written first and INDEX is taken from it, so a crash in between means that
    the same contents are fetched again, never that an index entry lacks its content.
    """
    token = run_token() if token is None else token
    new_run(spark, store, ["CONTENTS", "INDEX"], token)
    with passing_tables(spark):
        wanted = written_table(wanted_hashes(spark, store, extensions), "wanted")
        if wanted.isEmpty():
            return False
        store_records(found_contents(wanted, contents), store, "CONTENTS", token)
        stored = read_runs(spark, store, "CONTENTS", [token]).select("hash_code").distinct()
        store_records(stored, store, "INDEX", token)
        log_misses(missing_contents(wanted, stored), store, token)
    return True
