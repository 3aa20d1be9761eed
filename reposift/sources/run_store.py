"""Results of many runs as Parquet: ``<store>/data/split=<name>/run=<token>/``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructType

from reposift.operators.contents import dedup, dedup_latest
from reposift.schemas import SPLITS, split_named
from reposift.session import passing_tables, run_token, written_table
from reposift.sources.folders import (
    complete_versions,
    delete,
    size_of,
    write_version,
    write_version_in_parts,
)

# Fixed value: rows of a bitmap of Spark's bitmap functions.
CHUNK = 32_768

# Bitmaps that are sent to every executor at once, 4 KB each.
SENT_BITMAPS = 16_384


def _split_folder(store: str, split: str) -> str:
    return f"{store}/data/split={split}"


def list_runs(spark: SparkSession, store: str, split: str) -> list[int]:
    """Tokens of the complete runs of a split, ascending."""
    split_named(split)
    return complete_versions(spark, _split_folder(store, split), "run")


def new_run(spark: SparkSession, store: str, splits: Iterable[str], run: int) -> None:
    """Fail if one of the splits has a complete run with this token."""
    for split in splits:
        if run in list_runs(spark, store, split):
            raise ValueError(f"run {run} of {split} exists")


def store_records(
    records: DataFrame, store: str, split: str, run: int, replace: bool = False
) -> None:
    """Write a dataset as one run of a split.

    A complete run is replaced only if ``replace`` says so; the rest of a failed write always is.
    """
    if not replace:
        new_run(records.sparkSession, store, [split], run)
    absent = set(split_named(split).columns) - set(records.columns)
    if absent:
        raise ValueError(f"{split} needs the columns {', '.join(sorted(absent))}")
    known = [c for c in split_named(split).stored.fieldNames() if c in records.columns]
    write_version(records.select(*known), _split_folder(store, split), "run", run)


def read_runs(
    spark: SparkSession,
    store: str,
    split: str,
    runs: Iterable[int] | None = None,
    all_columns: bool = False,
) -> DataFrame:
    """Rows of all complete runs, or of the given ones, with their ``run``.

    Nothing is deduplicated, and a filter on ``run`` prunes folders. ``all_columns`` gives
    every stored column instead of the split's view.
    """
    meta = split_named(split)
    fields = (meta.stored if all_columns else meta.schema).fields
    schema = StructType(list(fields)).add("run", LongType())
    runs = list_runs(spark, store, split) if runs is None else list(runs)
    if not runs:
        return spark.createDataFrame([], schema)
    folder = _split_folder(store, split)
    reader = spark.read.schema(schema).option("basePath", folder)
    return reader.parquet(*[f"{folder}/run={run}" for run in runs])


def read_split(
    spark: SparkSession,
    store: str,
    split: str,
    runs: Iterable[int] | None = None,
    latest: bool = False,
) -> DataFrame:
    """One view of a split over its runs, one row per key.

    Any of several rows survives; with ``latest`` it is the one of the latest run.
    """
    return _one_per_key(read_runs(spark, store, split, runs), split, latest)


def _one_per_key(rows: DataFrame, split: str, latest: bool) -> DataFrame:
    key = split_named(split).key
    if latest:
        return dedup_latest(rows, key, "run").drop("run")
    return dedup(rows.drop("run"), key)


def existing_hashes(spark: SparkSession, store: str) -> DataFrame:
    """Hashes whose content is stored; none if there is no store yet."""
    return read_split(spark, store, "INDEX").select("hash_code")


def consolidate(
    spark: SparkSession,
    store: str,
    splits: Iterable[str] = tuple(SPLITS),
    run: int | None = None,
    latest: bool = False,
    tier: float | None = None,
) -> int:
    """Merge all runs of the given splits in one run without duplicates; returns its token.

    Which of several rows of a key stays is decided by keys and addresses alone; then every file is
    read once and the rows that stay are written from where they lie. Nothing but keys is
    shuffled, however wide the rows are. It is a row of the latest run with ``latest``, else of the
    first; of several in one run it is the last, or the first, by file and place.

    With ``tier``, a run that takes at least so many times the bytes of all others together stays
    where it is, if it has no duplicates: the others are merged in one run without the keys that
    it has, so a small run costs no more than its own rows and the keys of the store. As runs
    come, the second tier grows until all are merged.

    The runs are listed before they are read, so a run that is added meanwhile stays. The old
    ones go only after the new one is complete; a crash in between leaves duplicates, which
    every reader removes.
    """
    run = run_token() if run is None else run
    for split in splits:
        old = list_runs(spark, store, split)
        if run in old:
            raise ValueError(f"run {run} of {split} exists")
        if not old:
            continue
        rows = read_runs(spark, store, split, old, all_columns=True)
        folder = _split_folder(store, split)
        large = None if tier is None or latest else _large_run(spark, folder, old, tier)
        with passing_tables(spark):
            kept = written_table(kept_rows(rows, split_named(split).key, latest, large), "kept")
            if large is not None:
                own = F.col("file").contains(f"/run={large}/")
                unique = kept.filter(own).agg(F.sum(F.bitmap_count("bits"))).first()[0]
                if unique == rows.filter(F.col("run") == large).count():
                    old.remove(large)
                    rows, kept = rows.filter(F.col("run") != large), kept.filter(~own)
            parts = -(-kept.count() // SENT_BITMAPS)
            if parts == 1:
                write_version(rows_kept(rows, kept).drop("run"), folder, "run", run)
            elif parts:
                pieces = (rows_kept(rows, kept, part, parts).drop("run") for part in range(parts))
                write_version_in_parts(pieces, folder, "run", run)
        for token in old:
            delete(spark, f"{folder}/run={token}")
    return run


def _large_run(spark: SparkSession, folder: str, runs: list[int], tier: float) -> int | None:
    """The run that takes ``tier`` times the bytes of the others, if there is one."""
    sizes = {run: size_of(spark, f"{folder}/run={run}") for run in runs}
    largest = max(runs, key=sizes.get)
    rest = sum(sizes.values()) - sizes[largest]
    return largest if len(runs) > 1 and sizes[largest] >= tier * rest else None


def kept_rows(
    rows: DataFrame, key: Sequence[str], latest: bool, first: int | None = None
) -> DataFrame:
    """Addresses of one row per key of stored rows, as bitmaps: ``file``, ``chunk``, ``bits``.

    It is a row of the latest run, else one of the run ``first``, else one of the earliest run. Only the keys are read, and aggregated before they are shuffled; :data:`CHUNK` rows take 4 KB.
    """
    at = F.struct(
        (F.lit(first) != F.col("run")).alias("other") if first is not None else F.lit(False).alias("other"),
        "run",
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    bit = F.bitmap_bit_position(F.col("at.row") % CHUNK + 1)
    return (
        rows.select(*key, at.alias("at"))
        .groupBy(*key)
        .agg((F.max if latest else F.min)("at").alias("at"))
        .groupBy(F.col("at.file").alias("file"), F.floor(F.col("at.row") / CHUNK).alias("chunk"))
        .agg(F.bitmap_construct_agg(bit).alias("bits"))
    )


def rows_kept(rows: DataFrame, kept: DataFrame, part: int = 0, parts: int = 1) -> DataFrame:
    """The stored rows whose address is in ``kept``, or one of several parts of them, by file.

    The bitmaps of a part are sent to the tasks that read its files: :data:`SENT_BITMAPS` or so, 64 MB.
    """
    file, row = F.col("_metadata.file_path"), F.col("_metadata.row_index")
    if parts > 1:
        rows = rows.filter(F.pmod(F.xxhash64(file), F.lit(parts)) == part)
        kept = kept.filter(F.pmod(F.xxhash64("file"), F.lit(parts)) == part)
    byte = F.expr("conv(hex(substring(bits, cast(_row % 32768 div 8 as int) + 1, 1)), 16, 10)").cast("int")
    is_kept = F.call_function("shiftright", byte, F.expr("cast(_row % 8 as int)")).bitwiseAND(F.lit(1)) == 1
    placed = rows.select("*", file.alias("_file"), row.alias("_row"))
    same = (F.col("_file") == F.col("file")) & (F.floor(F.col("_row") / CHUNK) == F.col("chunk"))
    return placed.join(F.broadcast(kept), same).filter(is_kept).select(*rows.columns)
