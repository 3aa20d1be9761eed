"""Lookups by object hash, and deduplication by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup_contents(hashes: DataFrame, contents: DataFrame) -> DataFrame:
    """Content of each requested ``hash_code``; an unknown hash has an ``error`` instead.

    ``contents`` has one row per hash. A hash that is requested many times is on the side
    that Spark can split when a partition is skewed.
    """
    stored = contents.select("hash_code", "contents", F.lit(True).alias("_found"))
    error = F.when(F.col("_found").isNull(), F.concat(F.lit("missing object "), "hash_code"))
    return (
        hashes.select("hash_code")
        .join(stored, "hash_code", "left")
        .select("hash_code", "contents", error.alias("error"))
    )


def found_contents(hashes: DataFrame, contents: DataFrame) -> DataFrame:
    """Only the hits of :func:`lookup_contents`."""
    return hashes.select("hash_code").join(contents.select("hash_code", "contents"), "hash_code")


def missing_contents(hashes: DataFrame, contents: DataFrame) -> DataFrame:
    """Only the requested hashes that are unknown."""
    return hashes.select("hash_code").join(contents.select("hash_code"), "hash_code", "left_anti")


def new_hashes(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose ``hash_code`` is not stored yet."""
    return rows.join(stored.select("hash_code"), "hash_code", "left_anti")


def dedup(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """One row per key, any of them."""
    return df.dropDuplicates(list(key))


def dedup_latest(df: DataFrame, key: Sequence[str], version: str) -> DataFrame:
    """One row per key: the one of the highest ``version``, so the survivor is always the same.

    Rows that tie are settled by their other columns.
    """
    values = [c for c in df.columns if c not in [*key, version]]
    latest = F.max(F.struct(version, *values)).alias("latest")
    return df.groupBy(*key).agg(latest).select(*key, "latest.*").select(*df.columns)
