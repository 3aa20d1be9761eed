"""Table schemas. Times carry their unit in the name: ``_ms`` milliseconds, ``_s`` seconds."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    BooleanType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _columns(*columns: tuple[str, type]) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in columns])


PROJECT = _columns(
    ("owner", StringType),
    ("repo", StringType),
    ("lang_id", IntegerType),
    ("is_deleted", BooleanType),
    ("is_forked", BooleanType),
    ("created_ms", LongType),
)

QUEUE = _columns(
    ("owner", StringType),
    ("repo", StringType),
    ("checkout_id", StringType),
    ("result", StringType),
    ("completed", BooleanType),
)
QUEUE_KEY = ["owner", "repo"]

COMMIT_MESSAGE = _columns(
    ("repo_owner", StringType),
    ("repository", StringType),
    ("tree_id", StringType),
    ("author", StringType),
    ("commit_id", StringType),
    ("commit_time_s", LongType),
    ("long_message", StringType),
)

FILE_CHANGE = _columns(
    ("repo_owner", StringType),
    ("repository", StringType),
    ("tree_id", StringType),
    ("git_path", StringType),
    ("hash_code", StringType),
    ("commit_id", StringType),
    ("commit_time_s", LongType),
)

HASH = _columns(("hash_code", StringType))

CONTENT = _columns(("hash_code", StringType), ("contents", StringType))


@dataclass(frozen=True)
class Split:
    """A stored dataset.

    ``schema`` is what its readers see, ``key`` what makes a row unique, and ``stored`` all
    columns its runs hold.
    """

    schema: StructType
    key: tuple[str, ...]
    stored: StructType

    @property
    def columns(self) -> list[str]:
        return self.schema.fieldNames()


SPLITS: dict[str, Split] = {
    "FILE_METADATA": Split(
        _columns(
            ("repo_owner", StringType),
            ("repository", StringType),
            ("git_path", StringType),
            ("hash_code", StringType),
            ("commit_time_s", LongType),
            ("commit_id", StringType),
        ),
        ("repo_owner", "repository", "git_path", "hash_code", "commit_id"),
        FILE_CHANGE,
    ),
    "COMMIT_MESSAGES": Split(
        _columns(
            ("commit_id", StringType),
            ("author", StringType),
            ("long_message", StringType),
        ),
        ("commit_id",),
        COMMIT_MESSAGE,
    ),
    "INDEX": Split(HASH, ("hash_code",), HASH),
    "CONTENTS": Split(CONTENT, ("hash_code",), CONTENT),
}


def split_named(name: str) -> Split:
    if name not in SPLITS:
        raise ValueError(f"unknown split {name!r}; known are {', '.join(SPLITS)}")
    return SPLITS[name]
