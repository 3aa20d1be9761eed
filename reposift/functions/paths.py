"""Expressions over file and checkout paths."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_extension(path: Column) -> Column:
    """Text after the last dot of the last path part; empty if that part has no dot."""
    name = F.substring_index(F.rtrim(path, F.lit("/")), "/", -1)
    return F.when(name.contains("."), F.substring_index(name, ".", -1)).otherwise("")


def _checkout_part(path: Column, position: int) -> Column:
    parts = F.split(F.rtrim(path, F.lit("/")), "/+")
    return F.nullif(F.try_element_at(parts, F.lit(position)), F.lit(""))


def checkout_owner(path: Column) -> Column:
    """Owner of a checked-out repository: its folder is ``…/<owner>/<repo>``."""
    return _checkout_part(path, -2)


def checkout_repo(path: Column) -> Column:
    return _checkout_part(path, -1)


def extension_set(extensions: str | Iterable[str]) -> list[str]:
    """Extensions from a comma-separated text or a list, trimmed; empty ones do not count."""
    given = extensions.split(",") if isinstance(extensions, str) else extensions
    return sorted({e.strip() for e in given} - {""})


def has_extension(
    path: Column, extensions: str | Iterable[str], case_sensitive: bool = False
) -> Column:
    """True if the path's extension is in the set; an empty set accepts every path.

    ``case_sensitive`` lower-cases the set only, so that ``A.JS`` is refused.
    """
    wanted = [e.lower() for e in extension_set(extensions)]
    if not wanted:
        return F.lit(True)
    extension = file_extension(path)
    return (extension if case_sensitive else F.lower(extension)).isin(wanted)
