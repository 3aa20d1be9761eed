"""Project list: parse its lines, filter projects, reduce them to (owner, repo) pairs."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reposift.functions import projects as fields
from reposift.operators.ordering import first_rows
from reposift.schemas import PROJECT

LINE_FIELDS = (
    "id",
    "url",
    "owner_id",
    "name",
    "description",
    "language",
    "created_at",
    "forked_from",
    "deleted",
    "updated_at",
)
_LINE_SCHEMA = ", ".join(f"{name} string" for name in LINE_FIELDS)
_CSV_OPTIONS = {"quote": '"', "escape": '"'}

DEFAULT_FILTERS = "filterDeleted,filterForked"


def _fields_of(line: Column) -> Column:
    return F.from_csv(fields.leading_fields(line), _LINE_SCHEMA, _CSV_OPTIONS)


def split_lines(lines: DataFrame) -> DataFrame:
    """Fields of every line of column ``value``, next to the line; no line is dropped.

    A line that is not a CSV record has nulls for fields, however long it is.
    """
    return _split(lines, F.col("value").rlike(fields.STRICT_RECORD))


def _split(lines: DataFrame, strict: Column | None = None) -> DataFrame:
    """``inline`` keeps Catalyst from copying ``from_csv`` into each later filter."""
    record = _fields_of(F.col("value"))
    record = record if strict is None else F.when(strict, record)
    return lines.select("value", F.inline(F.array(record)))


def _record(languages: Iterable[str] | None) -> dict[str, Column]:
    return {
        "owner": fields.url_owner(F.col("url")),
        "repo": fields.url_repo(F.col("url")),
        "lang_id": fields.language_id(F.col("language"), languages),
        "is_deleted": fields.deleted_flag(F.col("deleted")),
        "is_forked": fields.forked_flag(F.col("forked_from")),
        "created_ms": fields.created_ms(F.col("created_at")),
    }


def parse_projects(lines: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """Typed project records of the lines that parse; any failure drops the line.

    A line without the text of a wanted language cannot survive, so that cheap test runs
    before the record is matched and split.
    """
    wanted = list(fields.LANGUAGE_IDS if languages is None else languages)
    names_language = F.lit(False)
    for language in wanted:
        names_language = names_language | F.col("value").contains(language)
    strict = lines.filter(names_language & F.col("value").rlike(fields.STRICT_RECORD))
    record = _record(wanted)
    # The record is built in a generator too, so the null test does not evaluate it again.
    row = F.struct(*[value.alias(name) for name, value in record.items()])
    parsed = _split(strict).select(F.inline(F.array(row)))
    return parsed.dropna(subset=PROJECT.fieldNames())


def rejected_lines(lines: DataFrame, languages: Sequence[str] | None = None) -> DataFrame:
    """The lines that :func:`parse_projects` drops, each with the first reason found."""
    record = _record(languages)
    checks = {
        "not a CSV record": F.col("value").rlike(fields.STRICT_RECORD),
        "no owner and repository in the url": record["owner"].isNotNull()
        & record["repo"].isNotNull(),
        "language not wanted": record["lang_id"].isNotNull(),
        "deleted is not an integer": record["is_deleted"].isNotNull(),
        "created_at is not a date": record["created_ms"].isNotNull(),
    }
    error = F.lit(None).cast("string")
    for reason, passed in reversed(list(checks.items())):
        error = F.when(~passed, F.lit(reason)).otherwise(error)
    judged = split_lines(lines).select("value", error.alias("error"))
    return judged.filter(F.col("error").isNotNull())


def filter_deleted(projects: DataFrame) -> DataFrame:
    return projects.filter(~F.col("is_deleted"))


def filter_forked(projects: DataFrame) -> DataFrame:
    return projects.filter(~F.col("is_forked"))


def filter_top_n(projects: DataFrame, n: int, order: Sequence[str] | None = None) -> DataFrame:
    """At most ``n`` projects: the first by ``order``, by default all columns."""
    return first_rows(projects, n, order or projects.columns)


def filter_names(filters: str | Iterable[str]) -> list[str]:
    names = filters.split(",") if isinstance(filters, str) else filters
    return [name.strip() for name in names]


def top_n_of(filters: str | Iterable[str]) -> int | None:
    """The n of the first well-formed ``filterTop<n>``; malformed ones are ignored."""
    for name in filter_names(filters):
        number = re.fullmatch(r"filterTop([+-]?[0-9]+)", name)
        if number and -(2**31) <= int(number[1]) < 2**31:
            return int(number[1])
    return None


def apply_project_filters(
    projects: DataFrame, filters: str | Iterable[str] = DEFAULT_FILTERS
) -> DataFrame:
    """Apply filters by name, always in the order deleted, forked, top."""
    names = filter_names(filters)
    if "filterDeleted" in names:
        projects = filter_deleted(projects)
    if "filterForked" in names:
        projects = filter_forked(projects)
    n = top_n_of(names)
    return projects if n is None else filter_top_n(projects, n)


def project_pairs(projects: DataFrame) -> DataFrame:
    """Distinct (owner, repo) pairs."""
    return projects.select("owner", "repo").distinct()
