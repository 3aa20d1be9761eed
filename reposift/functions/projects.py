"""Expressions over the fields of a project line.

Each gives null where the field cannot be used, so one bad row never fails a job, also
when ANSI mode is on.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# What the project list contains.
URL_PREFIX_LENGTH = 29  # length of "https://api.github.com/repos/"
LANGUAGE_IDS = {"JavaScript": 0, "TypeScript": 1, "CoffeeScript": 2}
NULL_MARK = "\\N"

# One RFC 4180 record: fields are quoted (a quote inside is doubled, blanks may follow the
# closing quote), bare, or empty. Possessive quantifiers keep the match linear.
_FIELD = r'(?:"[^"]*+(?:""[^"]*+)*+"\s*+|[^",][^,]*+|)'
STRICT_RECORD = rf"^{_FIELD}(?:,{_FIELD})*+\z"

# Spark's CSV parser fails on more than 20,480 columns, so it gets the ten leading ones of every
# line. Later columns are not used.
_LEADING_FIELDS = rf"^{_FIELD}(?:,{_FIELD}){{0,9}}+"

_INTEGER = r"^[+-]?[0-9]+\z"
_DATE_TIME = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"


def leading_fields(line: Column) -> Column:
    """The first ten fields of a record."""
    return F.regexp_extract(line, _LEADING_FIELDS, 0)


def trim_controls(text: Column) -> Column:
    """Strip blanks and control characters (all up to U+0020) from both ends."""
    return F.btrim(text, F.lit("".join(map(chr, range(0x21)))))


def _url_rest(url: Column) -> Column:
    return F.substring(url, URL_PREFIX_LENGTH + 1, 2**31 - 1)


def _name(text: Column) -> Column:
    return F.nullif(trim_controls(text), F.lit(""))


def url_owner(url: Column) -> Column:
    """Owner named by a repository url, null if it names none."""
    return _name(F.substring_index(_url_rest(url), "/", 1))


def url_repo(url: Column) -> Column:
    """Repository named by a url; what follows its name is ignored."""
    rest = _url_rest(url)
    second = F.substring_index(F.substring_index(rest, "/", 2), "/", -1)
    return F.when(rest.contains("/"), _name(second))


def language_id(language: Column, languages: Iterable[str] | None = None) -> Column:
    """Number of a language name, exact and case-sensitive; null if not in ``languages``."""
    wanted = LANGUAGE_IDS if languages is None else languages
    unknown = set(wanted) - set(LANGUAGE_IDS)
    if unknown:
        raise ValueError(f"unknown languages: {', '.join(sorted(unknown))}")
    found = F.lit(None).cast("int")
    for name in wanted:
        found = F.when(language == name, F.lit(LANGUAGE_IDS[name])).otherwise(found)
    return found


def deleted_flag(deleted: Column) -> Column:
    """True for the integer 1, false for any other integer, null for other text."""
    integer = F.when(deleted.rlike(_INTEGER), deleted.try_cast("int"))
    return F.when(deleted == "0", False).when(deleted == "1", True).otherwise(integer == 1)


def forked_flag(forked_from: Column) -> Column:
    """Forked is whatever is not the null mark; so is an empty field."""
    return F.coalesce(forked_from, F.lit("")) != NULL_MARK


def created_ms(created_at: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` in UTC as epoch milliseconds, whatever the session's zone."""
    instant = F.concat(created_at, F.lit("Z")).try_cast("timestamp")
    return F.when(created_at.rlike(_DATE_TIME), F.unix_millis(instant))
