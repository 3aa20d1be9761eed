"""The driver contract: every registered query against its SQL, on the smallest tables."""

from pathlib import Path

import pytest

import __spark_entry__ as contract
from checks.compare import database, differences
from checks.oracles import ORACLES
from checks.queries import QUERIES
from reposift import samples
from tests.conftest import rows

DATA = contract.FLAGSHIP_DATA

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def connection():
    with database(DATA) as opened:
        yield opened


def test_every_sql_belongs_to_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


def test_every_core_query_has_sql():
    assert set(ORACLES) == set(QUERIES)


def test_every_event_is_an_attempt(spark):
    assert samples.attempts(spark, DATA).count() == samples.table(spark, DATA, "events").count()


def test_flagship(spark):
    assert rows(contract.entry(spark)) == [("PENDING", 375)]


def test_patterns_without_case_find_all_passing_errors(spark):
    found = rows(QUERIES["like_any_ignoring_case"](spark, DATA))
    assert found == rows(QUERIES["like_any"](spark, DATA)) and len({r[2] for r in found}) == 13


@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query(spark, connection, name):
    assert differences(spark, name, DATA, connection) is None
