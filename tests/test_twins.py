"""Every query against its SQL twin on the smallest tables."""

import pytest

from songloom.plans import all_entries
from tests.conftest import SMALL
from tests.oracle import compare, connect

ENTRIES = all_entries()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if e.sql))
def test_twin(spark, con, name):
    _, differences = compare(ENTRIES[name].run(spark, SMALL), con, ENTRIES[name].sql)
    assert differences == []


@pytest.mark.parametrize("name", sorted(n for n, e in ENTRIES.items() if not e.sql))
def test_rows(spark, name):
    assert ENTRIES[name].run(spark, SMALL).count() > 0
