"""Every query over the supplied tables against its SQL."""

from __future__ import annotations

import pytest

from talkweave.plans import registry
from tests.compare import database, differences


@pytest.fixture(scope="module")
def con(small):
    return database(small)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_sql(spark, small, con, name):
    found = registry.QUERIES[name](spark, small)
    if name in registry.ORACLES:
        assert not differences(found, con, registry.ORACLES[name])
    else:
        assert found.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.ORACLES) <= set(registry.QUERIES)
