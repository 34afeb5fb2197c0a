"""Every query of the engine's own operators against its SQL, on the smallest tables."""

import compare
import pytest

from moru.plans import catalogue, drift

ORACLES = catalogue.ORACLES | drift.ORACLES
QUERIES = {k: f for k, f in (catalogue.QUERIES | drift.QUERIES).items() if k in ORACLES}  # the others are in test_plain.py


@pytest.fixture(scope="module")
def con(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, con, name):
    assert compare.differences(spark, QUERIES[name], ORACLES[name], sf, con) == ""


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
