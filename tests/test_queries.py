"""Every registered query equals its SQL on the smallest data set."""

from __future__ import annotations

from pathlib import Path

import pytest

from ledgerline.plans import catalog
from tests import oracle

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.CHECKS))
def test_query_equals_sql(spark, con, name):
    assert oracle.compare(spark, con, catalog.QUERIES[name], catalog.CHECKS[name], SF) == ""


def test_every_query_has_checking_sql():
    assert set(catalog.QUERIES) == set(catalog.CHECKS)


def test_entry_points(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
