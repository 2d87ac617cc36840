"""Every registered query against its SQL on the smallest tables."""

from pathlib import Path

import pytest

from __spark_entry__ import entry, oracle_sql, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).is_dir(), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    from checks.compare_engines import duck

    return duck(SF)


@pytest.mark.parametrize("name", list(queries()))
def test_query(spark, con, name):
    from checks.compare_engines import compare_one

    good, text = compare_one(spark, con, queries()[name], oracle_sql().get(name), SF)
    assert good, text


def test_entry(spark):
    assert entry(spark).count() == 6
