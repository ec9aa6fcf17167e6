"""Every registered job against its SQL check on the smallest data."""

import pytest
from oracle import CHECKS, JOBS, compare, duck


@pytest.fixture(scope="module")
def con():
    return duck("sf0.001")


@pytest.mark.parametrize("name", list(JOBS))
def test_job(spark, con, name):
    assert compare(spark, con, "sf0.001", name) is None


def test_checks_belong_to_jobs():
    assert set(CHECKS) <= set(JOBS)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).limit(1).count() == 1
    assert set(e.oracle_sql()) <= set(e.queries())
