"""Every registered query against its SQL at the smallest scale."""

import os

import pytest

import __spark_entry__ as entry
from oracle_check import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
plans = entry.load()  # without the optional modules, which have tests of their own
QUERIES, ORACLES = plans.queries, plans.oracles


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test data")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    """Equal to its SQL, and not empty: what has no rows at the smallest scale is compared at the next."""
    problem = "no rows"
    if name not in BALANCED_ONLY:
        df = QUERIES[name](spark, SF_DIR)
        if name not in ORACLES:
            assert df.count() > 0
            return
        problem = compare(df, con, ORACLES[name])
    if problem == "no rows":
        folder = SF_DIR.replace("sf0.001", "sf0.01")
        problem = compare(QUERIES[name](spark, folder), connect(folder), ORACLES[name])
    assert problem is None


# The SQL of these is the closed form of a balanced panel, which the smallest tables are not.
BALANCED_ONLY = {"two_way_fe", "event_study_fe", "event_study_ols", "robustness_suite"}


def test_registry_names():
    assert set(ORACLES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {
        "model_coefficients", "match_method", "crosswalk_match", "freeze_hashes"}
