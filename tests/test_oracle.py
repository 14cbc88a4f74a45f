"""Every registered query next to its SQL on the smallest tables."""

import os

import pytest

from catalog import ORACLES, QUERIES

from .compare import check, duck

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
SLOW = {"train_package_models", "feature_importance", "predict", "package_analysis"}


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, con, name):
    assert check(spark, con, name, QUERIES[name], ORACLES[name], SF_DIR) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
