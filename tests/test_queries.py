"""Every registered query against its DuckDB oracle, at the smallest scale."""

import pytest
from oracle_check import compare, duck

from __spark_entry__ import entry, queries
from registry.oracle import ORACLE
from registry.spark_queries import QUERIES

SF = "/root/testdata/sf0.001"
ROWS_ONLY = {"walk_forward_ridge_all", "walk_forward_boosted", "fit_predict_boosted", "compare_models"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registry_is_complete():
    assert set(QUERIES) - set(ORACLE) == ROWS_ONLY
    assert set(ORACLE) <= set(QUERIES) <= set(queries())


def test_entry(spark):
    assert entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_oracle(spark, con, name):
    assert compare(QUERIES[name](spark, SF), con, ORACLE[name]) is None


def test_ridge_on_all_features_runs(spark):
    made = QUERIES["walk_forward_ridge_all"](spark, SF)
    assert made.count() == made.where("prediction is not null").count() > 0
