"""Registered queries against their SQL (a fast selection; ``python tests/oracle.py`` runs them all)."""
import os

import pytest

import __spark_entry__ as entry
from tests.oracle import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")
FAST = [
    "A10_contract_report", "A14_range_profile", "A16_count_reconcile", "B11_nested_counts", "B17_split_overlaps", "B20_set_hashes", "C2_one_to_one_matches",
    "D3_fixed_quota_split", "D7_unit_bootstrap", "E3_spearman", "E5_crossfit_median", "F4_crossfit_predictions", "G2_deployed_endpoint", "I6_interval_metrics",
    "J2_knn_embeddings_partitioned", "K7_surface_distance", "K16_features_with_support", "L6_endpoint_table",
]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables not present")


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, name):
    problem, _ = compare(entry.queries()[name](spark, SF), connect(SF), entry.oracle_sql()[name])
    assert problem is None


def test_flagship(spark):
    assert entry.entry(spark).count() == 20


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
