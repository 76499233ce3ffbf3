"""Registered queries against their SQL on the smallest tables."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry

from .compare import connect, differences

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
NAMES = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_registry_is_consistent():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_runs(spark):
    assert entry.entry(spark).count() == 10


# One query of each family; check.py runs all of them.
FAMILIES = [
    "agg8_venue_metrics", "venue_features", "fil5_fil6_preprocess", "ded1_name_correction", "ded2_lineage", "joi10_set1_jaccard_pairs",
    "joi11_sta7_colocation_lift", "agg31_agg32_sensitivity_grid", "sta9_cosine_pairs", "com3_distance_statistics", "clu2_silhouette",
    "joi13_win4_win6_row_fields", "win7_top_relations", "str18_extract_category", "num6_datum_inverse", "agg35_trimmed_bounds",
]


@pytest.mark.parametrize("name", FAMILIES)
def test_query_equals_sql(spark, con, name):
    assert differences(entry.queries()[name](spark, FOLDER), con, entry.oracle_sql()[name]) == ""
