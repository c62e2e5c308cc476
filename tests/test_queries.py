"""Some registered queries against their SQL at the smallest scale. METHMIX_ALL_QUERIES=1 runs
all of them at sf0.01; `python tests/compare.py <folder>` does so at any scale."""

import os

import pytest

from tests.compare import connect, differences
from methmix.workloads import QUERIES, SQL

# The plans of these queries read the reads once, whatever they were stored for before.
ONE_SCAN = ["score_region_sample", "score_lifted", "liftover_back", "coverage_histogram", "atlas_iqr_outliers",
            "atlas_mean_variance", "nnls_per_sample", "standardized_scores", "pca_products", "explained_variance",
            "mixture_scores", "nnls_mixtures", "atlas_subset", "nnls_subset"]
ALL = bool(os.environ.get("METHMIX_ALL_QUERIES"))
# Below sf0.01 too few regions are covered for an atlas of full rank.
FOLDER = "/root/testdata/sf0.01" if ALL else "/root/testdata/sf0.001"
CHOSEN = ["overlap_join_binned", "kmer_counts", "score_region_sample", "score_lifted", "liftover_back",
          "coverage_histogram", "value_counts_ordered", "pca_products", "explained_variance", "atlas_long", "design_two_level", "design_tree", "proportion_labels", "mix_bernoulli_hash",
          "mix_poisson_hash", "naive_estimate", "lod95_detect"]
NAMES = sorted(QUERIES) if ALL else CHOSEN

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def database():
    return connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    df = QUERIES[name](spark, FOLDER)
    if name in SQL:
        assert differences(df, database, SQL[name]) == []
    else:
        df.collect()


@pytest.mark.parametrize("name", ONE_SCAN)
def test_reads_are_scanned_once(spark, name):
    """At sf0.01: below it the atlas has no full rank."""
    df = QUERIES[name](spark, "/root/testdata/sf0.01")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") == 0 or plan.count("Relation [l_orderkey") <= 1


def test_every_sql_has_a_query():
    assert set(SQL) <= set(QUERIES)
