"""Every registered query builds and runs on the smallest fixture; the flagship entry works."""

import pytest

import __spark_entry__ as E
from loanlens.plans import catalog

from .conftest import SF

NAMES = sorted(catalog.QUERIES)


def test_entry(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"sector", "exposure", "avg_pd", "expected_loss", "borrower_count"}


def test_every_query_has_sql_or_is_known_rows_only():
    rows_only = set(NAMES) - set(E.oracle_sql())
    assert rows_only <= {"embedding_pca", "gbt_scores", "logreg_baseline", "rf_scores", "calibrated_scores",
                         "cv_results", "cross_dataset_eval", "prevalence_intercept", "tree_attribution", "consumer_scores",
                         "consumer_ablation",
                         # their facts have SQL: consumer_trajectory_check, consumer_attribution_check
                         "consumer_trajectory", "consumer_migration", "consumer_attribution", "consumer_drivers"}


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF)
    df.collect()
