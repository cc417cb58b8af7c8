"""Every registered query beside its SQL on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from tests.compare import connection, difference
from tracklake.plans import cluster_queries

FOLDER = "/root/testdata/sf0.001"
SLOW = {"clustering_run"}  # covered by test_clustering


@pytest.fixture(scope="module")
def con():
    return connection(FOLDER)


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_matches_sql(spark, con, name):
    assert difference(entry_point.queries()[name](spark, FOLDER), con, entry_point.oracle_sql()[name]) is None


@pytest.mark.parametrize("name", sorted(set(entry_point.queries()) - set(entry_point.oracle_sql()) - SLOW))
def test_runs(spark, name):
    assert entry_point.queries()[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 10


def test_pca_wrong_on_a_late_row_is_seen(spark, con, monkeypatch):
    plain = cluster_queries.prep.reduce_features

    def wrong(data, **options):
        reduced, summary = plain(data, **options)
        last = reduced.agg(F.max("track_id")).first()[0]
        return reduced.withColumn("vector", F.when(F.col("track_id") == last, F.transform("vector", lambda v: v + 1)).otherwise(F.col("vector"))), summary

    monkeypatch.setattr(cluster_queries.prep, "reduce_features", wrong)
    assert difference(entry_point.queries()["pca_keeps_spread"](spark, FOLDER), con, entry_point.oracle_sql()["pca_keeps_spread"]) is not None
