"""Every query with a SQL counterpart gives the same schema, rows and values as DuckDB."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry_points
from oracle.sql import oracle_queries
from tests.compare import differences, duck
from wardstat.plans import catalog

SF = "/root/testdata/sf0.001"
SQL = oracle_queries()
QUERIES = catalog.queries()
MODELS = ["class_auc", "class_roc", "lca_fit", "lca_select", "lca_posterior", "kmeans_rows", "kmeans_profiles", "cluster_profile"]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_but_the_models_has_sql():
    assert sorted(set(QUERIES) - set(SQL)) == sorted(MODELS)
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) <= set(entry_points.queries()) and set(SQL) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("key", sorted(SQL))
def test_matches_sql(spark, con, key):
    assert differences(QUERIES[key](spark, SF), con, SQL[key]) is None


def test_entry_is_lazy_and_has_rows(spark):
    df = entry_points.entry(spark)
    assert df.columns[0] == "age_bucket"
    assert df.count() > 0


def test_published_role_counts(spark):
    """Row counts of the star-schema binding agreed on by both engines at scale factor 0.01."""
    from wardstat.operators.cohort import first_event, morbidity_counts
    from wardstat.plans.reports import los_icu_by_age
    from wardstat.sources.star import star_tables

    t = star_tables(spark, "/root/testdata/sf0.01")
    first = first_event(t.icustays)
    assert (first.count(), first.select("subject_id").distinct().count()) == (1515, 1500)
    buckets = {r.age_bucket: r.number_of_patients for r in los_icu_by_age(t).collect()}
    assert buckets == {"16-24": 131, "25-44": 290, "45-64": 285, "65-84": 295, "85-95": 158, None: 212}
    by_count = {r.disease_count: r["count"] for r in morbidity_counts(t).groupBy("disease_count").count().collect()}
    small = [by_count.get(i, 0) for i in range(8)]
    assert small + [sum(n for k, n in by_count.items() if k >= 8)] == [16, 96, 226, 288, 238, 159, 79, 41, 16]
