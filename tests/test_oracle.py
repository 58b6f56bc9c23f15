"""Every registered query against its SQL on the same tables."""

import pytest

import __spark_entry__ as entry_points
from acctlens.oracle import oracle_sql
from acctlens.queries import registry
from compare import connect, differences

# Models have no SQL form; what must hold of them has, in the ``_checks`` queries.
ROWS_ONLY = {"ml_score", "ml_importances", "ml_permutation"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    return connect(sf_dir)


def test_every_query_has_sql_or_is_listed():
    names, sql = set(registry()), set(oracle_sql())
    assert names - sql == ROWS_ONLY
    assert sql <= names
    assert names <= set(entry_points.queries()) and sql <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(set(registry()) - ROWS_ONLY))
def test_matches_sql(name, spark, sf_dir, duck):
    df = entry_points.queries()[name](spark, sf_dir)
    assert differences(df, duck, entry_points.oracle_sql()[name]) == []


def test_entry(spark):
    df = entry_points.entry(spark)
    assert 0 < df.count() < 150 and "risk_score_raw" in df.columns   # one source out of two


def test_ml_score(spark, sf_dir):
    rows = registry()["ml_score"](spark, sf_dir).collect()
    truth = {r[0]: r[1] for r in registry()["risk_score_raw"](spark, sf_dir).collect()}
    assert {r["sf_account_id"] for r in rows} == set(truth) and len(rows) == len(truth)
    error = sum(abs(r["ml_risk_score"] - truth[r["sf_account_id"]]) for r in rows) / len(rows)
    assert error < 3


def test_ml_importances(spark, sf_dir):
    rows = registry()["ml_importances"](spark, sf_dir).collect()
    assert len(rows) == 18
    assert [r["importance"] for r in rows] == sorted((r["importance"] for r in rows), reverse=True)
