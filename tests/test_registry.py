"""Every registered query of the package proper against its check SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from factloom.plans import catalog
from tools.check_sql import compare, connect

SF = "/root/testdata/sf0.001"
SQL = catalog.all_sql()
#: Queries that SQL does not express; other tests compare them with plain versions.
WITHOUT_SQL = {"S4_page_text", "T3_tables", "T7_chunks", "T9_packed_chunks", "M1_merge_suggestions", "M9_name_clusters"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.all_queries()))
def test_query(spark, con, name):
    ok, n, _, detail = compare(spark, con, SF, name, catalog.all_queries()[name], SQL.get(name))
    assert ok if name not in WITHOUT_SQL else ok is None, detail


def test_only_named_queries_lack_sql():
    assert set(catalog.all_queries()) - set(SQL) == WITHOUT_SQL


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["fact_type", "review_status", "n", "avg_confidence"] and df.count() > 0


def test_entry_lists_every_query():
    assert set(entry.queries()) >= set(catalog.all_queries()) and set(entry.oracle_sql()) >= set(SQL)
