"""Registered corpus queries: against their SQL where there is one, else their shape, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from factloom.llm import catalog
from tools.check_sql import compare, connect

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_pii": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"], "op3_quality": ["doc_id", "score", "keep"],
    "op4_pieces": ["doc_id", "ids", "n_ids", "round_trip"], "op5_simhash": ["doc_id", "fingerprint", "component_id"],
    "op8_langid": ["doc_id", "held_out", "lang_pred", "score"],
    "op11_alignment": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
}


@pytest.mark.parametrize("name", sorted(catalog.all_sql()))
def test_against_sql(spark, name):
    ok, n, _, detail = compare(spark, connect(SF), SF, name, catalog.all_queries()[name], catalog.all_sql()[name])
    assert ok and n > 0, detail


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_covers_every_document(spark, name):
    rows = catalog.all_queries()[name](spark, SF)
    assert rows.columns == COLUMNS[name]
    assert rows.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_every_operator_is_registered():
    assert {n.split("_")[0] for n in catalog.all_queries()} == {f"op{i}" for i in range(1, 14)}
    assert set(COLUMNS) | set(catalog.all_sql()) | {"op13_whitening"} == set(catalog.all_queries())
    assert set(catalog.all_queries()) | {"pipeline"} <= set(entry.queries())
