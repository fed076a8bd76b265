"""Queries on items read and extract their documents once."""

import pytest

from plumbline.catalog import load_all


@pytest.mark.parametrize("name", ["s14_triples", "q7_kg_nodes"])
def test_documents_are_read_once(spark, name):
    plan = load_all()[0][name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [") == 1


def test_section_items_are_extracted_before_they_are_used(spark):
    plan = load_all()[0]["g2_section_items_nodes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "n_chars" not in plan  # the documents are not read again
