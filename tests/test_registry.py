"""What the driver sees: names, pairs of query and SQL, the flagship query, and no cross joins in plans."""

from __future__ import annotations

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as entry
from refweave import registry

SF = "/root/testdata/sf0.001"


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert len(registry.queries()) >= 120
    assert "op9_url_filter" not in registry.queries()


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["doc_id", "group_order", "ref_pos", "recnum", "n_in_doc", "n_groups", "n_citations", "n_distinct"]
    assert df.limit(5).count() == 5


@pytest.mark.parametrize("name", ["match_library", "top_matches", "context_similarity", "reference_usage", "claim_source_match", "match_paragraphs", "resolve_cited_record"])
def test_similarity_plans_have_no_cartesian_product(spark, name):
    out = io.StringIO()
    with redirect_stdout(out):
        registry.queries()[name](spark, SF).explain()
    assert "CartesianProduct" not in out.getvalue()
    assert "BroadcastNestedLoopJoin" not in out.getvalue()


def test_filters_and_columns_reach_the_scan(spark):
    out = io.StringIO()
    with redirect_stdout(out):
        registry.queries()["page_filter"](spark, SF).explain("formatted")
    text = out.getvalue()
    assert "PushedFilters: [" in text and "l_orderkey" in text
    assert "l_extendedprice" not in text
