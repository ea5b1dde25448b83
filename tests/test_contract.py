"""Registered queries against their SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from tools import parity

# One of each area; tools/parity.py runs all of them.
SAMPLE = [
    "clean_text", "enriched_text", "document_chunks", "hash_embedding", "extract_filters", "json_parse", "bm25_match",
    "match_phrase", "knn_exact", "percolate", "span_queries", "percentiles", "facet_counts", "collapse", "bulk_actions",
    "moving_percentiles", "cumulative_cardinality", "suggest_terms",
]


@pytest.fixture(scope="module")
def con(sf):
    return parity.connect(sf)


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, con, sf, name):
    assert parity.compare(spark, con, name, sf).startswith("ok")


def test_contract_is_complete(spark):
    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.entry(spark).count() > 0
