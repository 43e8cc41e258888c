"""Plans: columns and filters reach the scan, ranks are cut before the shuffle, sums are partial, no Python where none is needed."""

import re

import pytest

from corpusloom.plans import catalogue


def plan(spark, data, name):
    return catalogue.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()


def test_columns_and_filters_reach_the_scan(spark, data):
    assert "n_chars" not in plan(spark, data, "word_freq_topk")
    text = plan(spark, data, "extra_pricing_summary")
    assert re.search(r"PushedFilters: \[[^\]]*LessThanOrEqual\(l_shipdate", text)
    assert "l_comment" not in text and "l_partkey" not in text


def test_ranks_are_cut_before_the_shuffle(spark, data):
    for name in ("word_freq_topk", "stratified_cap", "extra_top_orders"):
        assert plan(spark, data, name).count("WindowGroupLimit") == 2, name


def test_sums_are_partial(spark, data):
    for name in ("char_freq", "bigram_topk", "accuracy_grouping_sets"):
        assert "partial_" in plan(spark, data, name), name


#: Queries with Arrow functions: normal forms, grapheme clusters, and two folds over a few rows.
PYTHON = {"encode_chars", "named_functions", "codec_roundtrip", "codec_failures", "codec_numbers", "hangul_codec", "cluster_counts", "cluster_rate", "padded_labels", "budget_packing", "greedy_slots", "similar_slots"}


@pytest.mark.parametrize("name", sorted(set(catalogue.SQL) - {"extra_event_stream", "shard_roundtrip"}))
def test_no_python_and_no_pairing(spark, data, name):
    text = plan(spark, data, name)
    assert "CartesianProduct" not in text
    assert bool(re.search("Python|Pandas|ArrowEval", text)) == (name in PYTHON)
