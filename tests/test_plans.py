"""Physical-plan properties the scale design relies on."""

import re

import pytest

from nazar.plans.catalog import all_queries

from .conftest import SF001


def plan(spark, name):
    df = all_queries()[name].fn(spark, SF001)
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name,columns", [("rating_distribution", {"doc_id"}), ("count_by_app", {"source"}),
                                          ("label_candidates", {"doc_id", "source", "text"})])
def test_scan_reads_only_needed_columns(spark, name, columns):
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", plan(spark, name))
    read = {f.split(":")[0] for s in schemas for f in s.split(",") if f}
    assert read == columns


def test_flagship_broadcasts_bounded_vocab_and_limits_topk(spark):
    p = plan(spark, "top_terms_by_class")
    assert "BroadcastExchange" in p
    assert "TakeOrderedAndProject(limit=10000" in p      # vocabulary bounded by max_features
    assert "WindowGroupLimit" in p                        # partial top-k before the shuffle
    assert "partial_count" in p                           # map-side combine of term frequencies


def test_auc_uses_bucketed_prefix_sums(spark):
    p = plan(spark, "roc_auc_ovr")
    assert "percentile_approx" in p
    assert "_b" in p


def test_tags_are_made_in_the_row(spark):
    p = plan(spark, "tag_categories")
    assert "Join" not in p and "Aggregate" not in p


def test_weight_search_keeps_a_counter_a_weight(spark):
    p = plan(spark, "search_weights")
    assert "Generate posexplode" not in p and len(re.findall(r"partial_sum\(", p)) >= 45


def test_calibration_compiles(spark):
    df = all_queries()["calibration"].fn(spark, SF001)
    assert re.search(r"Generate inline", df._jdf.queryExecution().executedPlan().toString())
