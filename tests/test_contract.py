"""Driver contract and a fast oracle subset at sf0.001 (the full run: python tests/oracle.py)."""

import pytest

import __spark_entry__ as E
from tests.oracle import compare, duck

from .conftest import SF001

FAST = ["net_score_topk", "app_label_share", "label_distribution", "clean_text_medium", "tokenize", "versions",
        "tfidf_vocab", "top_terms_by_class", "doc_similarity", "summary_metrics", "roc_auc_ovr", "pr_curve",
        "calibration", "hard_vote", "soft_vote", "search_weights", "most_similar", "group_coherence",
        "pool_tokens_masked", "stratified_folds", "encode_sequences", "flatten_review_reply", "read_batch_results",
        "jalali_to_date", "assign_batches", "error_examples", "common_words_in_errors", "silhouette",
        "pair_similarity_stats", "read_reviews"]


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and len(df.columns) > 0


def test_keys():
    q, o = E.queries(), E.oracle_sql()
    assert set(o) <= set(q)
    assert len(q) >= 150


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", FAST)
def test_oracle_fast(spark, con, name):
    from nazar.plans.catalog import all_queries
    r = compare(spark, SF001, all_queries()[name], con)
    assert r["status"] == "ok", r
