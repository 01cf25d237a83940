"""Sparse features: term counting in the row, its plan, and the randomised SVD."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from nazar.operators import tfidf as TF


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.choice(["a", "b", "c", "é", "zz", "a b"], rng.integers(0, 30)).tolist()) for i in range(60)]
    rows += [(100, []), (101, None), (102, [None, "a", None, "a"]), (103, ["x"] * 500)]
    return spark.createDataFrame(rows, "id long, terms array<string>"), rows


def test_counts_in_the_row(docs):
    df, rows = docs
    want = sorted((i, t, n) for i, terms in rows for t, n in Counter(t for t in terms or [] if t is not None).items())
    assert sorted(map(tuple, TF.term_frequencies(df).collect())) == want
    per = {r.id: r.counts for r in TF.term_counts(df).collect()}
    assert len(per) == len(rows) and all(len({c.term for c in cs}) == len(cs) for cs in per.values() if cs)


def test_no_shuffle_on_id_and_term(docs):
    df, _ = docs
    vocab, weights = TF.fit_tfidf(df, min_df=1, max_df=1.0)
    plan = weights._jdf.queryExecution().executedPlan().toString()
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)
    assert keys and not any("id#" in k and "term#" in k for k in keys)
    assert "Window" in plan and sum("id#" in k for k in keys) == 2  # the documents, once for each reader
    some = df.where("id < 5").select("id")
    only = TF.fit_tfidf(df, min_df=1, max_df=1.0, only=some)[1]
    both = lambda w: sorted((r.id, r.term, round(r.weight, 12)) for r in w.where("id < 5").collect())
    assert both(only) == both(weights) and only.where("id >= 5").isEmpty()


def test_svd_against_dense(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.random((120, 12)) @ rng.random((12, 70)) * (rng.random((120, 70)) < 0.4)
    rows = [(i, int(j), float(x[i, j])) for i in range(120) for j in np.flatnonzero(x[i])]
    monkeypatch.setattr(TF, "BLOCK_CELLS", 700)
    monkeypatch.setattr(TF, "FAN_IN", 2)
    w = spark.createDataFrame(rows, "id long, idx int, weight double").repartition(5)
    got = TF.svd(w, 70, k=8).orderBy("component").collect()
    want = np.linalg.svd(x, compute_uv=False)[:8]
    assert np.allclose([r.singular_value for r in got], want, rtol=1e-3)
    assert np.allclose([r.variance_ratio for r in got], want ** 2 / (x ** 2).sum(), rtol=2e-3)
    wide = TF.svd(w, 70, k=70, oversample=0).collect()
    assert abs(sum(r.variance_ratio for r in wide) - 1) < 1e-9
