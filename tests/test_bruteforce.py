"""Brute-force numpy cross-checks of the pairwise operators on the smallest fixture."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nazar.operators import tfidf as TF
from nazar.operators import vectors as V
from nazar.plans import fixtures as X
from nazar.plans.q_features import fitted

from .conftest import SF001


def test_doc_similarity_matches_dense(spark):
    docs, vocab, w = fitted(spark, SF001)
    targets = TF.sample_ids(docs, 10)
    got = {(r.id_a, r.id_b): r.cosine for r in TF.doc_similarity(w, targets, n_targets=10).collect()}
    rows = w.select("id", "idx", "weight").collect()
    ids = sorted({r.id for r in rows})
    pos = {d: i for i, d in enumerate(ids)}
    n_terms = vocab.count()
    m = np.zeros((len(ids), n_terms))
    for r in rows:
        m[pos[r.id], r.idx] = r.weight
    tids = [r.id for r in targets.collect()]
    for t in tids:
        if t not in pos:
            continue
        sims = m @ m[pos[t]]
        for d in ids:
            if d == t or sims[pos[d]] == 0:
                continue
            assert abs(got[(d, t)] - sims[pos[d]]) < 1e-6


def test_pair_similarity_and_coherence_match_dense(spark):
    wv = X.word_vectors(spark, SF001)
    rows = wv.collect()
    u = np.array([r.vec for r in rows])
    u = u / np.linalg.norm(u, axis=1, keepdims=True)
    c = u @ u.T
    off = c[~np.eye(len(rows), dtype=bool)]
    s = V.pair_similarity_stats(wv).first()
    assert s.n_pairs == off.size
    assert abs(s["mean"] - off.mean()) < 1e-9 and abs(s["std"] - off.std()) < 1e-9
    assert abs(s["min"] - off.min()) < 1e-9 and abs(s["max"] - off.max()) < 1e-9
    grp = np.array([r.grp for r in rows])
    coh = {r.grp: r for r in V.group_coherence(wv).collect()}
    for g in np.unique(grp):
        idx = np.where(grp == g)[0]
        if len(idx) < 2:
            continue
        sub = c[np.ix_(idx, idx)][np.triu_indices(len(idx), 1)]
        assert abs(coh[g].mean_cosine - sub.mean()) < 1e-9
        assert abs(coh[g].std_cosine - sub.std()) < 1e-6


def test_silhouette_matches_dense(spark):
    wv = X.word_vectors(spark, SF001)
    rows = wv.collect()
    x = np.array([r.vec for r in rows])
    grp = np.array([r.grp for r in rows])
    d = np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(-1))
    ref = []
    for i in range(len(rows)):
        own = (grp == grp[i]) & (np.arange(len(rows)) != i)
        if not own.any():
            ref.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, grp == g].mean() for g in np.unique(grp) if g != grp[i])
        ref.append((b - a) / max(a, b))
    got = V.silhouette(wv, "grp", "word", "vec").agg(F.avg("silhouette")).first()[0]
    assert abs(got - float(np.mean(ref))) < 1e-9


def test_vectors_meet_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK_ROWS", 30)
    test_pair_similarity_and_coherence_match_dense(spark)
    test_silhouette_matches_dense(spark)


def test_tags_by_substrings_and_by_automaton(spark, monkeypatch):
    from nazar.operators import labels as L
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("abAB é"), rng.integers(0, 12))) for _ in range(200)] + [None]
    words = ["a", "ab", "ba", "É", "bb a", "zz"]
    lexicon = [(f"c{i % 3}", w) for i, w in enumerate(words)] + [("c0", "a"), ("c9", None)]
    df = spark.createDataFrame(list(enumerate(texts)), "id long, comment string")
    cat = spark.createDataFrame(lexicon, "category string, keyword string")
    want = sorted({(i, c) for i, t in enumerate(texts) for c, w in lexicon if t is not None and w is not None and w.lower() in t.lower()})
    for most in (L.KEYWORDS_IN_ROW, 2):
        monkeypatch.setattr(L, "KEYWORDS_IN_ROW", most)
        assert sorted(map(tuple, L.tag_categories(df, cat).collect())) == want
    every = spark.createDataFrame([("all", "")], "category string, keyword string")
    assert L.tag_categories(df, every).count() == 200
    monkeypatch.setattr(L, "KEYWORDS_IN_ROW", 0)
    assert L.tag_categories(df, every).count() == 200
    assert L.tag_categories(df, every.limit(0)).count() == 0


def test_weight_search_against_brute_force(spark):
    from nazar.operators import ensemble as EN
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.ones(3), (2, 80))
    y = rng.integers(0, 3, 80)
    rows = [(i, m, int(y[i]), int(p[k, i].argmax()), p[k, i].tolist()) for k, m in enumerate(("a", "b")) for i in range(80)]
    rows += [(900, "a", 0, 0, [1.0, 0.0, 0.0])]  # an id that one model has not scored
    preds = spark.createDataFrame(rows, "id long, model string, y_true int, y_pred int, proba array<double>")
    got = {r.wid: r for r in EN.search_weights(preds, ["a", "b"]).collect()}
    grid = EN.weight_grid(2)
    acc = [((w[0] * p[0] + w[1] * p[1]).round(12).argmax(axis=1) == y).mean() for w in grid]
    assert [got[i].accuracy for i in range(len(grid))] == pytest.approx(acc)
    assert [i for i in got if got[i].is_best] == [int(np.argmax(acc))]


def test_results_of_one_id_do_not_multiply_reviews(spark):
    from nazar.operators import labels as L
    reviews = spark.createDataFrame([(1,), (2,), (3,), (None,)], "id long")
    results = spark.createDataFrame([("1", "positive", 1), ("1", "negative", 2), ("2", None, 1), (None, "positive", 1)], "id string, sentiment_label string, at int")
    merged = lambda **kw: sorted((str(r.id), r.sentiment_label, r.was_missing) for r in L.merge_labels(reviews, results, **kw).collect())
    rest = [("2", "neutral", 1), ("3", "neutral", 1), ("None", "neutral", 1)]
    assert merged() == [("1", "positive", 0), *rest] and merged(order_col="at") == [("1", "negative", 0), *rest]
