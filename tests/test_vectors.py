"""Vector accumulators, blocked products and pruned pair statistics against numpy."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from nazar.operators import vectors as V


def table(spark, x, grp, extra=()):
    rows = [(f"w{i:03d}", v.tolist(), str(g)) for i, (v, g) in enumerate(zip(x, grp, strict=True))]
    return spark.createDataFrame(rows + list(extra), "word string, vec array<double>, grp string").repartition(3)


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8)) * 12
    grp = np.r_[np.repeat(np.arange(5), 30), 5]  # the last cluster has one point
    x = centres[grp] + rng.normal(size=(len(grp), 8))
    return table(spark, x, grp).checkpoint(), x, grp


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def brute_silhouette(x, grp):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    out = []
    for i, g in enumerate(grp):
        own = (grp == g) & (np.arange(len(x)) != i)
        a = d[i, own].mean() if own.any() else None
        b = min((d[i, grp == h].mean() for h in set(grp) - {g}), default=None)
        out.append(0.0 if a is None else None if b is None else (b - a) / max(a, b))
    return out


@pytest.mark.parametrize("block", [V.BLOCK_ROWS, 7])
def test_silhouette_prunes_and_is_exact(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    df, x, grp = clustered
    got = {r.word: r.silhouette for r in V.silhouette(df).collect()}
    want = brute_silhouette(x, grp)
    assert len(got) == len(x) and all(abs(got[f"w{i:03d}"] - w) < 1e-9 for i, w in enumerate(want))
    rng = np.random.default_rng(1)
    y, g = rng.normal(size=(60, 4)), rng.integers(0, 3, 60)  # clusters that bounds do not part
    got = {r.word: r.silhouette for r in V.silhouette(table(spark, y, g)).collect()}
    assert all(abs(got[f"w{i:03d}"] - w) < 1e-9 for i, w in enumerate(brute_silhouette(y, g)))
    one = V.silhouette(table(spark, y[:5], [0] * 5)).collect()
    assert [r.silhouette for r in one] == [None] * 5
    whole = {r.word: r.silhouette for r in V.silhouette(df, reference=df).collect()}
    assert all(abs(whole[f"w{i:03d}"] - w) < 1e-9 for i, w in enumerate(want))
    assert V.silhouette(df.limit(0)).count() == 0


def test_silhouette_without_arrow_on_the_driver(spark, clustered):
    df, x, grp = clustered
    spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "false")  # Spark's default: toPandas gives lists
    try:
        got = {r.word: r.silhouette for r in V.silhouette(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.pyspark.enabled", "true")
    assert all(abs(got[f"w{i:03d}"] - w) < 1e-9 for i, w in enumerate(brute_silhouette(x, grp)))


@pytest.mark.parametrize("block", [V.BLOCK_ROWS, 11])
def test_pair_statistics_of_all_pairs(spark, clustered, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK_ROWS", block)
    rng = np.random.default_rng(2)
    for x, grp in (clustered[1:], (rng.normal(size=(90, 5)), [0] * 90), (np.repeat(rng.normal(size=(1, 4)), 5, axis=0), [0] * 5)):
        c = unit(x) @ unit(x).T
        c = c[~np.eye(len(x), dtype=bool)]
        got = V.pair_similarity_stats(table(spark, x, grp, [("none", None, "0")])).first()
        assert got.n_pairs == len(c) and np.allclose([got.mean, got.std, got.min, got.max], [c.mean(), c.std(), c.min(), c.max()], atol=1e-7)
        both = V.pair_similarity_stats(table(spark, x, grp), reference=table(spark, x, grp)).first()
        assert np.allclose([both.mean, both.min, both.max], [c.mean(), c.min(), c.max()], atol=1e-9)
    assert tuple(V.pair_similarity_stats(clustered[0].limit(1)).first()) == (0, None, None, None, None)


def test_cells_that_cannot_hold_an_extreme_do_not_meet():
    rng = np.random.default_rng(3)
    centres = unit(rng.normal(size=(12, 6)))
    members = [unit(c + 0.05 * rng.normal(size=(9, 6))) for c in centres]
    radius = np.array([np.arccos(np.clip(m @ c, -1, 1)).max() for m, c in zip(members, centres, strict=True)])
    low, high = -0.6, 0.9
    met = set(V.cells_that_meet(centres, radius, low, high))
    for i in range(12):
        for j in range(i, 12):
            c = members[i] @ members[j].T
            assert (i, j) in met or (c.min() >= low and c.max() <= high)
    assert len(met) < 12 * 13 / 2


@pytest.mark.parametrize("probes", [V.MAX_PROBES, 3])
def test_most_similar_against_brute_force(spark, monkeypatch, probes):
    monkeypatch.setattr(V, "MAX_PROBES", probes)
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (80, 3)).astype(float) + 1e-3  # many ties
    df = table(spark, x, [0] * 80, [("none", None, "0"), ("zero", [0.0] * 3, "0")])
    names = [f"w{i:03d}" for i in range(80)]
    q = df.where("word < 'w010'").select(F.col("word").alias("qword"), F.col("vec").alias("qvec"))
    c = np.floor(unit(x) @ unit(x).T * 1e9 + 0.5) / 1e9
    want = []
    for k in range(10):
        order = sorted((j for j in range(80) if j != k), key=lambda j: (-c[k, j], names[j]))[:6]
        want += [(names[k], r, names[j], c[k, j]) for r, j in enumerate(order, 1)]
    got = sorted((r.query, r["rank"], r.word, r.cosine) for r in V.most_similar(df, q, topn=6).collect())
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and np.allclose([g[3] for g in got], [w[3] for w in sorted(want)], atol=2e-9)
    assert V.most_similar(df, q.limit(0)).count() == V.most_similar(df.limit(0), q).count() == 0


def test_components_never_become_rows(spark, clustered):
    df, x, grp = clustered
    tokens = df.select(F.col("grp").cast("long").alias("id"), F.expr("cast(substr(word, 2) AS int)").alias("pos"), F.lit(1).alias("mask"), "vec")
    docs = spark.createDataFrame([(1, ["w000", "w001", "zz"]), (2, ["zz"])], "id long, tokens array<string>")
    for out in (V.group_coherence(df), V.doc_vector(docs, df), V.pool_all(tokens), V.embedding_stats(df), V.label_centroids(df)):
        assert not re.search(r"Generate pos?explode", out._jdf.queryExecution().executedPlan().toString())


def test_accumulators_against_numpy(spark, clustered, monkeypatch):
    monkeypatch.setattr(V, "HELD_GRAMS", 1)
    df, x, grp = clustered
    for r in V.group_coherence(df).collect():
        u = unit(x[grp == int(r.grp)])
        c = (u @ u.T)[np.triu_indices(len(u), 1)]
        assert r.n == len(u) and abs(r.mean_cosine - c.mean()) < 1e-9 and abs(r.std_cosine - c.std()) < 1e-6
    for r in V.label_centroids(df).collect():
        assert np.allclose(r.centroid, x[grp == int(r.grp)].mean(axis=0)) and r["count"] == (grp == int(r.grp)).sum()
    s = V.embedding_stats(df).first()
    assert np.allclose([s["mean"], s["std"], s["min"], s["max"]], [x.mean(), x.std(), x.min(), x.max()])
    dims = sorted(map(tuple, V.dim_stats(df).collect()))
    assert np.allclose([d[1:] for d in dims], np.column_stack([x.mean(axis=0), x.std(axis=0)]))
    rows = [(1, 0, 1, [1.0, -2.0]), (1, 1, 0, [3.0, 5.0]), (1, 2, 1, [0.0, -4.0]), (2, 3, 0, [1.0, 1.0]), (3, 0, 1, None)]
    tokens = spark.createDataFrame(rows, "id long, pos int, mask int, vec array<double>")
    got = {r.id: r for r in V.pool_all(tokens).collect()}
    assert set(got) == {1, 2} and got[1].cls == [1.0, -2.0] and got[1].max == [3.0, 5.0] and got[1].masked == [0.5, -3.0] and got[2].masked == [0.0, 0.0]
    assert np.allclose(got[1].mean, [4 / 3, -1 / 3])
    with pytest.raises(ValueError):
        V.pool_all(tokens, ("first",))


def test_word2vec_learns_planted_synonyms(spark):
    rng = np.random.default_rng(5)
    context = {"kitty": "milk purr whisker paw".split(), "cat": "milk purr whisker paw".split(), "bank": "loan money rate credit".split(), "lender": "loan money rate credit".split()}
    rows = []
    for i in range(3_000):
        w = list(context)[i % 4]
        rows.append((i, [*rng.choice(context[w], 3).tolist(), w, *rng.choice(context[w], 3).tolist()]))
    docs = spark.createDataFrame([*rows, (-1, []), (-2, None), (-3, ["alone"])], "id long, tokens array<string>")
    _, vecs = V.train_word2vec(docs, dim=20, max_iter=3, partitions=3)
    v = {r.word: np.array(r.vec) for r in vecs.collect()}
    cos = lambda a, b: float(unit(v[a][None])[0] @ unit(v[b][None])[0])
    assert set(v) == set(context) | set(sum(context.values(), []))
    assert min(cos("cat", "kitty"), cos("bank", "lender")) > max(cos(a, b) for a in ("cat", "kitty") for b in ("bank", "lender"))
