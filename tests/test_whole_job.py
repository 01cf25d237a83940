"""What an operator names is all there, and what grows with the data stays in pieces."""

import numpy as np
from pyspark.sql import functions as F

from nazar.llm import ann
from nazar.operators import vectors as V


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_vocab_coverage_measures_the_vectors_and_lists_the_most_frequent_words(spark):
    docs = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["c", "a", None]), (3, []), (4, None)], "id int, tokens array<string>")
    vecs = spark.createDataFrame([("a", [1.0, 2.0, 3.0]), ("z", [0.0, 0.0, 1.0])], "word string, vec array<double>")
    r = V.vocab_coverage(docs, vecs, top=2).first()
    assert (r.unique_words, r.in_model, r.coverage) == (3, 1, 1 / 3)
    assert r.model_size_mb == 2 * 3 * 4 / 2 ** 20  # the vectors' own width
    assert (r.most_frequent_words, r.most_frequent_counts) == (["a", "b"], [2, 2])
    r = V.vocab_coverage(docs, vecs.limit(0)).first()
    assert (r.in_model, r.model_size_mb, r.most_frequent_words) == (0, 0.0, ["a", "b", "c"])


def test_shards_and_queries_of_nearest_neighbours_are_not_multiplied(spark, monkeypatch):
    """No row for each pair of a shard and a block of queries; queries in several parts find the same."""
    x = np.random.default_rng(0).normal(size=(300, 4))
    vec = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(1000, [1.0, 2.0])], "vec_id long, embedding array<double>").checkpoint()
    asked = vec.where("vec_id % 7 = 0 or vec_id = 1000")
    one = ann.search(vec, asked, k=3, shard_rows=64)
    assert "explode" not in plan(one) and "Join" not in plan(one)
    rows = sorted(map(tuple, one.collect()))
    assert len(rows) == 43 * 3 and all(0 <= i < 300 for _, _, i, _ in rows)  # the vector of another dimension finds none
    monkeypatch.setattr(ann, "HELD_NUMBERS", 40)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    assert rows == sorted(map(tuple, ann.search(vec, asked, k=3, shard_rows=64).collect()))


def test_silhouette_multiplies_no_rows(spark, monkeypatch):
    """Points stream past the clusters' files; equal rows, far offsets and single points are exact."""
    rng = np.random.default_rng(2)
    x = np.r_[rng.normal(size=(40, 3)), np.ones((4, 3)), [[9.0, 9.0, 9.0]]] + 1e4
    g = np.r_[rng.integers(0, 2, 40), [0, 0, 1, 1], 2]
    d = spark.createDataFrame([(f"w{i}", v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, g, strict=True))], "word string, vec array<double>, grp int").repartition(3)
    monkeypatch.setattr(V, "SLAB", 7)
    s = V.silhouette(d)
    assert "Join" not in plan(s) and "explode" not in plan(s)
    dist = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    for r in s.collect():
        i = int(r.word[1:])
        own = (g == g[i]) & (np.arange(len(x)) != i)
        a, b = dist[i, own].mean() if own.any() else None, min(dist[i, g == c].mean() for c in set(g) - {g[i]})
        assert abs(r.silhouette - (0.0 if a is None else (b - a) / max(a, b))) < 1e-9
    same = spark.createDataFrame([("a", [1.0], 0), ("b", [1.0], 0)], "word string, vec array<double>, grp int")
    assert [r.silhouette for r in V.silhouette(same).collect()] == [0.0, 0.0]
    assert [r.silhouette for r in V.silhouette(same.withColumn("vec", F.array(F.ascii("word").cast("double")))).collect()] == [None, None]
