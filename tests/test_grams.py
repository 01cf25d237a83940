"""N-grams counted in numpy against plain Python and the column form."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from nazar.operators import design as DS
from nazar.operators import grams as G
from nazar.operators import tfidf as TF


def grams(symbols, n_min, n_max, sep=""):
    return [sep.join(symbols[i:i + n]) for n in range(n_min, n_max + 1) for i in range(len(symbols) - n + 1)]


@pytest.fixture(scope="module")
def texts():
    r = np.random.default_rng(1)
    return ["".join(r.choice([*"abc é٣\0", "👍", "ي"], r.integers(0, 60))) for _ in range(400)] + ["", None, "x", "ab", "👍" * 9]


@pytest.mark.parametrize("table", [G.TABLE, 0])
@pytest.mark.parametrize("words", [False, True])
def test_statistics_and_counts(spark, texts, monkeypatch, table, words):
    monkeypatch.setattr(G, "TABLE", table)
    monkeypatch.setattr(G, "PIECE_TEXTS", 7)
    monkeypatch.setattr(G, "PIECE_SYMBOLS", 100)
    rows = [None if t is None else t.split() for t in texts] if words else texts
    own = [Counter(grams(t or [], 1, 3, " " if words else "")) for t in rows]
    cf, df = Counter(), Counter()
    for c in own:
        cf.update(c)
        df.update(c.keys())
    from pyspark import cloudpickle
    cloudpickle.register_pickle_by_value(G)  # workers take the small pieces too
    try:
        d = spark.createDataFrame([(t,) for t in rows], "t array<string>" if words else "t string").repartition(3)
        got = {r.term: (r.df, r.cf) for r in G.gram_stats(d, "t", 1, 3, words).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(G)
    assert got == {t: (df[t], n) for t, n in cf.items()}
    some = sorted(cf)[::3]
    found = G.counted(pa.array(rows, pa.list_(pa.string()) if words else pa.string()), G.Finder([t.split(" ") for t in some] if words else some), words)
    for c, v in zip(own, found.to_pylist(), strict=True):
        assert v["size"] == len(some) and {some[i]: x for i, x in zip(v["indices"], v["values"], strict=True)} == {t: c[t] for t in some if t in c}


def test_char_vocabulary_as_rows_have_it(spark, texts):
    d = spark.createDataFrame(list(enumerate(texts)), "id long, t string").checkpoint()
    plan = lambda x: x._jdf.queryExecution().optimizedPlan().toString()
    rows, own = (TF.fit_tfidf(TF.with_char_terms(d, F.col("t")), max_df=1.0, max_features=50, weigh=False)[0], TF.char_vocab(d, F.col("t"), max_features=50))
    assert "lambda" not in plan(own)  # no gram is made by an expression
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, own.collect())) and own.count() == 50


def test_terms_of_the_design_are_counted_not_listed(spark):
    d = spark.createDataFrame([(i, f"Alpha beta{i % 3}  gamma{i % 2} x") for i in range(12)] + [(20, None)], "id long, text string").checkpoint()
    model = DS.design_pipeline(blocks=("tfidf", "ngrams")).fit(d)
    counts = [s for s in model.stages if hasattr(s, "vocabulary")]
    assert [type(s).__name__ for s in counts] == ["TermCounts"] * 2
    assert {"beta1", "beta1 gamma0"} < set(counts[0].vocabulary) and {"al", "alph", " gam"} < set(counts[1].vocabulary)
    text = d.select("text").first().text
    v = model.transform(d).select("_ngrams_tf").first()[0].toArray()
    low = Counter(grams(" ".join(text.lower().split()), 2, 4))
    assert {t: x for t, x in zip(counts[1].vocabulary, v, strict=True) if x} == {t: low[t] for t in counts[1].vocabulary if t in low}
