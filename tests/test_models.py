"""Classifier over stacked feature blocks: columns, probabilities, stored models."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from nazar.operators import design as DS
from nazar.operators import models as MD

LEXICON = (["good", "it's"], ["bad"])


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    words = {0: ["bad", "slow", "wrong"], 1: ["plain", "usual", "even"], 2: ["good", "fast", "it's"]}
    rows = []
    for i in range(150):
        k = i % 3
        rows.append((i, " ".join(rng.choice([*words[k] * 2, "the", "app", "works"], rng.integers(3, 12))) + "." * int(rng.integers(0, 3)), k))
    rows += [(900, "", 0), (901, None, 1), (902, "x", 2)]
    return spark.createDataFrame(rows, "id long, text string, label int").repartition(3).checkpoint()


@pytest.fixture(scope="module")
def fitted(data):
    return MD.fit_logistic(data, blocks=DS.BLOCKS, lexicon=LEXICON, max_iter=30)


def test_blocks_are_offset_columns(data, fitted):
    model, metrics, _ = fitted
    blocks = DS.column_blocks(model)
    assert [b.name for b in blocks] == list(DS.BLOCKS)
    assert [b.start for b in blocks] == [0, *np.cumsum([b.width for b in blocks])[:-1].tolist()]
    assert blocks[1].names == tuple(DS.LENGTH_NAMES) and blocks[2].names == tuple(DS.LEXICON_NAMES)
    names = DS.feature_names(model)
    row = model.transform(data.where("id = 3")).select("text", vector_to_array("features").alias("v"), vector_to_array("_text_length_raw").alias("len"),
                                                       vector_to_array("_sentiment_lexicon_raw").alias("lex")).first()
    words = row.text.split()
    assert row.len == [len(row.text), len(words), sum(map(len, words)) / len(words), row.text.count(".") + 1]
    assert row.lex[:2] == [len(set(words) & set(LEXICON[0])), len(set(words) & set(LEXICON[1]))] and row.lex[2] == row.lex[0] - row.lex[1]
    v = np.array(row.v)
    assert len(v) == len(names)
    for b in blocks:
        part = v[b.start:b.start + b.width]
        if b.name in ("tfidf", "ngrams"):
            assert abs((part ** 2).sum() - 1) < 1e-9
        if b.name == "ngrams":
            low = row.text.lower()
            held = {n.removeprefix("ngrams_") for n, x in zip(b.names, part, strict=True) if x}
            assert held == {low[i:i + n] for n in (2, 3, 4) for i in range(len(low) - n + 1)} & {n.removeprefix("ngrams_") for n in b.names}
    got = {r.metric: r.value for r in metrics.collect()}
    assert got["test_accuracy"] > 0.8


def test_smooth_idf_and_training_vocabulary(data):
    train = data.where("id < 100")
    model = DS.design_pipeline(blocks=("tfidf",)).fit(train)
    terms = [n.removeprefix("tfidf_") for n in DS.feature_names(model)]
    tokens = [r.text.replace(".", " ").replace("'", " ").split() for r in train.collect()]
    docs = [{w for w in t if len(w) > 1} | {f"{a} {b}" for a, b in zip(*[[w for w in t if len(w) > 1][k:] for k in (0, 1)])} for t in tokens]
    df = {t: sum(t in d for d in docs) for d in docs for t in d}
    assert set(terms) == {t for t, n in df.items() if 2 <= n <= 0.8 * len(docs)}
    weights = next(s for s in model.stages if type(s).__name__ == "ElementwiseProduct").getScalingVec().toArray()
    assert np.allclose(weights, [np.log((1 + len(docs)) / (1 + df[t])) + 1 for t in terms])
    with pytest.raises(ValueError):
        DS.design_pipeline(blocks=("other",))
    with pytest.raises(ValueError):
        DS.design_pipeline(blocks=())


def test_probabilities_of_one_vs_rest(spark, data, fitted):
    model = fitted[0]
    rows = MD.score(model, data).collect()
    margins = {r.id: r.m for r in model.transform(data).select("id", vector_to_array("rawPrediction").alias("m")).collect()}
    for r in rows:
        own = 1 / (1 + np.exp(-np.array(margins[r.id])))
        assert np.allclose(r.proba, own / own.sum()) and abs(sum(r.proba) - 1) < 1e-12 and r.y_pred == int(np.argmax(r.proba))
    df = spark.createDataFrame([([-1e6, -1e6],), ([1e6, 0.0],)], "m array<double>")
    assert [list(r.p) for r in df.select(MD.one_vs_rest_probabilities(F.col("m")).alias("p")).collect()] == [[0.5, 0.5], [1 / 1.5, 0.5 / 1.5]]


def test_stored_models_are_versions(data, fitted, tmp_path):
    model, path = fitted[0], f"{tmp_path}/models"
    with pytest.raises(ValueError):
        MD.load_model(path)
    assert MD.save_model(model, path, ["neg", "neu", "pos"], {"C": "1"}) == 1
    other = MD.fit_logistic(data, blocks=("tfidf",), max_iter=3)[0]
    assert MD.save_model(other, path, ["a", "b", "c"]) == 2
    for version, want, labels in ((1, model, ["neg", "neu", "pos"]), (None, other, ["a", "b", "c"])):
        again, names, blocks = MD.load_model(path, version)
        assert names == labels and [tuple(b) for b in blocks] == [(b.name, b.start, b.width) for b in DS.column_blocks(want)]
        one, two = (sorted((r.id, r.y_pred, r.proba) for r in MD.score(m, data).collect()) for m in (want, again))
        assert one == two
    with pytest.raises(ValueError):
        MD.load_model(path, 3)
    top = MD.feature_importance(model, 5).collect()
    assert len(top) == 15 and {r.block for r in top} <= set(DS.BLOCKS)
