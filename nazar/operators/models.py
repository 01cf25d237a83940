"""Models as Spark jobs.

Training uses pyspark.ml (distributed optimisers); the TF-IDF features of
the model are fitted on the training split only.  Batched inference with an
external predict function runs in ``mapInPandas`` (Arrow batches).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nazar.operators import design as DS
from nazar.operators import split as SP
from nazar.session import cut_lineage


def softmax_argmax(logits) -> tuple[Column, Column]:
    """(softmax probabilities, argmax with the lowest index on ties) of an
    array<double> column reference."""
    x = F.col(logits) if isinstance(logits, str) else logits
    m = F.array_max(x)
    e = F.transform(x, lambda v: F.exp(v - m))
    s = F.aggregate(e, F.lit(0.0), lambda a, v: a + v)
    probs = F.transform(e, lambda v: v / s)
    arg = (F.array_position(x, m) - 1).cast("int")
    return probs, arg


def _classifier(train: DataFrame, n: int, C: float, max_iter: int):
    """One-vs-rest logistic regression; regParam = 1/(C·n) mirrors an inverse-regularisation C.
    As ``OneVsRest`` fits it, but for its copy of the rows in executors' memory: each class's
    regression keeps its own blocks of them anyway."""
    from pyspark.ml.classification import LogisticRegression, OneVsRestModel
    lr = LogisticRegression(maxIter=max_iter, regParam=1.0 / (C * max(n, 1)), elasticNetParam=0.0,
                            standardization=False, weightCol="weight", labelCol="_own", featuresCol="features")
    classes = int(train.agg(F.max("label_d")).first()[0] or 0) + 1
    own = [lr.fit(train.withColumn("_own", (F.col("label_d") == i).cast("double"))) for i in range(classes)]
    model = OneVsRestModel(models=own)
    model._set(labelCol="label_d", featuresCol="features", weightCol="weight", predictionCol="prediction", rawPredictionCol="rawPrediction", classifier=lr)
    return model


def _fit(train: DataFrame, blocks, text_col: str, C: float, max_iter: int, lexicon):
    """The design's stages and the classifier, fitted on the training rows alone; and the training
    rows' label_d, weight and features, which are written: the classifier and scores read them."""
    from pyspark.ml import PipelineModel
    positive, negative = lexicon
    design, seen = DS.fitted(DS.stages(tuple(blocks), text_col, positive=positive, negative=negative), train)
    # hundreds of passes read the rows: dealt evenly, whatever the partitions of the texts were
    cores = train.sparkSession.sparkContext.defaultParallelism
    seen = seen.select("label_d", "weight", "features")
    seen = cut_lineage(seen.repartition(max(cores, seen.rdd.getNumPartitions())))
    classifier = _classifier(seen, seen.count(), C, max_iter)
    return PipelineModel([*design.stages, classifier]), seen


def fit_logistic(df: DataFrame, text_col: str = "text", label_col: str = "label", C: float = 1.0,
                 test: float = 0.2, max_iter: int = 100, seed: int = 42, blocks=("tfidf",), lexicon=((), ())):
    """One-vs-rest logistic regression with balanced class weights over the given
    feature ``blocks`` (see ``design.BLOCKS``; ``lexicon`` = positive and negative words).

    Returns (model pipeline, metrics DataFrame with train/test accuracy and weighted F1,
    test predictions).
    """
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    s = SP.stratified_split(df, label_col, test, seed=seed)
    s = SP.with_class_weights(s, label_col, "weight").withColumn("label_d", F.col(label_col).cast("double"))
    # fitting and evaluating read the split several times: materialise it once (reliable checkpoint)
    s = cut_lineage(s)
    train, testd = s.filter(F.col("split") == "train"), s.filter(F.col("split") == "test")
    model, seen = _fit(train, blocks, text_col, C, max_iter, lexicon)
    ev_acc = MulticlassClassificationEvaluator(labelCol="label_d", metricName="accuracy")
    ev_f1 = MulticlassClassificationEvaluator(labelCol="label_d", metricName="f1")
    pte = model.transform(testd)
    # labels and predictions are written, so that two metrics do not make the features twice
    ptr, done = (cut_lineage(p.select("label_d", "prediction")) for p in (model.stages[-1].transform(seen), pte))
    spark = df.sparkSession
    rows = [("train_accuracy", ev_acc.evaluate(ptr)), ("test_accuracy", ev_acc.evaluate(done)),
            ("train_f1", ev_f1.evaluate(ptr)), ("test_f1", ev_f1.evaluate(done))]
    return model, spark.createDataFrame(rows, "metric string, value double"), pte


def cross_validate(df: DataFrame, text_col: str = "text", label_col: str = "label", k: int = 5, C: float = 1.0,
                   max_iter: int = 50, seed: int = 42, blocks=("tfidf",), lexicon=((), ())) -> DataFrame:
    """K stratified folds; accuracy and weighted P/R/F1 per fold (one pyspark.ml fit per fold)."""
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    f = SP.stratified_folds(cut_lineage(df), label_col, k, seed=seed)  # ranks and sizes read the rows several times
    f = SP.with_class_weights(f, label_col, "weight").withColumn("label_d", F.col(label_col).cast("double"))
    f = cut_lineage(f)  # k fits read it: checkpoint instead of recomputing the text pipeline per fold
    rows = []
    for i in range(k):
        tr, te = f.filter(F.col("fold") != i), f.filter(F.col("fold") == i)
        p = cut_lineage(_fit(tr, blocks, text_col, C, max_iter, lexicon)[0].transform(te).select("label_d", "prediction"))
        vals = [MulticlassClassificationEvaluator(labelCol="label_d", metricName=m).evaluate(p)
                for m in ("accuracy", "weightedPrecision", "weightedRecall", "f1")]
        rows.append((i, *[float(v) for v in vals]))
    return df.sparkSession.createDataFrame(rows, "fold int, accuracy double, precision double, recall double, f1 double")


def cv_summary(folds: DataFrame) -> DataFrame:
    """J2 summary: mean, population std, min, max of every fold metric."""
    out = []
    for m in ("accuracy", "precision", "recall", "f1"):
        out.append(folds.agg(F.lit(m).alias("metric"), F.avg(m).alias("mean"), F.stddev_pop(m).alias("std"),
                             F.min(m).alias("min"), F.max(m).alias("max")))
    r = out[0]
    for o in out[1:]:
        r = r.unionByName(o)
    return r


def feature_importance(model, k: int = 20) -> DataFrame:
    """Per class the k largest |coef| features, split by sign; ``block`` names the feature's block."""
    from pyspark.sql import SparkSession
    blocks = DS.column_blocks(model)
    names = [(b.name, n) for b in blocks for n in b.names]
    rows = []
    for cls, m in enumerate(model.stages[-1].models):
        coef = m.coefficients.toArray()
        order = np.argsort(-np.abs(coef), kind="stable")[:k]
        for rank, j in enumerate(order, 1):
            block, name = names[j]
            rows.append((cls, rank, name.removeprefix("tfidf_"), float(coef[j]), "positive" if coef[j] > 0 else "negative", block))
    return SparkSession.getActiveSession().createDataFrame(
        rows, "cls int, rank int, term string, coefficient double, sign string, block string")


def one_vs_rest_probabilities(margins) -> Column:
    """Class probabilities of one-vs-rest margins (array<double>): each class's own logistic
    probability over their sum; equal shares where all are 0."""
    p = F.transform(margins, lambda x: 1.0 / (1.0 + F.exp(-x)))
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return F.transform(p, lambda x: F.when(total > 0, x / total).otherwise(1.0 / F.size(margins)))


def score(model, df: DataFrame) -> DataFrame:
    """``df`` with the predicted label ``y_pred`` and the class probabilities ``proba``, for a
    classifier that gives probabilities or a one-vs-rest model's margins.  The label is the class
    of the largest probability, the lowest of equal ones."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    if "probability" in out.columns:
        out = out.withColumn("proba", vector_to_array("probability"))
    else:
        out = out.withColumn("_margins", vector_to_array("rawPrediction"))
        out = out.withColumn("proba", one_vs_rest_probabilities(F.col("_margins")))
    return out.select(*df.columns, F.col("prediction").cast("int").alias("y_pred"), "proba")


# ---------------------------------------------------------------- stored models

def save_model(model, path: str, labels: list[str], notes: dict[str, str] | None = None) -> int:
    """A fitted pipeline (vocabularies, idf and scales, classifier) with its label order and
    column ranges, as the next version under ``path``; returns the version.  The manifest row is
    written last, so a version that is listed is whole."""
    import json

    from pyspark.sql import SparkSession
    spark = SparkSession.getActiveSession()
    done = model_versions(path)
    version = 1 + (done.agg(F.max("version")).first()[0] or 0 if done is not None else 0)
    model.write().overwrite().save(f"{path}/model-{version:06d}")
    blocks = [[b.name, b.start, b.width] for b in DS.column_blocks(model)] if hasattr(model, "stages") else []
    row = (version, list(labels), json.dumps(blocks), json.dumps(notes or {}, sort_keys=True))
    spark.createDataFrame([row], "version int, labels array<string>, blocks string, notes string").coalesce(1).write.mode("append").parquet(f"{path}/manifest")
    return version


def model_versions(path: str) -> DataFrame | None:
    """The manifest under ``path``: version, labels, blocks, notes; None before the first version."""
    from pyspark.errors import AnalysisException
    from pyspark.sql import SparkSession
    try:
        return SparkSession.getActiveSession().read.parquet(f"{path}/manifest")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        return None


def load_model(path: str, version: int | None = None, kind=None):
    """(model, labels, blocks) of a version, by default the last; ``kind`` is the model's class
    (a pipeline unless given)."""
    import json

    from pyspark.ml import PipelineModel
    found = model_versions(path)
    row = found.where(F.col("version") == version).first() if found is not None and version else \
        found.orderBy(F.col("version").desc()).first() if found is not None else None
    if row is None:
        raise ValueError(f"no version {version or ''} under {path}")
    return (kind or PipelineModel).load(f"{path}/model-{row.version:06d}"), list(row.labels), json.loads(row.blocks)


def score_with_external_model(df: DataFrame, feature_cols: list[str], predict_fn: Callable[[np.ndarray], np.ndarray],
                              n_classes: int, id_col: str = "id") -> DataFrame:
    """Batched inference with an external predict function (features → logits).

    Runs per Arrow batch in ``mapInPandas``; softmax and argmax are applied to
    the returned logits (lowest class on ties)."""
    def run(it):
        for pdf in it:
            x = pdf[feature_cols].to_numpy(dtype=np.float64)
            logits = np.asarray(predict_fn(x), dtype=np.float64).reshape(len(pdf), n_classes)
            z = np.exp(logits - logits.max(axis=1, keepdims=True))
            p = z / z.sum(axis=1, keepdims=True)
            yield pd.DataFrame({id_col: pdf[id_col].to_numpy(), "y_pred": logits.argmax(axis=1).astype("int32"),
                                "proba": list(p)})
    schema = f"{id_col} {dict(df.dtypes)[id_col]}, y_pred int, proba array<double>"
    return df.select(id_col, *feature_cols).mapInPandas(run, schema)


def model_scoreboard(preds: DataFrame) -> DataFrame:
    """Accuracy per model and the best model flag (ties: model name)."""
    acc = preds.groupBy("model").agg(F.avg((F.col("y_true") == F.col("y_pred")).cast("double")).alias("accuracy"))
    best = acc.orderBy(F.col("accuracy").desc(), "model").limit(1).select(F.col("model").alias("_b"))
    return acc.join(F.broadcast(best), F.col("model") == F.col("_b"), "left") \
              .select("model", "accuracy", F.col("_b").isNotNull().alias("is_best"))
