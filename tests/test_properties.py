"""Properties of the operators on the smallest fixture."""

import numpy as np
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from nazar.functions import text as T
from nazar.operators import common as CM
from nazar.operators import metrics as M
from nazar.operators import split as SP
from nazar.plans import fixtures as X
from nazar.plans.q_features import fitted

from .conftest import SF001


def test_clean_idempotent(spark):
    r = X.reviews(spark, SF001)
    once = r.select(T.clean_text(F.col("comment"), "medium").alias("a"))
    bad = once.filter(T.clean_text(F.col("a"), "medium") != F.col("a")).count()
    assert bad == 0


def test_confusion_and_micro(spark):
    p = X.predictions(spark, SF001, ["logistic"])
    cm = M.confusion_matrix(p)
    assert cm.count() == 9
    assert cm.agg(F.sum("n")).first()[0] == p.count()
    s = M.summary_metrics(cm).first()
    assert abs(s["precision_micro"] - s["accuracy"]) < 1e-12


def test_auc_symmetry(spark):
    p = X.predictions(spark, SF001, ["logistic"])
    g = M.score_groups(p)
    a = {r["part"]: r["auc"] for r in M.roc_auc(g).collect()}
    flipped = g.withColumn("score", -F.col("score"))
    b = {r["part"]: r["auc"] for r in M.roc_auc(flipped).collect()}
    for k in a:
        assert abs(a[k] + b[k] - 1.0) < 1e-9


def test_tfidf_unit_rows(spark):
    _, _, w = fitted(spark, SF001)
    n = w.groupBy("id").agg(F.sqrt(F.sum(F.col("weight") ** 2)).alias("n"))
    assert n.filter(F.abs(F.col("n") - 1.0) > 1e-9).count() == 0


def test_splits_disjoint_and_folds_balanced(spark):
    lab = X.review_labels(spark, SF001)
    s = SP.three_way_split(lab, "sentiment_label")
    assert s.count() == lab.count() and s.select("id").distinct().count() == lab.count()
    f = SP.stratified_folds(lab, "sentiment_label", 5)
    sizes = f.groupBy("sentiment_label", "fold").count().groupBy("sentiment_label").agg(
        (F.max("count") - F.min("count")).alias("d"))
    assert sizes.filter(F.col("d") > 1).count() == 0


def test_cumulative_below_matches_window(spark):
    rng = np.random.default_rng(1)
    rows = [(int(p), float(s), int(v)) for p, s, v in zip(rng.integers(0, 3, 400), rng.random(400).round(2),
                                                           rng.integers(0, 5, 400))]
    df = spark.createDataFrame(rows, "part int, score double, v long").groupBy("part", "score").agg(F.sum("v").alias("v"))
    got = CM.cumulative_below(df, ["part"], "score", ["v"], buckets=8)
    w = W.partitionBy("part").orderBy("score").rowsBetween(W.unboundedPreceding, -1)
    ref = df.withColumn("ref", F.coalesce(F.sum("v").over(w), F.lit(0)))
    j = got.join(ref, ["part", "score"])
    assert j.filter(F.col("v_below") != F.col("ref")).count() == 0
    assert j.count() == df.count()


def test_global_row_number(spark):
    df = spark.range(0, 500).withColumn("k", (F.col("id") * 7919) % 1000)
    got = CM.global_row_number(df.repartition(7), ["k"], "rn")
    ref = got.withColumn("ref", F.row_number().over(W.orderBy("k")))
    assert ref.filter(F.col("rn") != F.col("ref")).count() == 0


def test_global_row_number_many_partitions(spark):
    """Rows spread over many partitions, a wide payload and tied keys: no row lost, numbers 1..n,
    in the order of a plain window."""
    from pyspark.sql import Window as W
    from nazar.operators.common import global_row_number
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        n = 200_000
        df = spark.range(n, numPartitions=16).select(
            (F.xxhash64("id") % 50_000).alias("k"), "id", F.repeat(F.sha2(F.col("id").cast("string"), 256), 4).alias("wide"))
        got = global_row_number(df, ["k", "id"], "rn")
        want = df.select("id", F.row_number().over(W.orderBy("k", "id")).cast("long").alias("want"))
        both = got.join(want, "id")
        r = both.agg(F.count("*").alias("n"), F.count_distinct("rn").alias("d"), F.max("rn").alias("m"),
                     F.sum((F.col("rn") != F.col("want")).cast("int")).alias("bad")).first()
        assert (r.n, r.d, r.m, r.bad) == (n, n, n, 0)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
