"""Evaluation metrics (K1–K16) over a prediction table (id, y_true, y_pred, proba).

Counting metrics reduce the prediction table to the K×K confusion counts in
one partial aggregation and compute everything else from those ≤ K² rows.
Rank metrics (AUC, ROC, PR) reduce to one row per (class, distinct score)
and use ``cumulative_below`` — bucketed prefix sums — instead of a global
ordered window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nazar.operators.common import class_grid, cumulative_below

CLASSES = [0, 1, 2]


def _div(a, b):
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def confusion_matrix(preds: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """K1: (y_true, y_pred, n) for all K² cells, zeros included."""
    c = preds.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    grid = class_grid(preds.sparkSession, classes)
    return grid.join(c, ["y_true", "y_pred"], "left").select(
        "y_true", "y_pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def confusion_normalised(cm: DataFrame, by: str = "true") -> DataFrame:
    """K2: normalised by true row, predicted column or all cells (0 when empty)."""
    part = {"true": ["y_true"], "pred": ["y_pred"], "all": []}[by]
    tot = F.sum("n").over(W.partitionBy(*part))  # over ≤ K² rows
    return cm.withColumn("value", _div(F.col("n"), tot))


def class_totals(cm: DataFrame) -> DataFrame:
    """Per class: tp (diagonal), t (true count), p (predicted count)."""
    t = cm.groupBy(F.col("y_true").alias("cls")).agg(F.sum("n").alias("t"),
                                                      F.sum(F.when(F.col("y_true") == F.col("y_pred"), F.col("n"))
                                                            .otherwise(0)).alias("tp"))
    p = cm.groupBy(F.col("y_pred").alias("cls")).agg(F.sum("n").alias("p"))
    return t.join(p, "cls")


def per_class_prf(cm: DataFrame) -> DataFrame:
    """Precision / recall / F1 / support per class (0 on zero division)."""
    ct = class_totals(cm)
    prec = _div(F.col("tp"), F.col("p"))
    rec = _div(F.col("tp"), F.col("t"))
    return ct.select("cls", "tp", "t", "p", prec.alias("precision"), rec.alias("recall"),
                     _div(2 * prec * rec, prec + rec).alias("f1"), F.col("t").alias("support"))


def accuracy(preds: DataFrame) -> DataFrame:
    """K3."""
    acc = F.avg((F.col("y_true") == F.col("y_pred")).cast("double"))
    return preds.agg(acc.alias("accuracy"), (1 - acc).alias("error_rate"))


def summary_metrics(cm: DataFrame) -> DataFrame:
    """K4, K5, K7, K8 from the confusion counts: one row.

    macro = mean over classes present in y_true ∪ y_pred; weighted by
    support; micro = accuracy for single-label data.
    """
    pc = per_class_prf(cm)
    present = (F.col("t") + F.col("p")) > 0
    n = F.sum("t")
    agg = pc.agg(
        n.alias("n"), F.sum("tp").alias("d"),
        F.avg(F.when(present, F.col("precision"))).alias("precision_macro"),
        F.avg(F.when(present, F.col("recall"))).alias("recall_macro"),
        F.avg(F.when(present, F.col("f1"))).alias("f1_macro"),
        (F.sum(F.col("t") * F.col("precision")) / n).alias("precision_weighted"),
        (F.sum(F.col("t") * F.col("recall")) / n).alias("recall_weighted"),
        (F.sum(F.col("t") * F.col("f1")) / n).alias("f1_weighted"),
        F.avg(F.when(F.col("t") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.sum(F.col("t") * F.col("p")).alias("stp"), F.sum(F.col("p") * F.col("p")).alias("spp"),
        F.sum(F.col("t") * F.col("t")).alias("stt"))
    nn = F.col("n").cast("double")
    d = F.col("d").cast("double")
    mcc_den = F.sqrt((nn * nn - F.col("spp")) * (nn * nn - F.col("stt")))
    e = F.col("stp") / (nn * nn)
    return agg.select(
        (d / nn).alias("accuracy"), "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro",
        "precision_weighted", "recall_weighted", "f1_weighted",
        (d / nn).alias("precision_micro"), (d / nn).alias("recall_micro"), (d / nn).alias("f1_micro"),
        _div(d * nn - F.col("stp"), mcc_den).alias("matthews_corrcoef"),
        F.when(e != 1, (d / nn - e) / (1 - e)).otherwise(F.lit(0.0)).alias("cohen_kappa"))


def classification_report(cm: DataFrame) -> DataFrame:
    """K6: per-class rows plus 'macro avg' and 'weighted avg' rows."""
    pc = per_class_prf(cm).select(F.col("cls").cast("string").alias("label"), "precision", "recall", "f1",
                                  F.col("support").cast("bigint").alias("support"))
    present = pc.filter(F.col("support") > 0)  # noqa: F841  (macro over y_true ∪ y_pred below)
    pcs = per_class_prf(cm)
    pres = (F.col("t") + F.col("p")) > 0
    macro = pcs.agg(F.lit("macro avg").alias("label"), F.avg(F.when(pres, F.col("precision"))).alias("precision"),
                    F.avg(F.when(pres, F.col("recall"))).alias("recall"), F.avg(F.when(pres, F.col("f1"))).alias("f1"),
                    F.sum("t").cast("bigint").alias("support"))
    n = F.sum("t")
    weighted = pcs.agg(F.lit("weighted avg").alias("label"),
                       (F.sum(F.col("t") * F.col("precision")) / n).alias("precision"),
                       (F.sum(F.col("t") * F.col("recall")) / n).alias("recall"),
                       (F.sum(F.col("t") * F.col("f1")) / n).alias("f1"), n.cast("bigint").alias("support"))
    return pc.unionByName(macro).unionByName(weighted)


def accuracy_per_class(cm: DataFrame) -> DataFrame:
    """K9: recall of every class, 0 for classes absent from y_true."""
    return per_class_prf(cm).select("cls", F.col("recall").alias("accuracy"))


def class_distribution(preds: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """Share of each class in y_true and y_pred and their difference
    (full outer join of the two count tables, absent = 0)."""
    n = preds.agg(F.count(F.lit(1))).scalar()
    t = preds.groupBy(F.col("y_true").alias("cls")).agg(F.count(F.lit(1)).alias("nt"))
    p = preds.groupBy(F.col("y_pred").alias("cls")).agg(F.count(F.lit(1)).alias("np"))
    j = t.join(p, "cls", "full_outer")
    tt = F.coalesce("nt", F.lit(0)) / n
    pp = F.coalesce("np", F.lit(0)) / n
    return j.select("cls", tt.alias("true_share"), pp.alias("pred_share"), (pp - tt).alias("difference"))


def binary_metrics(cm: DataFrame) -> DataFrame:
    """One-vs-rest tp/tn/fp/fn and rates for every class."""
    ct = class_totals(cm)
    n = F.sum("t").over(W.partitionBy())  # over K rows
    tp, fn, fp = F.col("tp"), F.col("t") - F.col("tp"), F.col("p") - F.col("tp")
    tn = n - F.col("t") - F.col("p") + F.col("tp")
    out = ct.select("cls", tp.alias("tp"), fn.alias("fn"), fp.alias("fp"), tn.alias("tn"))
    return out.select("cls", "tp", "tn", "fp", "fn",
                      _div(F.col("tp"), F.col("tp") + F.col("fn")).alias("sensitivity"),
                      _div(F.col("tn"), F.col("tn") + F.col("fp")).alias("specificity"),
                      _div(F.col("tp"), F.col("tp") + F.col("fp")).alias("ppv"),
                      _div(F.col("tn"), F.col("tn") + F.col("fn")).alias("npv"),
                      _div(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"),
                      _div(F.col("fn"), F.col("fn") + F.col("tp")).alias("fnr"))


# ---------------------------------------------------------------- rank metrics

def score_groups(preds: DataFrame, classes: list[int] = CLASSES, micro: bool = False) -> DataFrame:
    """(part, score, pos, neg): one row per class and distinct score.

    Each prediction contributes K rows (its score for every class), reduced
    by a partial aggregation to the distinct scores.  ``micro`` pools all
    classes into one part.
    """
    ex = preds.select("y_true", F.posexplode_outer("proba").alias("cls", "score")).filter(F.col("cls").isNotNull())
    ex = ex.filter(F.col("cls").isin(*classes))
    part = F.lit(-1) if micro else F.col("cls")
    pos = (F.col("y_true") == F.col("cls")).cast("long")
    return ex.groupBy(part.cast("int").alias("part"), "score").agg(F.sum(pos).alias("pos"),
                                                                   F.sum(1 - pos).alias("neg"))


def roc_auc(groups: DataFrame, part_cols: list[str] = ["part"]) -> DataFrame:
    """Mann–Whitney AUC per part: Σ pos·(neg below + ½ neg tied) / (n₊ n₋)."""
    cum = cumulative_below(groups, part_cols, "score", ["neg"])
    per = cum.groupBy(*part_cols).agg(
        F.sum(F.col("pos") * (F.col("neg_below") + 0.5 * F.col("neg"))).alias("_u"),
        F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    return per.select(*part_cols, "n_pos", "n_neg",
                      F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0),
                             F.col("_u") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"))


def roc_auc_ovr(preds: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """Per-class AUC and the prevalence-weighted mean (one row per class + 'weighted')."""
    a = roc_auc(score_groups(preds, classes))
    n = F.sum("n_pos").over(W.partitionBy())
    per = a.select(F.col("part").cast("string").alias("cls"), "auc", (F.col("n_pos") / n).alias("weight"))
    w = per.agg(F.lit("weighted").alias("cls"), F.sum(F.col("auc") * F.col("weight")).alias("auc"),
                F.sum("weight").alias("weight"))
    return per.unionByName(w)


def roc_auc_ovo(preds: DataFrame, classes: list[int] = CLASSES) -> DataFrame:
    """Per class pair (i, j): ½(AUC of p_i on rows {i, j} + AUC of p_j on rows {i, j}),
    weighted by pair prevalence (t_i + t_j)/n, normalised by the weight sum."""
    spark = preds.sparkSession
    pairs = [(i, j) for i in classes for j in classes if i < j]
    # directed (pair, positive class) parts: rows of y_true ∈ {i, j} scored by p_pos
    dirs = F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), F.lit(k).alias("pos_cls"))
                     for i, j in pairs for k in (i, j)])
    ex = preds.select("y_true", "proba", F.inline(dirs)).filter(F.col("y_true").isin(F.col("a"), F.col("b")))
    pos = (F.col("y_true") == F.col("pos_cls")).cast("long")
    g = ex.groupBy("a", "b", "pos_cls", F.element_at("proba", F.col("pos_cls") + 1).alias("score")) \
          .agg(F.sum(pos).alias("pos"), F.sum(1 - pos).alias("neg"))
    auc = roc_auc(g, ["a", "b", "pos_cls"])
    pair = auc.groupBy("a", "b").agg(F.avg("auc").alias("pair_auc"), F.max(F.col("n_pos") + F.col("n_neg")).alias("m"))
    n = preds.agg(F.count(F.lit(1))).scalar()
    pw = pair.select("a", "b", "pair_auc", (F.col("m") / n).alias("weight"))
    tot = pw.agg(F.lit(-1).alias("a"), F.lit(-1).alias("b"),
                 (F.sum(F.col("pair_auc") * F.col("weight")) / F.sum("weight")).alias("pair_auc"),
                 F.sum("weight").alias("weight"))
    del spark
    return pw.unionByName(tot)


def roc_curve(groups: DataFrame) -> DataFrame:
    """(part, threshold, fpr, tpr) for every distinct score (descending
    thresholds: counts with score ≥ threshold) plus the origin point."""
    cum = cumulative_below(groups, ["part"], "score", ["pos", "neg"])
    tot = groups.groupBy("part").agg(F.sum("pos").alias("_np"), F.sum("neg").alias("_nn"))
    j = cum.join(F.broadcast(tot), "part")
    tp = F.col("_np") - F.col("pos_below")
    fp = F.col("_nn") - F.col("neg_below")
    pts = j.select("part", F.col("score").alias("threshold"), _div(fp, F.col("_nn")).alias("fpr"),
                   _div(tp, F.col("_np")).alias("tpr"))
    origin = tot.select("part", F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def pr_curve(groups: DataFrame) -> DataFrame:
    """(part, threshold, precision, recall) per distinct score."""
    cum = cumulative_below(groups, ["part"], "score", ["pos", "neg"])
    tot = groups.groupBy("part").agg(F.sum("pos").alias("_np"), F.sum("neg").alias("_nn"))
    j = cum.join(F.broadcast(tot), "part")
    tp = F.col("_np") - F.col("pos_below")
    fp = F.col("_nn") - F.col("neg_below")
    return j.select("part", F.col("score").alias("threshold"), _div(tp, tp + fp).alias("precision"),
                    _div(tp, F.col("_np")).alias("recall"), "pos")


def average_precision(groups: DataFrame) -> DataFrame:
    """AP = Σ (R_i − R_{i−1})·P_i over descending thresholds; ΔR at a
    score group is its positives / n₊, so no ordered lag is needed."""
    pr = pr_curve(groups)
    tot = groups.groupBy("part").agg(F.sum("pos").alias("_np"))
    j = pr.join(F.broadcast(tot), "part")
    return j.groupBy("part").agg(F.sum(_div(F.col("pos"), F.col("_np")) * F.col("precision")).alias("average_precision"))


def threshold_gate(metrics: DataFrame, thresholds: dict[str, float]) -> DataFrame:
    """Metric rows (metric, value) vs minimum / excellent thresholds."""
    spark = metrics.sparkSession
    mins = {k.replace("minimum_", ""): v for k, v in thresholds.items() if k.startswith("minimum_")}
    exc = {k.replace("excellent_", ""): v for k, v in thresholds.items() if k.startswith("excellent_")}
    rows = [(m, mins.get(m), exc.get(m)) for m in sorted(set(mins) | set(exc))]
    th = spark.createDataFrame(rows, "metric string, minimum double, excellent double")
    j = metrics.join(F.broadcast(th), "metric")
    status = (F.when(F.col("excellent").isNotNull() & (F.col("value") >= F.col("excellent")), "excellent")
              .when(F.col("value") >= F.col("minimum"), "pass").otherwise("fail"))
    return j.select("metric", "value", "minimum", "excellent", status.alias("status"))
