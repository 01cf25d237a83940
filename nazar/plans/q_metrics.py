"""Registered queries: evaluation metrics (K*) on the prediction fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from nazar.functions import lexicons as LX
from nazar.functions.mathx import rnd, rnd_sql
from nazar.operators import metrics as M
from nazar.plans import fixtures as X
from nazar.plans.registry import query

MODEL = "logistic"


def preds(spark, sf, model=MODEL):
    return X.predictions(spark, sf, [model])


P_CTE = f"p AS (SELECT * FROM predictions WHERE model = '{MODEL}')"
CLS = "(VALUES (0), (1), (2)) c(cls)"
CM_SQL = f"""{P_CTE},
grid AS (SELECT CAST(a.v AS INTEGER) AS y_true, CAST(b.v AS INTEGER) AS y_pred
         FROM (VALUES (0), (1), (2)) a(v), (VALUES (0), (1), (2)) b(v)),
cnt AS (SELECT y_true, y_pred, count(*) AS n FROM p GROUP BY ALL),
cm AS (SELECT g.y_true, g.y_pred, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n FROM grid g
       LEFT JOIN cnt ON g.y_true = cnt.y_true AND g.y_pred = cnt.y_pred),
ct AS (SELECT t.cls, t.t, t.tp, p2.p FROM
        (SELECT y_true AS cls, sum(n) AS t, sum(CASE WHEN y_true = y_pred THEN n ELSE 0 END) AS tp FROM cm GROUP BY 1) t
        JOIN (SELECT y_pred AS cls, sum(n) AS p FROM cm GROUP BY 1) p2 ON t.cls = p2.cls),
prf AS (SELECT cls, t, p, tp,
          CASE WHEN p <> 0 THEN tp / p ELSE 0.0 END AS precision,
          CASE WHEN t <> 0 THEN tp / t ELSE 0.0 END AS recall FROM ct),
prf2 AS (SELECT *, CASE WHEN precision + recall <> 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1
         FROM prf)"""


def _cm(spark, sf):
    return M.confusion_matrix(preds(spark, sf))


@query("confusion_matrix", "K1", f"WITH {CM_SQL} SELECT y_true, y_pred, n FROM cm", ("predictions",))
def q_confusion_matrix(spark, sf):
    return _cm(spark, sf)


@query("confusion_normalised", "K2", f"""WITH {CM_SQL}
SELECT y_true, y_pred, n, CASE WHEN sum(n) OVER (PARTITION BY y_true) <> 0 THEN n / sum(n) OVER (PARTITION BY y_true)
  ELSE 0.0 END AS value FROM cm""", ("predictions",))
def q_confusion_normalised(spark, sf):
    return M.confusion_normalised(_cm(spark, sf), "true")


for _by, _part in (("pred", "PARTITION BY y_pred"), ("all", "")):
    def _mk_norm(by=_by):
        def fn(spark, sf):
            return M.confusion_normalised(_cm(spark, sf), by)
        return fn
    query(f"confusion_normalised_{_by}", "K2", f"""WITH {CM_SQL}
SELECT y_true, y_pred, n, CASE WHEN sum(n) OVER ({_part}) <> 0 THEN n / sum(n) OVER ({_part}) ELSE 0.0 END AS value FROM cm""", ("predictions",))(_mk_norm())


@query("accuracy", "K3", f"""WITH {P_CTE}
SELECT avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy, 1 - avg(CAST(y_true = y_pred AS DOUBLE)) AS error_rate FROM p""",
       ("predictions",))
def q_accuracy(spark, sf):
    return M.accuracy(preds(spark, sf))


_SUMMARY_COLS = ["accuracy", "balanced_accuracy", "precision_macro", "recall_macro", "f1_macro", "precision_weighted",
                 "recall_weighted", "f1_weighted", "precision_micro", "recall_micro", "f1_micro", "matthews_corrcoef",
                 "cohen_kappa"]


@query("summary_metrics", "K5", f"""WITH {CM_SQL},
a AS (SELECT sum(t) AS n, sum(tp) AS d,
        avg(CASE WHEN t + p > 0 THEN precision END) AS precision_macro, avg(CASE WHEN t + p > 0 THEN recall END) AS recall_macro,
        avg(CASE WHEN t + p > 0 THEN f1 END) AS f1_macro,
        sum(t * precision) / sum(t) AS precision_weighted, sum(t * recall) / sum(t) AS recall_weighted,
        sum(t * f1) / sum(t) AS f1_weighted, avg(CASE WHEN t > 0 THEN recall END) AS balanced_accuracy,
        sum(t * p) AS stp, sum(p * p) AS spp, sum(t * t) AS stt FROM prf2),
b AS (SELECT *, CAST(n AS DOUBLE) AS nn, CAST(d AS DOUBLE) AS dd FROM a)
SELECT {rnd_sql('dd / nn', 9)} AS accuracy, {rnd_sql('balanced_accuracy', 9)} AS balanced_accuracy,
  {rnd_sql('precision_macro', 9)} AS precision_macro, {rnd_sql('recall_macro', 9)} AS recall_macro,
  {rnd_sql('f1_macro', 9)} AS f1_macro, {rnd_sql('precision_weighted', 9)} AS precision_weighted,
  {rnd_sql('recall_weighted', 9)} AS recall_weighted, {rnd_sql('f1_weighted', 9)} AS f1_weighted,
  {rnd_sql('dd / nn', 9)} AS precision_micro, {rnd_sql('dd / nn', 9)} AS recall_micro, {rnd_sql('dd / nn', 9)} AS f1_micro,
  {rnd_sql('CASE WHEN sqrt((nn * nn - spp) * (nn * nn - stt)) <> 0 THEN (dd * nn - stp) / sqrt((nn * nn - spp) * (nn * nn - stt)) ELSE 0.0 END', 9)} AS matthews_corrcoef,
  {rnd_sql('CASE WHEN stp / (nn * nn) <> 1 THEN (dd / nn - stp / (nn * nn)) / (1 - stp / (nn * nn)) ELSE 0.0 END', 9)} AS cohen_kappa
FROM b""", ("predictions",))
def q_summary_metrics(spark, sf):
    s = M.summary_metrics(_cm(spark, sf))
    return s.select(*[rnd(F.col(c), 9).alias(c) for c in _SUMMARY_COLS])


@query("classification_report", "K6", f"""WITH {CM_SQL}
SELECT CAST(cls AS VARCHAR) AS label, {rnd_sql('precision', 9)} AS precision, {rnd_sql('recall', 9)} AS recall,
  {rnd_sql('f1', 9)} AS f1, CAST(t AS BIGINT) AS support FROM prf2
UNION ALL SELECT 'macro avg', {rnd_sql('avg(CASE WHEN t + p > 0 THEN precision END)', 9)},
  {rnd_sql('avg(CASE WHEN t + p > 0 THEN recall END)', 9)}, {rnd_sql('avg(CASE WHEN t + p > 0 THEN f1 END)', 9)},
  CAST(sum(t) AS BIGINT) FROM prf2
UNION ALL SELECT 'weighted avg', {rnd_sql('sum(t * precision) / sum(t)', 9)}, {rnd_sql('sum(t * recall) / sum(t)', 9)},
  {rnd_sql('sum(t * f1) / sum(t)', 9)}, CAST(sum(t) AS BIGINT) FROM prf2""", ("predictions",))
def q_classification_report(spark, sf):
    r = M.classification_report(_cm(spark, sf))
    return r.select("label", *[rnd(F.col(c), 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("balanced_accuracy", "K4", f"""WITH {CM_SQL}
SELECT {rnd_sql('avg(CASE WHEN t > 0 THEN recall END)', 9)} AS balanced_accuracy FROM prf2""", ("predictions",))
def q_balanced_accuracy(spark, sf):
    return M.summary_metrics(_cm(spark, sf)).select(rnd(F.col("balanced_accuracy"), 9).alias("balanced_accuracy"))


@query("matthews_kappa", "K7", f"""WITH {CM_SQL},
a AS (SELECT CAST(sum(t) AS DOUBLE) AS nn, CAST(sum(tp) AS DOUBLE) AS dd, sum(t * p) AS stp, sum(p * p) AS spp,
        sum(t * t) AS stt FROM prf2)
SELECT {rnd_sql('CASE WHEN sqrt((nn * nn - spp) * (nn * nn - stt)) <> 0 THEN (dd * nn - stp) / sqrt((nn * nn - spp) * (nn * nn - stt)) ELSE 0.0 END', 9)} AS matthews_corrcoef,
  {rnd_sql('CASE WHEN stp / (nn * nn) <> 1 THEN (dd / nn - stp / (nn * nn)) / (1 - stp / (nn * nn)) ELSE 0.0 END', 9)} AS cohen_kappa
FROM a""", ("predictions",))
def q_matthews_kappa(spark, sf):
    s = M.summary_metrics(_cm(spark, sf))
    return s.select(rnd(F.col("matthews_corrcoef"), 9).alias("matthews_corrcoef"),
                    rnd(F.col("cohen_kappa"), 9).alias("cohen_kappa"))


@query("accuracy_per_class", "K9", f"WITH {CM_SQL} SELECT cls, recall AS accuracy FROM prf2", ("predictions",))
def q_accuracy_per_class(spark, sf):
    return M.accuracy_per_class(_cm(spark, sf))


@query("class_distribution", "K10", f"""WITH {P_CTE},
t AS (SELECT y_true AS cls, count(*) AS nt FROM p GROUP BY 1), q AS (SELECT y_pred AS cls, count(*) AS np FROM p GROUP BY 1)
SELECT coalesce(t.cls, q.cls) AS cls, coalesce(nt, 0) / (SELECT count(*) FROM p) AS true_share,
  coalesce(np, 0) / (SELECT count(*) FROM p) AS pred_share,
  coalesce(np, 0) / (SELECT count(*) FROM p) - coalesce(nt, 0) / (SELECT count(*) FROM p) AS difference
FROM t FULL OUTER JOIN q ON t.cls = q.cls""", ("predictions",))
def q_class_distribution(spark, sf):
    return M.class_distribution(preds(spark, sf))


@query("binary_metrics", "K11", f"""WITH {CM_SQL},
b AS (SELECT cls, CAST(tp AS BIGINT) AS tp, CAST(t - tp AS BIGINT) AS fn, CAST(p - tp AS BIGINT) AS fp,
        CAST(sum(t) OVER () - t - p + tp AS BIGINT) AS tn FROM ct)
SELECT cls, tp, tn, fp, fn, CASE WHEN tp + fn <> 0 THEN tp / (tp + fn) ELSE 0.0 END AS sensitivity,
  CASE WHEN tn + fp <> 0 THEN tn / (tn + fp) ELSE 0.0 END AS specificity,
  CASE WHEN tp + fp <> 0 THEN tp / (tp + fp) ELSE 0.0 END AS ppv, CASE WHEN tn + fn <> 0 THEN tn / (tn + fn) ELSE 0.0 END AS npv,
  CASE WHEN fp + tn <> 0 THEN fp / (fp + tn) ELSE 0.0 END AS fpr, CASE WHEN fn + tp <> 0 THEN fn / (fn + tp) ELSE 0.0 END AS fnr
FROM b""", ("predictions",))
def q_binary_metrics(spark, sf):
    return M.binary_metrics(_cm(spark, sf))


def groups_sql(micro=False):
    part = "-1" if micro else "c.cls"
    return f"""{P_CTE},
ex AS (SELECT p.y_true, c.cls, p.proba[c.cls + 1] AS score FROM p, {CLS}),
g AS (SELECT CAST({part} AS INTEGER) AS part, score, CAST(sum(CASE WHEN y_true = cls THEN 1 ELSE 0 END) AS BIGINT) AS pos,
        CAST(sum(CASE WHEN y_true <> cls THEN 1 ELSE 0 END) AS BIGINT) AS neg FROM ex c GROUP BY ALL),
cu AS (SELECT *, coalesce(sum(pos) OVER w, 0) AS pos_below, coalesce(sum(neg) OVER w, 0) AS neg_below,
          sum(pos) OVER (PARTITION BY part) AS np, sum(neg) OVER (PARTITION BY part) AS nn FROM g
       WINDOW w AS (PARTITION BY part ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


AUC_SQL = "CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN sum(pos * (neg_below + 0.5 * neg)) / (sum(pos) * sum(neg)) END"


@query("roc_auc_ovr", "K12", f"""WITH {groups_sql()},
a AS (SELECT part, {AUC_SQL} AS auc, sum(pos) AS n_pos FROM cu GROUP BY part),
per AS (SELECT CAST(part AS VARCHAR) AS cls, auc, n_pos / sum(n_pos) OVER () AS weight FROM a)
SELECT cls, {rnd_sql('auc', 9)} AS auc, {rnd_sql('weight', 9)} AS weight FROM per
UNION ALL SELECT 'weighted', {rnd_sql('sum(auc * weight)', 9)}, {rnd_sql('sum(weight)', 9)} FROM per""", ("predictions",))
def q_roc_auc_ovr(spark, sf):
    r = M.roc_auc_ovr(preds(spark, sf))
    return r.select("cls", rnd(F.col("auc"), 9).alias("auc"), rnd(F.col("weight"), 9).alias("weight"))


@query("roc_auc_micro", "K12", f"""WITH {groups_sql(True)}
SELECT part, CAST(sum(pos) AS BIGINT) AS n_pos, CAST(sum(neg) AS BIGINT) AS n_neg, {rnd_sql(AUC_SQL, 9)} AS auc
FROM cu GROUP BY part""", ("predictions",))
def q_roc_auc_micro(spark, sf):
    a = M.roc_auc(M.score_groups(preds(spark, sf), micro=True))
    return a.select("part", "n_pos", "n_neg", rnd(F.col("auc"), 9).alias("auc"))


@query("roc_auc_ovo", "K13", f"""WITH {P_CTE},
dirs AS (SELECT * FROM (VALUES (0, 1, 0), (0, 1, 1), (0, 2, 0), (0, 2, 2), (1, 2, 1), (1, 2, 2)) d(a, b, pos_cls)),
ex AS (SELECT d.a, d.b, d.pos_cls, p.y_true, p.proba[d.pos_cls + 1] AS score FROM p, dirs d WHERE p.y_true IN (d.a, d.b)),
g AS (SELECT a, b, pos_cls, score, sum(CASE WHEN y_true = pos_cls THEN 1 ELSE 0 END) AS pos,
        sum(CASE WHEN y_true <> pos_cls THEN 1 ELSE 0 END) AS neg FROM ex GROUP BY ALL),
cu AS (SELECT *, coalesce(sum(neg) OVER (PARTITION BY a, b, pos_cls ORDER BY score
                                         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below FROM g),
au AS (SELECT a, b, pos_cls, {AUC_SQL} AS auc, sum(pos) + sum(neg) AS m FROM cu GROUP BY ALL),
pw AS (SELECT a, b, avg(auc) AS pair_auc, max(m) / (SELECT count(*) FROM p) AS weight FROM au GROUP BY a, b)
SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b, {rnd_sql('pair_auc', 9)} AS pair_auc, {rnd_sql('weight', 9)} AS weight FROM pw
UNION ALL SELECT -1, -1, {rnd_sql('sum(pair_auc * weight) / sum(weight)', 9)}, {rnd_sql('sum(weight)', 9)} FROM pw""",
       ("predictions",))
def q_roc_auc_ovo(spark, sf):
    r = M.roc_auc_ovo(preds(spark, sf))
    return r.select(F.col("a").cast("int").alias("a"), F.col("b").cast("int").alias("b"),
                    rnd(F.col("pair_auc"), 9).alias("pair_auc"), rnd(F.col("weight"), 9).alias("weight"))


@query("roc_curve", "K14", f"""WITH {groups_sql()}
SELECT part, score AS threshold, CASE WHEN nn <> 0 THEN (nn - neg_below) / nn ELSE 0.0 END AS fpr,
  CASE WHEN np <> 0 THEN (np - pos_below) / np ELSE 0.0 END AS tpr FROM cu
UNION ALL SELECT DISTINCT part, 'inf'::DOUBLE, 0.0, 0.0 FROM g""", ("predictions",))
def q_roc_curve(spark, sf):
    return M.roc_curve(M.score_groups(preds(spark, sf)))


@query("roc_curve_micro", "K14", f"""WITH {groups_sql(True)}
SELECT part, score AS threshold, CASE WHEN nn <> 0 THEN (nn - neg_below) / nn ELSE 0.0 END AS fpr,
  CASE WHEN np <> 0 THEN (np - pos_below) / np ELSE 0.0 END AS tpr FROM cu
UNION ALL SELECT DISTINCT part, 'inf'::DOUBLE, 0.0, 0.0 FROM g""", ("predictions",))
def q_roc_curve_micro(spark, sf):
    return M.roc_curve(M.score_groups(preds(spark, sf), micro=True))


@query("pr_curve", "K15", f"""WITH {groups_sql()}
SELECT part, score AS threshold,
  CASE WHEN (np - pos_below) + (nn - neg_below) <> 0 THEN (np - pos_below) / ((np - pos_below) + (nn - neg_below)) ELSE 0.0 END
    AS precision, CASE WHEN np <> 0 THEN (np - pos_below) / np ELSE 0.0 END AS recall, pos FROM cu""", ("predictions",))
def q_pr_curve(spark, sf):
    return M.pr_curve(M.score_groups(preds(spark, sf)))


def _ap_sql(micro):
    return f"""WITH {groups_sql(micro)},
pr AS (SELECT part, pos, np, CASE WHEN (np - pos_below) + (nn - neg_below) <> 0
         THEN (np - pos_below) / ((np - pos_below) + (nn - neg_below)) ELSE 0.0 END AS precision FROM cu)
SELECT part, {rnd_sql('sum(CASE WHEN np <> 0 THEN pos / np ELSE 0.0 END * precision)', 9)} AS average_precision
FROM pr GROUP BY part"""


@query("average_precision", "K15", _ap_sql(False), ("predictions",))
def q_average_precision(spark, sf):
    a = M.average_precision(M.score_groups(preds(spark, sf)))
    return a.select("part", rnd(F.col("average_precision"), 9).alias("average_precision"))


@query("average_precision_micro", "K15", _ap_sql(True), ("predictions",))
def q_average_precision_micro(spark, sf):
    a = M.average_precision(M.score_groups(preds(spark, sf), micro=True))
    return a.select("part", rnd(F.col("average_precision"), 9).alias("average_precision"))


_GATE_METRICS = [("accuracy", "accuracy"), ("f1", "f1_weighted"), ("precision", "precision_weighted"),
                 ("recall", "recall_weighted")]


@query("threshold_gate", "K16", f"""WITH {CM_SQL},
s AS (SELECT sum(tp) / sum(t) AS accuracy, sum(t * f1) / sum(t) AS f1, sum(t * precision) / sum(t) AS precision,
        sum(t * recall) / sum(t) AS recall FROM prf2),
m AS (SELECT 'accuracy' AS metric, accuracy AS value FROM s UNION ALL SELECT 'f1', f1 FROM s
      UNION ALL SELECT 'precision', precision FROM s UNION ALL SELECT 'recall', recall FROM s),
th AS (SELECT * FROM (VALUES ('accuracy', 0.7, 0.85), ('f1', 0.65, 0.8), ('precision', 0.6, NULL), ('recall', 0.6, NULL))
       t(metric, minimum, excellent))
SELECT m.metric, {rnd_sql('m.value', 9)} AS value, CAST(minimum AS DOUBLE) AS minimum, CAST(excellent AS DOUBLE) AS excellent,
  CASE WHEN excellent IS NOT NULL AND {rnd_sql('m.value', 9)} >= excellent THEN 'excellent'
       WHEN {rnd_sql('m.value', 9)} >= minimum THEN 'pass' ELSE 'fail' END AS status
FROM m JOIN th USING (metric)""", ("predictions",))
def q_threshold_gate(spark, sf):
    s = M.summary_metrics(_cm(spark, sf))
    rows = None
    for name, col in _GATE_METRICS:
        one = s.select(F.lit(name).alias("metric"), rnd(F.col(col), 9).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return M.threshold_gate(rows, LX.PERFORMANCE_THRESHOLDS)


@query("cohen_kappa", "K8", f"""WITH {CM_SQL},
a AS (SELECT CAST(sum(t) AS DOUBLE) AS nn, CAST(sum(tp) AS DOUBLE) AS dd, sum(t * p) AS stp FROM prf2)
SELECT {rnd_sql('CASE WHEN stp / (nn * nn) <> 1 THEN (dd / nn - stp / (nn * nn)) / (1 - stp / (nn * nn)) ELSE 0.0 END', 9)} AS cohen_kappa
FROM a""", ("predictions",))
def q_cohen_kappa(spark, sf):
    return M.summary_metrics(_cm(spark, sf)).select(rnd(F.col("cohen_kappa"), 9).alias("cohen_kappa"))
