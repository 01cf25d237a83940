"""Registered queries: ensembles (M*) and stratified splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from nazar.functions.mathx import rnd, rnd_sql
from nazar.operators import ensemble as EN
from nazar.operators import split as SP
from nazar.plans import fixtures as X
from nazar.plans.registry import query

MODELS = [m[0] for m in X.MODEL_SCORES]
WEIGHTS = [0.5, 0.3, 0.2]
_ORD = "CASE model " + " ".join(f"WHEN '{m}' THEN {i}" for i, m in enumerate(MODELS)) + " END"


def all_preds(spark, sf):
    return X.predictions(spark, sf)


# ---------------------------------------------------------------- I6–I9

def labelled(spark, sf):
    return X.review_labels(spark, sf)


RANK_SQL = """WITH r AS (SELECT id, sentiment_label,
    row_number() OVER (PARTITION BY sentiment_label ORDER BY md5('42:' || CAST(id AS VARCHAR)), id) AS rank,
    count(*) OVER (PARTITION BY sentiment_label) AS m FROM review_labels)"""


@query("stratified_split", "I6", RANK_SQL + """
SELECT id, sentiment_label, CASE WHEN rank <= ceil(0.2 * m) THEN 'test' ELSE 'train' END AS split FROM r""",
       ("review_labels",))
def q_stratified_split(spark, sf):
    return SP.stratified_split(labelled(spark, sf), "sentiment_label").select("id", "sentiment_label", "split")


@query("three_way_split", "I7", RANK_SQL + """
SELECT id, sentiment_label, CASE WHEN rank <= ceil(0.2 * m) THEN 'test'
  WHEN rank <= ceil(0.2 * m) + ceil(0.125 * (m - ceil(0.2 * m))) THEN 'val' ELSE 'train' END AS split FROM r""",
       ("review_labels",))
def q_three_way_split(spark, sf):
    return SP.three_way_split(labelled(spark, sf), "sentiment_label").select("id", "sentiment_label", "split")


@query("stratified_folds", "I8", RANK_SQL + """
SELECT id, sentiment_label, CAST((rank - 1) % 5 AS INTEGER) AS fold FROM r""", ("review_labels",))
def q_stratified_folds(spark, sf):
    return SP.stratified_folds(labelled(spark, sf), "sentiment_label", 5).select("id", "sentiment_label", "fold")


@query("class_weights", "I9", """
SELECT sentiment_label, count(*) AS m, (SELECT count(*) FROM review_labels) / ((SELECT count(DISTINCT sentiment_label)
  FROM review_labels) * count(*)) AS weight FROM review_labels GROUP BY sentiment_label""", ("review_labels",))
def q_class_weights(spark, sf):
    return SP.class_weights(labelled(spark, sf), "sentiment_label")


# ---------------------------------------------------------------- M

PRED_CTE = f"""p AS (SELECT * FROM predictions WHERE model IN ({", ".join(f"'{m}'" for m in MODELS)})),
complete_ids AS (SELECT id FROM p GROUP BY id HAVING count(DISTINCT model) = {len(MODELS)}),
a AS (SELECT p.* FROM p JOIN complete_ids USING (id)),
cp AS (SELECT id, model, y_true, unnest(proba) AS p, unnest(range(0, len(proba))) AS cls FROM a)"""


@query("collect_predictions", "M1", f"WITH {PRED_CTE} SELECT id, model, y_true, y_pred FROM a", ("predictions",))
def q_collect_predictions(spark, sf):
    return EN.collect_predictions(all_preds(spark, sf), MODELS).select("id", "model", "y_true", "y_pred")


@query("hard_vote", "M2", f"""WITH {PRED_CTE},
v AS (SELECT id, y_true, y_pred, count(*) AS votes, min({_ORD}) AS first FROM a GROUP BY ALL)
SELECT id, y_true, y_pred AS ensemble_pred, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, first) AS r FROM v) WHERE r = 1""", ("predictions",))
def q_hard_vote(spark, sf):
    return EN.hard_vote(all_preds(spark, sf), MODELS)


def _soft_ctes(weights):
    w = "CASE model " + " ".join(f"WHEN '{m}' THEN {float(x)!r}" for m, x in zip(MODELS, weights)) + " END"
    return f"""s AS (SELECT id, y_true, cls, {rnd_sql(f'sum(p * {w}) / {len(MODELS)}', 12)} AS avg_p FROM cp GROUP BY id, y_true, cls),
sv AS (SELECT id, y_true, CAST(cls AS INTEGER) AS ensemble_pred, avg_p AS confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY avg_p DESC, cls) AS r FROM s) WHERE r = 1)"""


def _soft_sql(weights):
    return f"WITH {PRED_CTE},\n{_soft_ctes(weights)}\nSELECT * FROM sv"


@query("soft_vote", "M3", _soft_sql([1.0] * len(MODELS)), ("predictions",))
def q_soft_vote(spark, sf):
    return EN.weighted_soft_vote(all_preds(spark, sf), MODELS)


@query("weighted_soft_vote", "M4", _soft_sql(WEIGHTS), ("predictions",))
def q_weighted_soft_vote(spark, sf):
    return EN.weighted_soft_vote(all_preds(spark, sf), MODELS, WEIGHTS)


def _search_sql(grid):
    rows = " UNION ALL ".join(f"SELECT {i} AS wid, '{m}' AS model, {float(w)!r}::DOUBLE AS w" for i, ws in enumerate(grid) for m, w in zip(MODELS, ws))
    arrays = " UNION ALL ".join(f"SELECT {i} AS wid, [{', '.join(f'{float(x)!r}::DOUBLE' for x in ws)}] AS weights" for i, ws in enumerate(grid))
    return f"""WITH {PRED_CTE},
g AS ({rows}), ga AS ({arrays}),
s AS (SELECT g.wid, cp.id, cp.y_true, cp.cls, {rnd_sql('sum(g.w * cp.p)', 12)} AS wp FROM cp JOIN g USING (model)
      GROUP BY g.wid, cp.id, cp.y_true, cp.cls),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY wid, id ORDER BY wp DESC, cls) AS r FROM s) WHERE r = 1),
acc AS (SELECT wid, avg(CAST(cls = y_true AS DOUBLE)) AS accuracy FROM top GROUP BY wid),
best AS (SELECT wid FROM acc ORDER BY accuracy DESC, wid LIMIT 1)
SELECT CAST(acc.wid AS INTEGER) AS wid, ga.weights, accuracy, acc.wid IN (SELECT wid FROM best) AS is_best
FROM acc JOIN ga USING (wid)"""


@query("search_weights", "M5", _search_sql(EN.weight_grid(len(MODELS))), ("predictions",))
def q_search_weights(spark, sf):
    return EN.search_weights(all_preds(spark, sf), MODELS)


@query("search_weights_random", "M5", _search_sql(EN.random_weight_grid(len(MODELS))), ("predictions",))
def q_search_weights_random(spark, sf):
    return EN.search_weights(all_preds(spark, sf), MODELS, EN.random_weight_grid(len(MODELS)))


def _f1w_sql(src):
    return f"""(SELECT avg(CAST(y_true = y_pred AS DOUBLE)) AS accuracy, (
  SELECT sum(t * f1) / sum(t) FROM (
    SELECT t.cls, t.t, CASE WHEN pr + rc <> 0 THEN 2 * pr * rc / (pr + rc) ELSE 0.0 END AS f1 FROM (
      SELECT c.cls, coalesce(tt.t, 0) AS t,
        CASE WHEN coalesce(pp.p, 0) <> 0 THEN coalesce(tp.tp, 0) / pp.p ELSE 0.0 END AS pr,
        CASE WHEN coalesce(tt.t, 0) <> 0 THEN coalesce(tp.tp, 0) / tt.t ELSE 0.0 END AS rc
      FROM (VALUES (0), (1), (2)) c(cls)
      LEFT JOIN (SELECT y_true AS cls, count(*) AS t FROM {src} GROUP BY 1) tt ON c.cls = tt.cls
      LEFT JOIN (SELECT y_pred AS cls, count(*) AS p FROM {src} GROUP BY 1) pp ON c.cls = pp.cls
      LEFT JOIN (SELECT y_true AS cls, count(*) AS tp FROM {src} WHERE y_true = y_pred GROUP BY 1) tp ON c.cls = tp.cls) t)
  ) AS f1_weighted FROM {src})"""


_REPORT_ROWS = " UNION ALL ".join([f"SELECT '{m}' AS model, x.* FROM {_f1w_sql(f'(SELECT y_true, y_pred FROM a WHERE model = {chr(39)}{m}{chr(39)})')} x" for m in MODELS] + [f"SELECT 'ensemble', x.* FROM {_f1w_sql('(SELECT y_true, ensemble_pred AS y_pred FROM sv)')} x"])


@query("ensemble_report", "M6", f"""WITH {PRED_CTE},
{_soft_ctes([1.0] * len(MODELS))},
r AS ({_REPORT_ROWS})
SELECT model, {rnd_sql('accuracy', 9)} AS accuracy, {rnd_sql('f1_weighted', 9)} AS f1_weighted,
  {rnd_sql("accuracy - (SELECT max(accuracy) FROM r WHERE model <> 'ensemble')", 9)} AS improvement_over_best FROM r""",
       ("predictions",))
def q_ensemble_report(spark, sf):
    p = all_preds(spark, sf)
    e = EN.weighted_soft_vote(p, MODELS)
    r = EN.ensemble_report(p, MODELS, e)
    return r.select("model", rnd(F.col("accuracy"), 9).alias("accuracy"), rnd(F.col("f1_weighted"), 9).alias("f1_weighted"),
                    rnd(F.col("improvement_over_best"), 9).alias("improvement_over_best"))


@query("meta_features", "M7", f"""WITH {PRED_CTE}
SELECT id, y_true, """ + ", ".join(
    f"max(CASE WHEN model = '{m}' THEN proba[{k + 1}] END) AS {m}_{k}" for m in MODELS for k in range(3)) +
       " FROM a GROUP BY id, y_true", ("predictions",))
def q_meta_features(spark, sf):
    return EN.meta_features(all_preds(spark, sf), MODELS)


META = [f"{m}_{k}" for m in MODELS for k in range(3)]


def _stacked(spark, sf, learner):
    return EN.stacked(EN.meta_features(all_preds(spark, sf), MODELS), META, learner, folds=5)


for _name, _learner in (("stacked", "logistic"), ("stacked_rf", "rf"), ("stacked_gbt", "gbt")):
    def _mk_stack(learner=_learner):
        return lambda spark, sf: _stacked(spark, sf, learner)[0]
    query(_name, "M8")(_mk_stack())


_HARD_SQL = f"""WITH {PRED_CTE},
v AS (SELECT id, y_true, y_pred, count(*) AS votes, min({_ORD}) AS first FROM a GROUP BY ALL)
SELECT id, y_true, y_pred AS ensemble_pred, votes FROM (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY votes DESC, first) AS r FROM v) WHERE r = 1"""


@query("ensemble_predict", "M9", _HARD_SQL, ("predictions",))
def q_ensemble_predict(spark, sf):
    return EN.ensemble_predict(all_preds(spark, sf), MODELS, "hard")


@query("ensemble_predict_soft", "M9", _soft_sql([1.0] * len(MODELS)), ("predictions",))
def q_ensemble_predict_soft(spark, sf):
    return EN.ensemble_predict(all_preds(spark, sf), MODELS, "soft")


@query("ensemble_predict_weighted", "M9", _soft_sql(WEIGHTS), ("predictions",))
def q_ensemble_predict_weighted(spark, sf):
    return EN.ensemble_predict(all_preds(spark, sf), MODELS, "weighted", weights=WEIGHTS)


@query("ensemble_predict_stacked", "M9")
def q_ensemble_predict_stacked(spark, sf):
    return EN.ensemble_predict(all_preds(spark, sf), MODELS, "stacked", stack_model=_stacked(spark, sf, "logistic")[1], feature_cols=META)
