"""Registered queries: error analysis (L*) on the prediction fixture."""

from __future__ import annotations

from pyspark.sql import functions as F

from nazar.functions import patterns as P
from nazar.functions.mathx import rnd, rnd_sql
from nazar.operators import errors as E
from nazar.plans import fixtures as X
from nazar.plans import sqltext as S
from nazar.plans.q_metrics import P_CTE, preds
from nazar.plans.registry import query

T_ = ("predictions",)
# Lexicons for the Latin fixture prose (substring containment), plus the shipped Persian pair.
FIXTURE_LEXICONS = {"has_positive_words": ["with", "elle", "und"], "has_negative_words": ["the", "des", "los"]}
FIXTURE_ERROR_STOPWORDS = ["the", "and", "des", "les", "und", "der", "los"]


def bucket_sql(v: str, edges) -> str:
    parts = []
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = f"{v} > {lo!r}" if hi is None else f"{v} > {lo!r} AND {v} <= {hi!r}"
        parts.append(f"WHEN {cond} THEN {i}")
    return "CASE " + " ".join(parts) + " END"


F_CTE = f"""{P_CTE},
f AS (SELECT *, CAST(y_true <> y_pred AS INTEGER) AS is_error, list_max(proba) AS confidence,
        CAST(list_position(proba, list_max(proba)) - 1 AS INTEGER) AS argmax FROM p)"""


@query("error_summary", "L1", f"""WITH {P_CTE}
SELECT count(*) AS total_samples, count(*) FILTER (WHERE y_true <> y_pred) AS total_errors,
  avg(CAST(y_true <> y_pred AS DOUBLE)) AS error_rate FROM p""", T_)
def q_error_summary(spark, sf):
    return E.error_summary(preds(spark, sf))


@query("confusion_pairs", "L2", f"""WITH {P_CTE}
SELECT y_true, y_pred, count(*) AS n FROM p WHERE y_true <> y_pred GROUP BY ALL""", T_)
def q_confusion_pairs(spark, sf):
    return E.confusion_pairs(preds(spark, sf))


@query("errors_per_class", "L3", f"""WITH {P_CTE},
c AS (SELECT y_true AS cls, count(*) AS total, count(*) FILTER (WHERE y_true <> y_pred) AS errors FROM p GROUP BY 1)
SELECT CAST(k.cls AS INTEGER) AS cls, coalesce(total, 0) AS total, coalesce(errors, 0) AS errors,
  CASE WHEN coalesce(total, 0) > 0 THEN coalesce(errors, 0) / coalesce(total, 0) ELSE 0.0 END AS error_rate,
  coalesce(total, 0) - coalesce(errors, 0) AS correct
FROM (VALUES (0), (1), (2)) k(cls) LEFT JOIN c ON k.cls = c.cls""", T_)
def q_errors_per_class(spark, sf):
    return E.errors_per_class(preds(spark, sf), [0, 1, 2])


@query("error_examples", "L4", f"""WITH {F_CTE}
SELECT y_true, y_pred, rank, id, confidence, proba, text FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY y_true, y_pred ORDER BY id) AS INTEGER) AS rank FROM f WHERE is_error = 1)
WHERE rank <= 5""", T_)
def q_error_examples(spark, sf):
    return E.error_examples(preds(spark, sf), 5)


def _by_bucket_sql(value_sql, edges):
    return f"""WITH {P_CTE},
b AS (SELECT {bucket_sql(value_sql, edges)} AS bin, CAST(y_true <> y_pred AS INTEGER) AS e FROM p),
g AS (SELECT bin, count(*) AS total, CAST(sum(e) AS BIGINT) AS errors FROM b WHERE bin IS NOT NULL GROUP BY bin)
SELECT CAST(bin AS INTEGER) AS bin, total, errors, errors / total AS error_rate, (total - errors) / total AS accuracy FROM g"""


@query("errors_by_length", "L5", _by_bucket_sql("length(text)", E.LENGTH_BINS), T_)
def q_errors_by_length(spark, sf):
    return E.errors_by_length(preds(spark, sf))


@query("errors_by_word_count", "L6", _by_bucket_sql(f"len({S.split_ws('text')})", E.WORD_BINS), T_)
def q_errors_by_word_count(spark, sf):
    return E.errors_by_word_count(preds(spark, sf))


def _lex_present_sql(words):
    return "(" + " OR ".join(f"instr(text, {S.lit(w)}) > 0" for w in words) + ")"


@query("errors_by_lexicon_presence", "L7", f"""WITH {P_CTE},
x AS ({" UNION ALL ".join(f"SELECT '{n}' AS lexicon, {_lex_present_sql(ws)} AS present, CAST(y_true <> y_pred AS INTEGER) AS e FROM p"
                          for n, ws in FIXTURE_LEXICONS.items())})
SELECT lexicon, present, count(*) AS total, CAST(sum(e) AS BIGINT) AS errors, sum(e) / count(*) AS error_rate
FROM x GROUP BY ALL""", T_)
def q_errors_by_lexicon(spark, sf):
    return E.errors_by_lexicon_presence(preds(spark, sf), FIXTURE_LEXICONS)


_SW = "[" + ", ".join(S.lit(w) for w in FIXTURE_ERROR_STOPWORDS) + "]"


@query("common_words_in_errors", "L8", f"""WITH {P_CTE},
e AS (SELECT * FROM p WHERE y_true <> y_pred),
sizes AS (SELECT y_true, y_pred FROM e GROUP BY ALL HAVING count(*) >= 3),
w AS (SELECT y_true, y_pred, unnest({S.words('lower(text)')}) AS word FROM e),
c AS (SELECT y_true, y_pred, word, count(*) AS n FROM w WHERE length(word) > 2 AND NOT list_contains({_SW}, word)
      GROUP BY ALL)
SELECT y_true, y_pred, word, n, rank FROM (
  SELECT c.*, CAST(row_number() OVER (PARTITION BY c.y_true, c.y_pred ORDER BY n DESC, word) AS INTEGER) AS rank
  FROM c JOIN sizes USING (y_true, y_pred)) WHERE rank <= 10""", T_)
def q_common_words_in_errors(spark, sf):
    return E.common_words_in_errors(preds(spark, sf), FIXTURE_ERROR_STOPWORDS)


@query("length_stats_error_vs_correct", "L9", f"""WITH {P_CTE}
SELECT y_true <> y_pred AS is_error, count(*) AS n, avg(length(text)) AS mean_length,
  CAST(median(length(text)) AS DOUBLE) AS median_length, {rnd_sql('stddev_pop(length(text))', 6)} AS std_length
FROM p GROUP BY 1""", T_)
def q_length_stats_evc(spark, sf):
    r = E.length_stats_error_vs_correct(preds(spark, sf))
    return r.withColumn("std_length", rnd(F.col("std_length"), 6))


@query("emoji_rate_error_vs_correct", "L10", f"""WITH {P_CTE},
q AS (SELECT y_true, y_pred, {X.persian_sql('text')} AS text FROM p)
SELECT y_true <> y_pred AS is_error, count(*) AS total,
  CAST(sum(CAST(coalesce(regexp_matches(text, {S.lit(E.ERROR_EMOJI)}), false) AS INTEGER)) AS BIGINT) AS with_emoji,
  avg(CAST(coalesce(regexp_matches(text, {S.lit(E.ERROR_EMOJI)}), false) AS INTEGER)) AS emoji_rate FROM q GROUP BY 1""", T_)
def q_emoji_rate(spark, sf):
    return E.emoji_rate_error_vs_correct(preds(spark, sf).withColumn("text", X.persian(F.col("text"))))


_DENS = (f"CASE WHEN length(text) > 0 THEN (length(text) - length(translate(text, {S.lit(P.DENSITY_PUNCT)}, ''))) "
         f"/ length(text) ELSE 0.0 END")


@query("punctuation_density", "L11", f"""WITH {P_CTE}
SELECT y_true <> y_pred AS is_error, {rnd_sql(f'avg({_DENS})', 9)} AS mean_density,
  {rnd_sql(f'stddev_pop({_DENS})', 9)} AS std_density FROM p GROUP BY 1""", T_)
def q_punctuation_density(spark, sf):
    r = E.punctuation_density(preds(spark, sf))
    return r.select("is_error", rnd(F.col("mean_density"), 9).alias("mean_density"),
                    rnd(F.col("std_density"), 9).alias("std_density"))


@query("high_confidence_errors", "L12", f"""WITH {F_CTE}
SELECT id, y_true, y_pred, confidence, proba, text FROM f WHERE is_error = 1 AND confidence >= 0.8 ORDER BY id LIMIT 10""", T_)
def q_high_conf_errors(spark, sf):
    return E.high_confidence_errors(preds(spark, sf))


@query("low_confidence_correct", "L13", f"""WITH {F_CTE}
SELECT id, y_true, y_pred, confidence, proba, text FROM f WHERE is_error = 0 AND confidence <= 0.6 ORDER BY id LIMIT 10""", T_)
def q_low_conf_correct(spark, sf):
    return E.low_confidence_correct(preds(spark, sf))


@query("confidence_bands", "L14", _by_bucket_sql("list_max(proba)", E.CONFIDENCE_BINS), T_)
def q_confidence_bands(spark, sf):
    return E.confidence_bands(preds(spark, sf))


_EDGES = "CAST([" + ", ".join(repr(x) for x in E.CALIBRATION_BINS) + "] AS DOUBLE[])"
CAL_SQL = f"""{F_CTE},
b AS (SELECT {bucket_sql('confidence', E.CALIBRATION_BINS)} AS bin, confidence, CAST(argmax = y_true AS DOUBLE) AS hit FROM f),
cal AS (SELECT CAST(bin AS INTEGER) AS bin, avg(confidence) AS avg_confidence, avg(hit) AS accuracy, count(*) AS count
        FROM b WHERE bin IS NOT NULL GROUP BY bin)"""


@query("calibration", "L15", f"""WITH {CAL_SQL}
SELECT bin, {_EDGES}[bin + 1] AS bin_lower, {_EDGES}[bin + 2] AS bin_upper, {rnd_sql('avg_confidence', 9)} AS avg_confidence,
  {rnd_sql('accuracy', 9)} AS accuracy, count, {rnd_sql('abs(avg_confidence - accuracy)', 9)} AS calibration_error FROM cal""", T_)
def q_calibration(spark, sf):
    c = E.calibration(preds(spark, sf))
    return c.select("bin", "bin_lower", "bin_upper", rnd(F.col("avg_confidence"), 9).alias("avg_confidence"),
                    rnd(F.col("accuracy"), 9).alias("accuracy"), "count",
                    rnd(F.col("calibration_error"), 9).alias("calibration_error"))


@query("ece_mce", "L16", f"""WITH {CAL_SQL}
SELECT {rnd_sql('sum(count / (SELECT count(*) FROM p) * abs(avg_confidence - accuracy))', 9)} AS ece,
  {rnd_sql('max(abs(avg_confidence - accuracy))', 9)} AS mce FROM cal""", T_)
def q_ece_mce(spark, sf):
    r = E.ece_mce(preds(spark, sf))
    return r.select(rnd(F.col("ece"), 9).alias("ece"), rnd(F.col("mce"), 9).alias("mce"))


@query("worst_predictions", "L17", f"""WITH {F_CTE}
SELECT id, y_true, y_pred, confidence, text FROM f WHERE is_error = 1 ORDER BY confidence DESC, id LIMIT 20""", T_)
def q_worst_predictions(spark, sf):
    return E.worst_predictions(preds(spark, sf))


@query("most_confused", "L18", f"""WITH {F_CTE}
SELECT id, y_true, y_pred, is_error, 1 - confidence AS confusion_score, confidence FROM f
ORDER BY confidence ASC, id LIMIT 20""", T_)
def q_most_confused(spark, sf):
    return E.most_confused(preds(spark, sf))


@query("misclassified_by_class", "L19", f"""WITH {P_CTE},
e AS (SELECT * FROM p WHERE y_true <> y_pred),
cnt AS (SELECT y_true, count(*) AS n_errors FROM e GROUP BY 1)
SELECT x.y_true, rank, id, y_pred, n_errors FROM (
  SELECT y_true, CAST(row_number() OVER (PARTITION BY y_true ORDER BY id) AS INTEGER) AS rank, id, y_pred FROM e) x
JOIN cnt USING (y_true) WHERE rank <= 3""", T_)
def q_misclassified_by_class(spark, sf):
    return E.misclassified_by_class(preds(spark, sf))
