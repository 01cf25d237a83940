"""Registered queries: collection roll-ups (B*) and label analysis (E*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nazar.functions import dates as D
from nazar.functions.mathx import rnd, rnd_sql
from nazar.operators import labels as L
from nazar.plans import fixtures as X
from nazar.plans import sqltext as S
from nazar.plans.registry import query
from nazar.sources.replies import BATCH_RESULTS_SQL

EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


# ------------------------------------------------------------------ B

@query("cap_per_app", "B1", """
SELECT id, app_name, rating FROM (
  SELECT id, app_name, rating, row_number() OVER (PARTITION BY app_name ORDER BY id) AS rn FROM reviews)
WHERE rn <= 20""", ("reviews",))
def q_cap_per_app(spark, sf):
    return L.cap_per_app(X.reviews(spark, sf).select("id", "app_name", "rating"), n=20)


@query("collection_log", "B2", """
SELECT a.app_name, CAST(coalesce(c.n, 0) AS BIGINT) AS n_reviews,
       CASE WHEN coalesce(c.n, 0) > 0 THEN 'success' ELSE 'failed' END AS status
FROM apps a LEFT JOIN (SELECT app_name, count(*) AS n FROM reviews GROUP BY app_name) c ON a.app_name = c.app_name
""", ("reviews", "apps"))
def q_collection_log(spark, sf):
    return L.collection_log(X.apps(spark, sf), X.reviews(spark, sf))


@query("collection_totals", "B2", """
WITH log AS (SELECT a.app_name, coalesce(c.n, 0) AS n FROM apps a
             LEFT JOIN (SELECT app_name, count(*) AS n FROM reviews GROUP BY app_name) c ON a.app_name = c.app_name)
SELECT count(*) AS total_apps, CAST(sum(CASE WHEN n > 0 THEN 1 ELSE 0 END) AS BIGINT) AS successful_apps,
       CAST(sum(CASE WHEN n = 0 THEN 1 ELSE 0 END) AS BIGINT) AS failed_apps, CAST(sum(n) AS BIGINT) AS total_reviews
FROM log""", ("reviews", "apps"))
def q_collection_totals(spark, sf):
    return L.collection_totals(L.collection_log(X.apps(spark, sf), X.reviews(spark, sf)))


@query("failed_apps", "B3", """
SELECT app_name FROM apps a WHERE NOT EXISTS (SELECT 1 FROM reviews r WHERE r.app_name = a.app_name)
""", ("reviews", "apps"))
def q_failed_apps(spark, sf):
    return L.failed_apps(X.apps(spark, sf), X.reviews(spark, sf))


@query("avg_reviews_per_successful_app", "B4", """
SELECT avg(n) AS avg_reviews_per_app FROM (SELECT app_name, count(*) AS n FROM reviews GROUP BY app_name)
""", ("reviews",))
def q_avg_reviews(spark, sf):
    return L.avg_reviews_per_successful_app(L.collection_log(X.apps(spark, sf), X.reviews(spark, sf)))


# ------------------------------------------------------------------ E1–E8

@query("label_candidates", "E1", """
SELECT id, app_name, CAST(length(comment) AS INTEGER) AS n_chars FROM reviews WHERE comment IS NOT NULL AND length(comment) > 10
""", ("reviews",))
def q_label_candidates(spark, sf):
    return L.label_candidates(X.reviews(spark, sf)).select("id", "app_name", F.length("comment").alias("n_chars"))


@query("sample_n", "E2", """
SELECT id, app_name FROM reviews ORDER BY md5('42:' || CAST(id AS VARCHAR)) LIMIT 100
""", ("reviews",))
def q_sample_n(spark, sf):
    return L.sample_n(X.reviews(spark, sf).select("id", "app_name"), 100, seed=42)


# Token estimate used by the registered cost queries: ceil(chars / 4) of the prompt.
PROMPT_OVERHEAD_CHARS = 60
SYSTEM_TOKENS = 180


@query("estimate_cost", "E3", f"""
WITH c AS (SELECT CAST(ceil((length(comment) + {PROMPT_OVERHEAD_CHARS}) / 4.0) AS BIGINT) AS tok
           FROM reviews WHERE comment IS NOT NULL AND length(comment) > 10)
SELECT CAST(sum({SYSTEM_TOKENS} + tok) AS BIGINT) AS total_input_tokens, CAST(count(*) * 5 AS BIGINT) AS estimated_output_tokens,
       sum({SYSTEM_TOKENS} + tok) / 1000.0::DOUBLE * 0.00015::DOUBLE AS input_cost,
       count(*) * 5 / 1000.0::DOUBLE * 0.0006::DOUBLE AS output_cost,
       sum({SYSTEM_TOKENS} + tok) / 1000.0::DOUBLE * 0.00015::DOUBLE + count(*) * 5 / 1000.0::DOUBLE * 0.0006::DOUBLE AS total_cost,
       (sum({SYSTEM_TOKENS} + tok) / 1000.0::DOUBLE * 0.00015::DOUBLE + count(*) * 5 / 1000.0::DOUBLE * 0.0006::DOUBLE) / count(*) AS cost_per_comment
FROM c""", ("reviews",))
def q_estimate_cost(spark, sf):
    r = L.label_candidates(X.reviews(spark, sf))
    r = r.withColumn("tok", F.ceil((F.length("comment") + PROMPT_OVERHEAD_CHARS) / 4.0).cast("bigint"))
    return L.estimate_cost(r, "tok", SYSTEM_TOKENS, 0.00015, 0.0006)


@query("flat_cost_estimate", "E3b", """
WITH c AS (SELECT count(*) AS n FROM reviews WHERE comment IS NOT NULL AND length(comment) > 10)
SELECT n AS n_comments, n * 100 / 1000.0::DOUBLE * 0.00015::DOUBLE + n * 5 / 1000.0::DOUBLE * 0.0006::DOUBLE AS total_cost,
  (n * 100 / 1000.0::DOUBLE * 0.00015::DOUBLE + n * 5 / 1000.0::DOUBLE * 0.0006::DOUBLE) / n AS cost_per_comment,
  CASE WHEN n > 1000 THEN (n * 100 / 1000.0::DOUBLE * 0.00015::DOUBLE + n * 5 / 1000.0::DOUBLE * 0.0006::DOUBLE) * 0.5 END AS batch_savings
FROM c""", ("reviews",))
def q_flat_cost(spark, sf):
    return L.flat_cost_estimate(L.label_candidates(X.reviews(spark, sf)))


@query("assign_batches", "E4", """
SELECT id, comment, CAST(row_number() OVER (ORDER BY id) AS BIGINT) AS row_num,
       CAST(floor((row_number() OVER (ORDER BY id) - 1) / 64) + 1 AS BIGINT) AS batch_id FROM reviews
""", ("reviews",))
def q_assign_batches(spark, sf):
    return L.assign_batches(X.reviews(spark, sf).select("id", "comment"), size=64)


def batch_results(spark, sf):
    """Batch-result JSON lines derived from documents ⋈ labels (A9 input), via to_json."""
    from nazar.sources import replies
    return replies.batch_result_lines(X.table(spark, sf, "documents"), X.table(spark, sf, "labels"))


@query("validate_label", "E5", """
WITH p AS (SELECT CAST(json_extract_string(line, '$.custom_id') AS VARCHAR) AS cid,
                  json_extract_string(line, '$.response.body.choices[0].message.content') AS raw
           FROM ({batch_sql}))
SELECT CASE WHEN lower({strip}) IN ('negative', 'neutral', 'positive') THEN lower({strip}) ELSE 'neutral' END AS sentiment_label,
       count(*) AS n,
       CAST(sum(CASE WHEN coalesce(lower({strip}) IN ('negative', 'neutral', 'positive'), false) THEN 0 ELSE 1 END) AS BIGINT) AS n_invalid
FROM p GROUP BY 1""".replace("{strip}", S.py_strip("raw")).replace("{batch_sql}", BATCH_RESULTS_SQL))
def q_validate_label(spark, sf):
    from nazar.sources import replies
    res = replies.read_batch_results(batch_results(spark, sf))
    v = L.validate_labels(res, "raw_label")
    return v.groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"),
                                            F.sum("was_invalid").cast("bigint").alias("n_invalid"))


@query("merge_labels", "E6", """
WITH res AS (SELECT replace(json_extract_string(line, '$.custom_id'), 'comment_', '') AS rid,
                    CASE WHEN CAST(json_extract(line, '$.response.status_code') AS INTEGER) = 200 THEN
                      CASE WHEN lower({strip}) IN ('negative', 'neutral', 'positive') THEN lower({strip}) ELSE 'neutral' END
                    ELSE 'neutral' END AS lab
             FROM (SELECT line, json_extract_string(line, '$.response.body.choices[0].message.content') AS raw FROM ({batch_sql})))
SELECT r.id, coalesce(res.lab, 'neutral') AS sentiment_label, CAST(res.lab IS NULL AS INTEGER) AS was_missing
FROM reviews r LEFT JOIN res ON CAST(r.id AS VARCHAR) = res.rid""".replace("{strip}", S.py_strip("raw")).replace("{batch_sql}", BATCH_RESULTS_SQL), ("reviews",))
def q_merge_labels(spark, sf):
    from nazar.sources import replies
    res = replies.read_batch_results(batch_results(spark, sf))
    res = res.select("id", F.when(F.col("status_code") == 200, L.validate_label(F.col("raw_label")))
                     .otherwise(F.lit("neutral")).alias("sentiment_label"))
    return L.merge_labels(X.reviews(spark, sf).select("id"), res)


@query("daily_label_counts", "E7", "SELECT CAST(day AS VARCHAR) AS day, "
       + ", ".join(f"count(*) FILTER (WHERE label = '{t}') AS {t}" for t in EVENT_TYPES)
       + " FROM daily GROUP BY day", ("daily",))
def q_daily(spark, sf):
    out = L.daily_label_counts(X.daily(spark, sf), "day", "label", EVENT_TYPES)
    return out.withColumn("day", F.col("day").cast("string"))


@query("jalali_to_date", "E7b", f"""
WITH j AS (SELECT doc_id, {D.JALALI_FIXTURE_SQL} AS jdate FROM documents)
SELECT doc_id, jdate, CAST({D.jalali_to_date_sql('jdate')} AS VARCHAR) AS gdate FROM j""")
def q_jalali(spark, sf):
    d = X.table(spark, sf, "documents").select("doc_id")
    j = d.withColumn("jdate", D.jalali_fixture(F.col("doc_id")))
    return j.select("doc_id", "jdate", D.jalali_to_date(F.col("jdate")).cast("string").alias("gdate"))


@query("label_usage", "E8", """
WITH p AS (SELECT CAST(json_extract(line, '$.response.status_code') AS INTEGER) AS sc,
                  CAST(json_extract(line, '$.response.body.usage.prompt_tokens') AS BIGINT) AS pt,
                  CAST(json_extract(line, '$.response.body.usage.completion_tokens') AS BIGINT) AS ct
           FROM ({batch_sql}))
SELECT count(*) AS total_comments,
       CAST(sum(CASE WHEN sc = 200 THEN coalesce(pt, 0) ELSE 0 END) AS BIGINT) AS input_tokens,
       CAST(sum(CASE WHEN sc = 200 THEN coalesce(ct, 0) ELSE 0 END) AS BIGINT) AS output_tokens,
       CAST(sum(CASE WHEN sc = 200 THEN 1 ELSE 0 END) AS BIGINT) AS labelled_comments,
       CAST(sum(CASE WHEN sc = 200 THEN 0 ELSE 1 END) AS BIGINT) AS failed_comments,
       {cost} AS total_cost_usd,
       sum(CASE WHEN sc = 200 THEN 1 ELSE 0 END) / count(*)::DOUBLE AS success_rate
FROM p""".replace("{cost}", rnd_sql("sum(CASE WHEN sc = 200 THEN coalesce(pt, 0) ELSE 0 END) / 1000.0::DOUBLE * 0.00015::DOUBLE"
                                    " + sum(CASE WHEN sc = 200 THEN coalesce(ct, 0) ELSE 0 END) / 1000.0::DOUBLE * 0.0006::DOUBLE", 8))
   .replace("{batch_sql}", BATCH_RESULTS_SQL))
def q_label_usage(spark, sf):
    from nazar.sources import replies
    res = replies.read_batch_results(batch_results(spark, sf))
    out = L.label_usage(res)
    cost = (F.col("input_tokens") / 1000.0 * 0.00015 + F.col("output_tokens") / 1000.0 * 0.0006)
    return out.withColumn("total_cost_usd", rnd(cost, 8))


# ------------------------------------------------------------------ E9–E20

@query("label_distribution", "E9", """
SELECT sentiment_label, count(*) AS n, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS pct
FROM labelled_reviews GROUP BY sentiment_label""", ("labelled_reviews",))
def q_label_distribution(spark, sf):
    c = X.labelled_reviews(spark, sf).groupBy("sentiment_label").agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window as W
    return c.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()))


@query("label_distribution_2dp", "E9", f"""
SELECT sentiment_label, count(*) AS n, {rnd_sql('count(*) * 100.0::DOUBLE / sum(count(*)) OVER ()', 2)} AS pct
FROM labelled_reviews GROUP BY sentiment_label""", ("labelled_reviews",))
def q_label_distribution_2dp(spark, sf):
    return L.label_distribution(X.labelled_reviews(spark, sf))


@query("rating_label_crosstab", "E10", """
SELECT rating, """ + ", ".join(
    f"{rnd_sql(f'count(*) FILTER (WHERE sentiment_label = {chr(39)}{l}{chr(39)}) * 100.0::DOUBLE / count(*)', 2)} AS {l}"
    for l in X.LABELS) + " FROM labelled_reviews GROUP BY rating", ("labelled_reviews",))
def q_rating_label_crosstab(spark, sf):
    return L.rating_label_crosstab(X.labelled_reviews(spark, sf))


@query("mean_rating_by_label", "E11", f"""
SELECT sentiment_label, {rnd_sql('avg(rating)', 2)} AS avg_rating FROM labelled_reviews GROUP BY sentiment_label
""", ("labelled_reviews",))
def q_mean_rating_by_label(spark, sf):
    return L.mean_rating_by_label(X.labelled_reviews(spark, sf))


@query("rating_label_corr", "E12", f"""
SELECT CASE WHEN count(DISTINCT sentiment_label) > 1 THEN {rnd_sql(
    "corr(CAST(rating AS DOUBLE), CAST(CASE sentiment_label WHEN 'negative' THEN 1 WHEN 'neutral' THEN 2 ELSE 3 END AS DOUBLE))", 3)}
  END AS correlation FROM labelled_reviews""", ("labelled_reviews",))
def q_rating_label_corr(spark, sf):
    return L.rating_label_corr(X.labelled_reviews(spark, sf))


_SHARE_SQL = """
SELECT app_name, count(*) AS n_reviews, """ + ", ".join(
    f"count(*) FILTER (WHERE sentiment_label = '{l}') * 100.0::DOUBLE / count(*) AS {l}_pct" for l in X.LABELS) + \
    " FROM labelled_reviews GROUP BY app_name"


@query("app_label_share", "E13", _SHARE_SQL, ("labelled_reviews",))
def q_app_label_share(spark, sf):
    return L.app_label_share(X.labelled_reviews(spark, sf))


@query("net_score_topk", "E14", f"""
WITH s AS ({_SHARE_SQL}), n AS (SELECT app_name, positive_pct - negative_pct AS net_score FROM s)
SELECT * FROM (SELECT app_name, net_score, 'best' AS side FROM n ORDER BY net_score DESC, app_name LIMIT 5)
UNION ALL
SELECT * FROM (SELECT app_name, net_score, 'worst' AS side FROM n ORDER BY net_score ASC, app_name LIMIT 5)
""", ("labelled_reviews",))
def q_net_score_topk(spark, sf):
    return L.net_score_topk(X.labelled_reviews(spark, sf), k=5)


@query("length_by_label", "E15", f"""
SELECT sentiment_label, {rnd_sql('avg(length(comment))', 2)} AS mean_len,
       {rnd_sql('median(length(comment))', 2)} AS median_len, {rnd_sql('stddev_samp(length(comment))', 2)} AS std_len
FROM labelled_reviews GROUP BY sentiment_label""", ("labelled_reviews",))
def q_length_by_label(spark, sf):
    d = X.labelled_reviews(spark, sf)
    n = F.length("comment")
    return d.groupBy("sentiment_label").agg(rnd(F.avg(n), 2).alias("mean_len"),
                                            rnd(F.median(n), 2).alias("median_len"),
                                            rnd(F.stddev_samp(n), 2).alias("std_len"))


@query("top_words_by_label", "E16", f"""
WITH w AS (SELECT sentiment_label, unnest({S.words('lower(comment)')}) AS word FROM labelled_reviews),
c AS (SELECT sentiment_label, word, count(*) AS n FROM w GROUP BY ALL)
SELECT sentiment_label, word, n, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY sentiment_label ORDER BY n DESC, word) AS INTEGER) AS rank FROM c)
WHERE rank <= 10""", ("labelled_reviews",))
def q_top_words_by_label(spark, sf):
    return L.top_words_by_label(X.labelled_reviews(spark, sf), k=10).withColumn("rank", F.col("rank").cast("int"))


@query("box_stats_length", "E17", """
SELECT sentiment_label, CAST(min(length(comment)) AS DOUBLE) AS min,
  quantile_cont(length(comment), 0.25) AS q1, quantile_cont(length(comment), 0.5) AS median,
  quantile_cont(length(comment), 0.75) AS q3, CAST(max(length(comment)) AS DOUBLE) AS max
FROM labelled_reviews GROUP BY sentiment_label""", ("labelled_reviews",))
def q_box_stats_length(spark, sf):
    return L.box_stats(X.labelled_reviews(spark, sf), F.length("comment"))


@query("box_stats_rating", "E17", """
SELECT sentiment_label, CAST(min(rating) AS DOUBLE) AS min,
  quantile_cont(rating, 0.25) AS q1, quantile_cont(rating, 0.5) AS median,
  quantile_cont(rating, 0.75) AS q3, CAST(max(rating) AS DOUBLE) AS max
FROM labelled_reviews GROUP BY sentiment_label""", ("labelled_reviews",))
def q_box_stats_rating(spark, sf):
    return L.box_stats(X.labelled_reviews(spark, sf), F.col("rating"))


def hist_sql(value_sql: str, src: str, bins: int, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    on = f"USING ({group})" if group else "ON true"
    gb = f"GROUP BY {group}" if group else ""
    return f"""
WITH v AS (SELECT {g}CAST({value_sql} AS DOUBLE) AS x FROM {src} WHERE {value_sql} IS NOT NULL),
mm AS (SELECT {g}min(x) AS lo, max(x) AS hi FROM v {gb}),
b AS (SELECT {g}lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least({bins - 1}, floor((x - lo) * {bins} / (hi - lo))) END AS INTEGER) AS bin
      FROM v JOIN mm {on})
SELECT {g}bin, lo + bin * (hi - lo) / {bins} AS bin_start, lo + (bin + 1) * (hi - lo) / {bins} AS bin_end, count(*) AS n
FROM b GROUP BY ALL"""


@query("length_histogram_by_label", "E18", hist_sql("length(comment)", "labelled_reviews", 20, "sentiment_label"),
       ("labelled_reviews",))
def q_length_hist_by_label(spark, sf):
    return L.equal_width_bins(X.labelled_reviews(spark, sf), F.length("comment"), 20, ["sentiment_label"])


def category_lexicon_sql(lex) -> str:
    return " UNION ALL ".join(f"SELECT {S.lit(c)} AS category, {S.lit(k)} AS keyword" for c, k in lex)


@query("tag_categories", "E19", """
WITH cat AS ({lex})
SELECT DISTINCT r.id, c.category FROM reviews r JOIN cat c ON instr(lower(r.comment), lower(c.keyword)) > 0
""".replace("{lex}", category_lexicon_sql(X.FIXTURE_CATEGORIES)), ("reviews",))
def q_tag_categories(spark, sf):
    cat = spark.createDataFrame(X.FIXTURE_CATEGORIES, "category string, keyword string")
    return L.tag_categories(X.reviews(spark, sf), cat)


@query("label_share_by_category", "E20", """
WITH cat AS ({lex}),
t AS (SELECT DISTINCT r.id, c.category FROM reviews r JOIN cat c ON instr(lower(r.comment), lower(c.keyword)) > 0)
SELECT category, count(*) AS n_reviews, """.replace("{lex}", category_lexicon_sql(X.FIXTURE_CATEGORIES)) + ", ".join(
    f"{rnd_sql(f'count(*) FILTER (WHERE sentiment_label = {chr(39)}{l}{chr(39)}) * 100.0::DOUBLE / count(*)', 2)} AS {l}_pct"
    for l in X.LABELS) + " FROM t JOIN review_labels USING (id) GROUP BY category", ("reviews", "review_labels"))
def q_label_share_by_category(spark, sf):
    cat = spark.createDataFrame(X.FIXTURE_CATEGORIES, "category string, keyword string")
    tagged = L.tag_categories(X.reviews(spark, sf), cat)
    return L.label_share_by_category(tagged, X.review_labels(spark, sf))
