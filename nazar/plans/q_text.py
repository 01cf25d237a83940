"""Registered queries: text cleaning and tokens (C*) and profiling (D*).

Text outputs are compared as (id, md5, length) so the check covers every
character of the whole texts without shipping them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nazar.functions import lexicons as LX
from nazar.functions import patterns as P
from nazar.functions import text as T
from nazar.operators import cleaning as C
from nazar.operators import profile as PR
from nazar.plans import fixtures as X
from nazar.plans import sqltext as S
from nazar.plans.q_labels import hist_sql
from nazar.plans.registry import query
from nazar.functions.mathx import rnd_sql

EMO = LX.DEFAULT_EMOJI_MAP
STOP = LX.FIXTURE_STOPWORDS
SUFFIXES = LX.FIXTURE_SUFFIXES
LEMMAS = LX.FIXTURE_LEMMAS


def pages_text(spark, sf):
    p = X.table(spark, sf, "pages")
    return p.select(p.page_id.alias("id"), F.concat_ws(" ", p.url, p.html).alias("comment"))


PAGES_SQL = "SELECT page_id AS id, url || ' ' || html AS comment FROM pages"


def _text_q(name, op_id, spark_fn, sql_fn, source="reviews"):
    """Register ``spark_fn(col)`` / ``sql_fn(expr)`` applied to the whole text column."""
    if source != "pages":
        sql = f"SELECT id, md5({sql_fn('comment')}) AS h, CAST(length({sql_fn('comment')}) AS INTEGER) AS n FROM {source}"
        tables = (source,)
    else:
        sql = (f"WITH src AS ({PAGES_SQL}) SELECT id, md5({sql_fn('comment')}) AS h, "
               f"CAST(length({sql_fn('comment')}) AS INTEGER) AS n FROM src")
        tables = ()

    @query(name, op_id, sql, tables)
    def fn(spark, sf):
        d = {"reviews": X.reviews, "persian_reviews": X.persian_reviews, "pages": pages_text}[source](spark, sf).select("id", "comment")
        x = spark_fn(F.col("comment"))
        return d.select("id", F.md5(x).alias("h"), F.length(x).alias("n"))
    return fn


# Each rule over the whole text column
_text_q("remove_urls", "C1", T.remove_urls, lambda e: S.rx(e, P.URL, " "), "pages")
_text_q("remove_emails", "C2", T.remove_emails, lambda e: S.rx(e, P.EMAIL, " "))
_text_q("remove_phones", "C3", T.remove_phones, lambda e: S.rx(e, P.PHONE, " "))
_text_q("remove_mentions_hashtags", "C4", T.remove_mentions_hashtags,
        lambda e: S.rx(S.rx(e, P.MENTION, " "), P.HASHTAG, " "), "pages")
_text_q("convert_emojis", "C5", lambda c: T.convert_emojis(c, EMO), lambda e: S.convert_emojis(e, EMO), "persian_reviews")
_text_q("remove_emojis", "C6", T.remove_emojis, lambda e: S.rx(e, P.EMOJI_RANGES + "+", " "), "persian_reviews")
_text_q("normalize_chars", "C7", T.normalize_chars, lambda e: f"translate({e}, {S.lit(P.CHAR_FROM)}, {S.lit(P.CHAR_TO)})", "persian_reviews")
_text_q("normalize_digits", "C8", T.normalize_digits,
        lambda e: f"translate({e}, {S.lit(P.PERSIAN_DIGITS)}, {S.lit(P.ASCII_DIGITS)})", "persian_reviews")
_text_q("remove_diacritics", "C9", T.remove_diacritics, lambda e: f"translate({e}, {S.lit(P.DIACRITICS)}, '')", "persian_reviews")
_text_q("remove_english", "C10", T.remove_english, lambda e: S.rx(e, P.ENGLISH_CHAR, " "))
_text_q("clean_punctuation", "C11", T.clean_punctuation, lambda e: S.rx(e, P.REPEATED_PUNCT, "."))
_text_q("clean_punctuation_strip", "C11", lambda c: T.clean_punctuation(c, strip=True),
        lambda e: S.rx(S.rx(e, P.REPEATED_PUNCT, "."), P.PUNCTUATION, " "))
_text_q("normalize_whitespace", "C12", T.normalize_whitespace, S.ws)
for _lvl in T.LEVELS:
    _text_q(f"clean_text_{_lvl}", "C14", lambda c, l=_lvl: T.clean_text(c, l, EMO),
            lambda e, l=_lvl: S.clean_text(e, l, EMO))


@query("convert_emojis_count", "C5", f"""
SELECT id, CAST({S.emoji_count('comment', EMO)} AS INTEGER) AS n_emoji FROM persian_reviews""", ("persian_reviews",))
def q_emoji_count(spark, sf):
    return X.persian_reviews(spark, sf).select("id", T.convert_emojis_counted(F.col("comment"), EMO)["n_emoji"].alias("n_emoji"))


@query("valid_length", "C13", "SELECT id, length(comment) BETWEEN 10 AND 500 AS valid FROM reviews", ("reviews",))
def q_valid_length(spark, sf):
    return X.reviews(spark, sf).select("id", T.valid_length(F.col("comment")).alias("valid"))


def _tok_q(name, op_id, spark_fn, sql_fn, clean_level="medium", source="reviews"):
    sql_t = sql_fn(S.clean_text("comment", clean_level, EMO))
    sql = (f"SELECT id, CAST(len({sql_t}) AS INTEGER) AS n_tokens, md5({S.join_tokens(sql_t)}) AS h FROM {source}")

    @query(name, op_id, sql, (source,))
    def fn(spark, sf):
        t = spark_fn(T.clean_text(F.col("comment"), clean_level, EMO))
        d = X.persian_reviews(spark, sf) if source == "persian_reviews" else X.reviews(spark, sf)
        return d.select("id", F.size(t).alias("n_tokens"), F.md5(F.array_join(t, " ")).alias("h"))
    return fn


_tok_q("tokenize", "C16", T.tokenize, S.tokenize)
_tok_q("remove_stopwords", "C17", lambda c: T.remove_stopwords(T.tokenize(c), STOP),
       lambda e: S.remove_stopwords(S.tokenize(e), STOP))
_tok_q("stem_tokens", "C18", lambda c: T.strip_suffixes(T.remove_stopwords(T.tokenize(c), STOP), X.PERSIAN_SUFFIXES),
       lambda e: S.strip_suffixes(S.remove_stopwords(S.tokenize(e), STOP), X.PERSIAN_SUFFIXES), "heavy", "persian_reviews")
_tok_q("analyze_tokens", "F1", T.analyze, S.analyze, "light")


@query("lemmatize_tokens", "C19", f"""
SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, md5({S.join_tokens('t')}) AS h FROM (
  SELECT id, {S.lemmatize(S.remove_stopwords(S.tokenize(S.clean_text('comment', 'heavy', EMO)), STOP), X.PERSIAN_LEMMAS)} AS t
  FROM persian_reviews) WHERE len(t) > 0""", ("persian_reviews",))
def q_lemmatize(spark, sf):
    """Long form: explode → broadcast left join with the lemma table → ordered re-assembly."""
    r = X.persian_reviews(spark, sf)
    toks = r.select("id", T.remove_stopwords(T.tokenize(T.clean_text(F.col("comment"), "heavy", EMO)), STOP)
                    .alias("tokens"))
    long = C.explode_tokens(toks)
    lem = spark.createDataFrame(X.PERSIAN_LEMMAS, "form string, lemma string")
    arr = C.tokens_to_arrays(C.lemmatize_tokens(long, lem))
    return arr.select("id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("h"))


@query("remove_stopwords_long", "C17", f"""
SELECT id, CAST(len(t) AS INTEGER) AS n_tokens, md5({S.join_tokens('t')}) AS h FROM (
  SELECT id, {S.remove_stopwords(S.tokenize(S.clean_text('comment', 'medium', EMO)), STOP)} AS t FROM reviews)
WHERE len(t) > 0""", ("reviews",))
def q_stop_long(spark, sf):
    r = X.reviews(spark, sf)
    long = C.explode_tokens(r.select("id", T.tokenize(T.clean_text(F.col("comment"), "medium", EMO)).alias("tokens")))
    sw = spark.createDataFrame([(w,) for w in STOP], "word string")
    arr = C.tokens_to_arrays(C.remove_stopwords_long(long, sw))
    return arr.select("id", F.size("tokens").alias("n_tokens"), F.md5(F.array_join("tokens", " ")).alias("h"))


@query("preprocess", "C20", f"""
SELECT id, md5({S.join_tokens(S.remove_stopwords(S.tokenize(S.clean_text('comment', 'medium', EMO)), STOP))}) AS h
FROM reviews""", ("reviews",))
def q_preprocess(spark, sf):
    out = C.preprocess(X.reviews(spark, sf), level="medium", stopwords=STOP, emoji_map=EMO)
    return out.select("id", F.md5("processed").alias("h"))


_PROC = S.join_tokens(S.remove_stopwords(S.tokenize(S.clean_text('comment', 'medium', EMO)), STOP))


@query("process_table", "C21", f"""
SELECT id, md5(p) AS h FROM (SELECT id, {_PROC} AS p FROM reviews) WHERE length(p) BETWEEN 10 AND 500""", ("reviews",))
def q_process_table(spark, sf):
    out = C.process_table(X.reviews(spark, sf), stopwords=STOP, emoji_map=EMO)
    return out.select("id", F.md5("comment_cleaned").alias("h"))


@query("preprocess_comments", "C22", f"""
SELECT id, md5(c) AS hc, md5(p) AS hp FROM (
  SELECT id, c, {S.join_tokens(S.remove_stopwords(S.tokenize('c'), STOP))} AS p FROM (
    SELECT id, {S.clean_text('comment', 'medium', EMO)} AS c FROM reviews) WHERE length(c) > 0)
WHERE length(p) >= 10""", ("reviews",))
def q_preprocess_comments(spark, sf):
    out = C.preprocess_comments(X.reviews(spark, sf), stopwords=STOP, emoji_map=EMO)
    return out.select("id", F.md5("comment_cleaned").alias("hc"), F.md5("comment_processed").alias("hp"))


def versions_df(spark, sf, keep=(), src=None):
    d = src if src is not None else X.reviews(spark, sf)
    return C.versions(d, stopwords=STOP, suffixes=SUFFIXES, lemmas=LEMMAS, emoji_map=EMO, keep=keep)


def versions_cte(src="reviews", keep=()):
    return S.versions_sql(src, "comment", "id", STOP, SUFFIXES, LEMMAS, EMO, keep=keep)


@query("versions", "C23", f"""
WITH v AS ({versions_cte()}) SELECT id, version, kept, md5(comment_processed) AS h FROM v""", ("reviews",))
def q_versions(spark, sf):
    return versions_df(spark, sf).select("id", "version", "kept", F.md5("comment_processed").alias("h"))


@query("preprocessing_summary", "C24", f"""
WITH v AS ({versions_cte()})
SELECT version, count(*) AS input_comments, CAST(sum(CAST(kept AS INTEGER)) AS BIGINT) AS output_comments,
  count(*) - CAST(sum(CAST(kept AS INTEGER)) AS BIGINT) AS filtered_comments,
  sum(CAST(kept AS INTEGER)) / count(*)::DOUBLE AS success_rate FROM v GROUP BY version""", ("reviews",))
def q_preprocessing_summary(spark, sf):
    return C.preprocessing_summary(versions_df(spark, sf))


def _changed_sql(a, b):
    return f"CAST(sum(CASE WHEN NOT blank AND length({a}) <> length({b}) THEN 1 ELSE 0 END) AS BIGINT)"


_x0 = S.ws("comment")
_x1 = S.rx(_x0, P.URL, " ")
_x2 = S.rx(_x1, P.EMAIL, " ")
_x3 = S.rx(_x2, P.PHONE, " ")
_x4 = S.rx(S.rx(_x3, P.MENTION, " "), P.HASHTAG, " ")
_cl = S.clean_text("comment", "medium", EMO)
_tk = S.tokenize(_cl)
_kp = S.remove_stopwords(_tk, STOP)
_st = S.strip_suffixes(_kp, SUFFIXES)


@query("cleaning_stats", "C15", f"""
WITH b AS (SELECT comment, comment IS NULL OR length({S.py_strip('comment')}) = 0 AS blank FROM reviews),
k AS (SELECT *, {_kp} AS kp, {_st} AS st, {_tk} AS tk, {_cl} AS cl FROM b)
SELECT count(*) AS n_texts, {_changed_sql(_x0, _x1)} AS removed_urls, {_changed_sql(_x1, _x2)} AS removed_emails,
  {_changed_sql(_x2, _x3)} AS removed_phone_numbers,
  CAST(sum(CASE WHEN NOT blank THEN {S.emoji_count(_x4, EMO)} ELSE 0 END) AS BIGINT) AS converted_emojis,
  CAST(sum(CASE WHEN NOT blank AND cl <> comment THEN 1 ELSE 0 END) AS BIGINT) AS processed_texts,
  CAST(sum(CASE WHEN NOT blank THEN len(tk) - len(kp) ELSE 0 END) AS BIGINT) AS removed_stopwords,
  CAST(sum(CASE WHEN NOT blank THEN len(list_filter(list_zip(kp, st), lambda z: z[1] <> z[2])) ELSE 0 END) AS BIGINT)
    AS stemmed_words
FROM k""", ("reviews",))
def q_cleaning_stats(spark, sf):
    return C.cleaning_stats(X.reviews(spark, sf), level="medium", emoji_map=EMO, stopwords=STOP, suffixes=SUFFIXES)


# ------------------------------------------------------------------ D

@query("length_stats", "D1", f"""
SELECT avg(length(comment)) AS mean, CAST(median(length(comment)) AS DOUBLE) AS median,
  CAST(min(length(comment)) AS INTEGER) AS min, CAST(max(length(comment)) AS INTEGER) AS max,
  {rnd_sql('stddev_samp(length(comment))')} AS std FROM reviews""", ("reviews",))
def q_length_stats(spark, sf):
    return PR.length_stats(X.reviews(spark, sf))


@query("duplicates", "D2", """
SELECT count(*) AS total, count(DISTINCT comment) AS unique_comments, count(*) - count(DISTINCT comment) AS duplicate_comments
FROM reviews""", ("reviews",))
def q_duplicates(spark, sf):
    return PR.duplicates(X.reviews(spark, sf))


@query("count_by_app", "D3", "SELECT app_name, count(*) AS n FROM reviews GROUP BY app_name", ("reviews",))
def q_count_by_app(spark, sf):
    return PR.count_by_app(X.reviews(spark, sf))


@query("apps_count", "D3", "SELECT count(DISTINCT app_name) AS apps_count FROM reviews", ("reviews",))
def q_apps_count(spark, sf):
    return PR.n_apps(X.reviews(spark, sf))


@query("rating_distribution", "D4", "SELECT rating, count(*) AS n FROM reviews GROUP BY rating", ("reviews",))
def q_rating_distribution(spark, sf):
    return PR.rating_distribution(X.reviews(spark, sf))


@query("mean_rating", "D4", "SELECT avg(rating) AS average_rating FROM reviews", ("reviews",))
def q_mean_rating(spark, sf):
    return PR.mean_rating(X.reviews(spark, sf))


@query("script_ratio", "D5", f"""
SELECT avg(CAST(coalesce(regexp_matches(comment, {S.lit(P.PERSIAN_CHAR)}), false) AS INTEGER)) AS ratio FROM reviews
""", ("reviews",))
def q_script_ratio(spark, sf):
    return PR.script_ratio(X.reviews(spark, sf))


@query("script_ratio_accented", "D5", """
SELECT avg(CAST(coalesce(regexp_matches(comment, '[À-ÿ]'), false) AS INTEGER)) AS ratio FROM reviews""", ("reviews",))
def q_script_ratio_acc(spark, sf):
    return PR.script_ratio(X.reviews(spark, sf), char_class="[À-ÿ]")


@query("version_stats", "D6", f"""
WITH v AS ({versions_cte()}), k AS (SELECT * FROM v WHERE kept)
SELECT version, count(*) AS total_comments, avg(length(comment_processed)) AS avg_length,
  CAST(median(length(comment_processed)) AS DOUBLE) AS median_length,
  CAST(min(length(comment_processed)) AS INTEGER) AS min_length, CAST(max(length(comment_processed)) AS INTEGER) AS max_length,
  {rnd_sql('stddev_samp(length(comment_processed))')} AS std_length,
  avg(len({S.split_ws('comment_processed')})) AS avg_words, count(DISTINCT comment_processed) AS unique_comments,
  1 - count(DISTINCT comment_processed) / count(*)::DOUBLE AS duplicate_rate
FROM k GROUP BY version""", ("reviews",))
def q_version_stats(spark, sf):
    return PR.version_stats(versions_df(spark, sf).filter("kept"))


@query("length_histogram", "D7", hist_sql("length(comment)", "reviews", 50), ("reviews",))
def q_length_histogram(spark, sf):
    return PR.length_histogram(X.reviews(spark, sf), bins=50)


@query("word_histogram", "D7", hist_sql(f"len({S.split_ws('comment')})", "reviews", 30), ("reviews",))
def q_word_histogram(spark, sf):
    return PR.word_histogram(X.reviews(spark, sf), bins=30)


@query("top_words", "D8", f"""
WITH v AS ({versions_cte()}), w AS (SELECT unnest({S.words('lower(comment_processed)')}) AS word FROM v
                                     WHERE version = 'medium' AND kept)
SELECT word, count(*) AS n FROM w GROUP BY word ORDER BY n DESC, word LIMIT 20""", ("reviews",))
def q_top_words(spark, sf):
    v = versions_df(spark, sf).filter((F.col("version") == "medium") & F.col("kept"))
    return PR.top_words(v, 20, "comment_processed")


@query("class_share_by_version", "D9", f"""
WITH v AS ({versions_cte('labelled_reviews', ('sentiment_label',))}),
c AS (SELECT version, sentiment_label, count(*) AS n, avg(length(comment_processed)) AS avg_length
      FROM v WHERE kept GROUP BY ALL)
SELECT version, sentiment_label, n, n / sum(n) OVER (PARTITION BY version) AS share, avg_length FROM c""",
       ("labelled_reviews",))
def q_class_share_by_version(spark, sf):
    v = versions_df(spark, sf, keep=("sentiment_label",), src=X.labelled_reviews(spark, sf)).filter("kept")
    return PR.class_share_by_version(v)


@query("corpus_summary", "D10", f"""
SELECT count(*) AS n_docs, avg(len({S.split_ws('comment')})) AS avg_document_length,
  count(DISTINCT comment) AS unique_documents, """ + ", ".join(
    f"count(*) FILTER (WHERE sentiment_label = '{l}') AS n_{l}" for l in X.LABELS) + " FROM labelled_reviews",
       ("labelled_reviews",))
def q_corpus_summary(spark, sf):
    return PR.corpus_summary(X.labelled_reviews(spark, sf), labels=X.LABELS)
