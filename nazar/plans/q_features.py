"""Registered queries: sparse text features (F*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from nazar.functions import lexicons as LX
from nazar.functions import text as T
from nazar.functions.mathx import rnd, rnd_sql
from nazar.operators import cleaning as C
from nazar.operators import tfidf as TF
from nazar.operators.common import n_rows
from nazar.plans import fixtures as X
from nazar.plans import sqltext as S
from nazar.plans.registry import query

EMO = LX.DEFAULT_EMOJI_MAP
STOP = LX.FIXTURE_STOPWORDS
# Lexicon-feature words for the Latin fixture prose (the Persian defaults match nothing there).
FIXTURE_POSITIVE = ["the", "with", "des", "und", "para"]
FIXTURE_NEGATIVE = ["and", "le", "la", "nicht", "los"]
SIM_SAMPLE = 50


# ---------------------------------------------------------------- Spark inputs

def tfidf_docs(spark, sf, src=None):
    """(id, terms): medium cleaning → tokens → stopwords → analyzer (2..20 chars).

    The analyzer splits the space-joined tokens on whitespace; tokens are
    non-empty and contain no whitespace, so that is the token array itself
    and only the length filter remains (no join + re-split).
    """
    r = src if src is not None else X.reviews(spark, sf)
    toks = C.preprocess_tokens(F.col("comment"), "medium", STOP, emoji_map=EMO)
    return r.select("id", F.filter(toks, lambda t: F.length(t).between(2, 20)).alias("terms"))


def fitted(spark, sf, **kw):
    docs = tfidf_docs(spark, sf)
    vocab, w = TF.fit_tfidf(docs, **kw)
    return docs, vocab, w


# ---------------------------------------------------------------- SQL mirror

DOC_TERMS_SQL = S.analyze(S.join_tokens(S.remove_stopwords(S.tokenize(S.clean_text("comment", "medium", EMO)), STOP)))


def tfidf_ctes(src="reviews", terms_sql=DOC_TERMS_SQL, min_df=2, max_df=0.8, max_features=10000,
               sublinear=True, prefix="") -> str:
    p = prefix
    tfw = "(1 + ln(tf.tf))" if sublinear else "CAST(tf.tf AS DOUBLE)"
    lim = f"ORDER BY cf DESC, term LIMIT {max_features}" if max_features else ""
    return f"""{p}docs AS (SELECT id, {terms_sql} AS terms FROM {src}),
{p}tf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(terms) AS term FROM {p}docs) GROUP BY id, term),
{p}n AS (SELECT count(*) AS n FROM {p}docs),
{p}st AS (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM {p}tf GROUP BY term),
{p}kept AS (SELECT st.* FROM {p}st st, {p}n WHERE df >= {min_df} AND df <= {max_df} * {p}n.n {lim}),
{p}vocab AS (SELECT term, df, cf, CAST(row_number() OVER (ORDER BY term) - 1 AS INTEGER) AS idx,
             ln((1.0 + {p}n.n) / (1.0 + df)) + 1 AS idf FROM {p}kept, {p}n),
{p}w0 AS (SELECT tf.id, tf.term, v.idx, {tfw} * v.idf AS w FROM {p}tf tf JOIN {p}vocab v ON tf.term = v.term),
{p}weights AS (SELECT id, term, idx, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS weight FROM {p}w0)"""


def with_tfidf(body: str, **kw) -> str:
    return f"WITH {tfidf_ctes(**kw)}\n{body}"


# ---------------------------------------------------------------- F1–F6

@query("tfidf_vocab", "F4", with_tfidf(f"SELECT term, df, cf, idx, {rnd_sql('idf')} AS idf FROM vocab"), ("reviews",))
def q_tfidf_vocab(spark, sf):
    _, vocab, _ = fitted(spark, sf, weigh=False)
    return vocab.select("term", "df", "cf", "idx", rnd(F.col("idf")).alias("idf"))


@query("tfidf_weights", "F5", with_tfidf(f"SELECT id, term, idx, {rnd_sql('weight')} AS weight FROM weights"),
       ("reviews",))
def q_tfidf_weights(spark, sf):
    _, _, w = fitted(spark, sf)
    return w.select("id", "term", "idx", rnd(F.col("weight")).alias("weight"))


@query("tfidf_transform", "F6", f"""
WITH {tfidf_ctes(src="labelled_reviews")},
ntf AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest({DOC_TERMS_SQL}) AS term FROM reviews) GROUP BY id, term),
nw0 AS (SELECT ntf.id, ntf.term, (1 + ln(ntf.tf)) * v.idf AS w FROM ntf JOIN vocab v ON ntf.term = v.term)
SELECT id, CAST(count(*) AS BIGINT) AS n_terms, {rnd_sql('sum(w) / sqrt(sum(w * w))')} AS l1_over_l2 FROM nw0 GROUP BY id""",
       ("labelled_reviews",))
def q_tfidf_transform(spark, sf):
    train = tfidf_docs(spark, sf, X.labelled_reviews(spark, sf))
    vocab, _ = TF.fit_tfidf(train, weigh=False)
    w = TF.tfidf_transform(tfidf_docs(spark, sf), vocab)
    return w.groupBy("id").agg(F.count(F.lit(1)).alias("n_terms"), rnd(F.sum("weight")).alias("l1_over_l2"))


_WORD_TERMS_SQL = ("list_concat(t, CASE WHEN len(t) >= 2 THEN list_transform(range(1, len(t)), "
                   "lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)")


def _word_terms_sql():
    toks = f"regexp_extract_all({S.clean_text('comment', 'medium', EMO)}, '[\\p{{L}}\\p{{N}}_]{{2,}}')"
    return f"(SELECT {_WORD_TERMS_SQL} FROM (SELECT {toks} AS t))"


@query("word_ngram_vocab", "F2", with_tfidf(f"SELECT term, df, cf, idx, {rnd_sql('idf')} AS idf FROM vocab",
                                            terms_sql=_word_terms_sql(), sublinear=False), ("reviews",))
def q_word_ngram_vocab(spark, sf):
    r = X.reviews(spark, sf)
    toks = TF.sklearn_word_tokens(T.clean_text(F.col("comment"), "medium", EMO))
    docs = TF.with_word_terms(r, toks, 2)
    vocab, _ = TF.fit_tfidf(docs, sublinear=False, weigh=False)
    return vocab.select("term", "df", "cf", "idx", rnd(F.col("idf")).alias("idf"))


def _char_terms_sql():
    s = f"lower({S.rx(S.clean_text('comment', 'medium', EMO), T.P.WS + '{2,}', ' ')})"
    grams = " , ".join(
        f"CASE WHEN length(s) >= {n} THEN list_transform(range(1, length(s) - {n} + 2), lambda i: substr(s, i, {n})) ELSE [] END"
        for n in (2, 3, 4))
    return f"(SELECT list_concat({grams}) FROM (SELECT {s} AS s))"


@query("char_ngram_vocab", "F3", with_tfidf(f"SELECT term, df, cf, idx FROM vocab", terms_sql=_char_terms_sql(),
                                            max_df=1.0, max_features=5000, sublinear=False), ("reviews",))
def q_char_ngram_vocab(spark, sf):
    r = X.reviews(spark, sf)
    vocab = TF.char_vocab(r, T.clean_text(F.col("comment"), "medium", EMO), 2, 4, max_df=1.0, max_features=5000)
    return vocab.select("term", "df", "cf", "idx")


# ---------------------------------------------------------------- F7–F12

@query("matrix_stats", "F7", with_tfidf("""
SELECT (SELECT n FROM n) AS n_docs, (SELECT count(*) FROM vocab) AS n_terms, count(*) AS nnz,
  1.0 - count(*) / ((SELECT n FROM n) * (SELECT count(*) FROM vocab))::DOUBLE AS sparsity FROM weights"""), ("reviews",))
def q_matrix_stats(spark, sf):
    docs, vocab, w = fitted(spark, sf)
    return TF.matrix_stats(w, vocab, n_rows(docs))


@query("term_stats", "F8", with_tfidf(f"""
SELECT term, {rnd_sql('sum(weight)')} AS sum, {rnd_sql('max(weight)')} AS max,
  {rnd_sql('sum(weight) / (SELECT n FROM n)')} AS mean FROM weights GROUP BY term"""), ("reviews",))
def q_term_stats(spark, sf):
    docs, _, w = fitted(spark, sf)
    s = TF.term_stats(w, n_rows(docs))
    return s.select("term", rnd(F.col("sum")).alias("sum"), rnd(F.col("max")).alias("max"),
                    rnd(F.col("mean")).alias("mean"))


@query("top_terms", "F9", with_tfidf(f"""
SELECT term, {rnd_sql('sum(weight)')} AS score FROM weights GROUP BY term ORDER BY score DESC, term LIMIT 50"""),
       ("reviews",))
def q_top_terms(spark, sf):
    _, _, w = fitted(spark, sf)
    return TF.top_terms(w, 50)


@query("ngram_mix", "F10", with_tfidf("""
SELECT count(*) AS total_features, count(*) FILTER (WHERE len(string_split(term, ' ')) = 1) AS unigrams,
  count(*) FILTER (WHERE len(string_split(term, ' ')) = 2) AS bigrams,
  count(*) FILTER (WHERE len(string_split(term, ' ')) = 3) AS trigrams,
  count(*) FILTER (WHERE len(string_split(term, ' ')) = 1) / count(*)::DOUBLE AS unigram_ratio,
  count(*) FILTER (WHERE len(string_split(term, ' ')) = 2) / count(*)::DOUBLE AS bigram_ratio FROM vocab""",
                                     terms_sql=_word_terms_sql(), sublinear=False), ("reviews",))
def q_ngram_mix(spark, sf):
    r = X.reviews(spark, sf)
    toks = TF.sklearn_word_tokens(T.clean_text(F.col("comment"), "medium", EMO))
    vocab, _ = TF.fit_tfidf(TF.with_word_terms(r, toks, 2), sublinear=False, weigh=False)
    return TF.ngram_mix(vocab)


TOP_BY_CLASS_SQL = with_tfidf(f"""
, sizes AS (SELECT sentiment_label, count(*) AS m FROM review_labels GROUP BY sentiment_label),
s AS (SELECT l.sentiment_label, w.term, {rnd_sql('sum(w.weight) / any_value(z.m)')} AS score
      FROM weights w JOIN review_labels l ON w.id = l.id JOIN sizes z ON z.sentiment_label = l.sentiment_label
      GROUP BY l.sentiment_label, w.term)
SELECT sentiment_label, term, score, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY sentiment_label ORDER BY score DESC, term) AS INTEGER) AS rank FROM s)
WHERE rank <= 20""")


@query("top_terms_by_class", "F11", TOP_BY_CLASS_SQL, ("reviews", "review_labels"))
def q_top_terms_by_class(spark, sf):
    _, _, w = fitted(spark, sf, only=X.review_labels(spark, sf))
    return TF.top_terms_by_class(w, X.review_labels(spark, sf), 20)


_SAMPLE_SQL = f"(SELECT id FROM docs ORDER BY md5('42:' || CAST(id AS VARCHAR)) LIMIT {SIM_SAMPLE})"


@query("doc_similarity", "F12", with_tfidf(f"""
, t AS (SELECT w.id AS id_b, w.term, w.weight AS w_b FROM weights w WHERE w.id IN {_SAMPLE_SQL})
SELECT a.id AS id_a, t.id_b, {rnd_sql('sum(a.weight * t.w_b)')} AS cosine
FROM weights a JOIN t ON a.term = t.term WHERE a.id <> t.id_b GROUP BY a.id, t.id_b"""),
       ("reviews",))
def q_doc_similarity(spark, sf):
    docs, _, w = fitted(spark, sf)
    return TF.doc_similarity(w, TF.sample_ids(docs, SIM_SAMPLE), n_targets=SIM_SAMPLE)


# ---------------------------------------------------------------- F14–F18

@query("text_length_features", "F14", f"""
SELECT id, CAST(length(coalesce(comment, '')) AS INTEGER) AS char_count,
  CAST(len({S.split_ws("coalesce(comment, '')")}) AS INTEGER) AS word_count,
  CASE WHEN len({S.split_ws("coalesce(comment, '')")}) > 0 THEN
    list_sum(list_transform({S.split_ws("coalesce(comment, '')")}, lambda w: length(w))) / len({S.split_ws("coalesce(comment, '')")})
  ELSE 0.0 END AS avg_word_length,
  CAST(length(coalesce(comment, '')) - length(translate(coalesce(comment, ''), '.!?', '')) + 1 AS INTEGER) AS sentence_count
FROM reviews""", ("reviews",))
def q_text_length_features(spark, sf):
    return TF.text_length_features(X.reviews(spark, sf))


def _lex_sql(words):
    return "[" + ", ".join(S.lit(w) for w in words) + "]"


_WSET = f"list_distinct({S.split_ws(chr(99) + 'oalesce(comment, ' + chr(39) * 2 + ')')})"


@query("lexicon_features", "F15", f"""
SELECT id, CAST(len(list_filter({_WSET}, lambda w: list_contains({_lex_sql(FIXTURE_POSITIVE)}, w))) AS INTEGER) AS positive_words,
  CAST(len(list_filter({_WSET}, lambda w: list_contains({_lex_sql(FIXTURE_NEGATIVE)}, w))) AS INTEGER) AS negative_words,
  CAST(len(list_filter({_WSET}, lambda w: list_contains({_lex_sql(FIXTURE_POSITIVE)}, w)))
     - len(list_filter({_WSET}, lambda w: list_contains({_lex_sql(FIXTURE_NEGATIVE)}, w))) AS INTEGER) AS sentiment_score
FROM reviews""", ("reviews",))
def q_lexicon_features(spark, sf):
    return TF.lexicon_features(X.reviews(spark, sf), FIXTURE_POSITIVE, FIXTURE_NEGATIVE)


@query("assemble_features", "F16", with_tfidf(f"""
, lf AS (SELECT id, length(comment) AS c, len({S.split_ws('comment')}) AS wc FROM reviews),
blocks AS (
  SELECT id, idx, weight AS value, 'tfidf' AS block FROM weights
  UNION ALL SELECT id, (SELECT count(*) FROM vocab) + 0, CAST(c AS DOUBLE), 'length' FROM lf
  UNION ALL SELECT id, (SELECT count(*) FROM vocab) + 1, CAST(wc AS DOUBLE), 'length' FROM lf)
SELECT block, CAST(count(*) AS BIGINT) AS n, CAST(max(idx) AS INTEGER) AS max_idx, {rnd_sql('sum(value)')} AS total
FROM blocks GROUP BY block"""), ("reviews",))
def q_assemble_features(spark, sf):
    r = X.reviews(spark, sf)
    _, vocab, w = fitted(spark, sf)
    tfidf_block = w.select("id", "idx", F.col("weight").alias("value"))
    lf = r.select("id", F.length("comment").alias("c"), F.size(T.split_ws(F.col("comment"))).alias("wc"))
    length_block = lf.select("id", F.lit(0).alias("idx"), F.col("c").alias("value")).unionByName(
        lf.select("id", F.lit(1).alias("idx"), F.col("wc").alias("value")))
    # the tfidf block is as wide as the vocabulary, even if its last terms are unused
    width = vocab.agg(F.count(F.lit(1))).scalar()
    a = TF.assemble_features([("tfidf", tfidf_block.withColumn("idx", F.col("idx")))], "id")
    b = length_block.select("id", (F.col("idx") + width).cast("int").alias("idx"),
                            F.col("value").cast("double").alias("value"), F.lit("length").alias("block"))
    blocks = a.unionByName(b)
    return blocks.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.max("idx").cast("int").alias("max_idx"),
                                       rnd(F.sum("value")).alias("total"))


@query("anova_f", "F17", with_tfidf(f"""
, lab AS (SELECT id, sentiment_label FROM review_labels),
sizes AS (SELECT sentiment_label, count(*) AS m FROM lab GROUP BY sentiment_label),
pc AS (SELECT w.term, l.sentiment_label, sum(w.weight) AS s, sum(w.weight * w.weight) AS q
       FROM weights w JOIN lab l ON w.id = l.id GROUP BY ALL),
per AS (SELECT term, sum(s) AS S, sum(q) AS Q, sum(s * s / z.m) AS B FROM pc JOIN sizes z USING (sentiment_label) GROUP BY term),
k AS (SELECT count(*) AS k, sum(m) AS n FROM sizes)
SELECT term, {rnd_sql('CASE WHEN Q - B > 0 THEN ((B - S * S / k.n) / (k.k - 1)) / ((Q - B) / (k.n - k.k)) END')} AS f_score
FROM per, k ORDER BY f_score DESC NULLS LAST, term LIMIT 1000"""),
       ("reviews", "review_labels"))
def q_anova_f(spark, sf):
    _, _, w = fitted(spark, sf, only=X.review_labels(spark, sf))
    return TF.anova_f(w, X.review_labels(spark, sf), 1000)


@query("feature_comparison", "F18", with_tfidf("""
SELECT 'tfidf' AS representation, (SELECT count(*) FROM vocab) AS dimensions,
  1.0 - (SELECT count(*) FROM weights) / ((SELECT n FROM n) * (SELECT count(*) FROM vocab))::DOUBLE AS sparsity,
  'sparse' AS type
UNION ALL SELECT 'word_vectors', CAST((SELECT max(len(embedding)) FROM embeddings) AS BIGINT), 0.0, 'dense'"""),
       ("reviews",))
def q_feature_comparison(spark, sf):
    docs, vocab, w = fitted(spark, sf)
    ms = TF.matrix_stats(w, vocab, n_rows(docs))
    emb = X.table(spark, sf, "embeddings")
    dims_e = emb.agg(F.max(F.size("embedding"))).scalar()
    a = ms.select(F.lit("tfidf").alias("representation"), F.col("n_terms").cast("bigint").alias("dimensions"),
                  F.col("sparsity"), F.lit("sparse").alias("type"))
    b = spark.range(1).select(F.lit("word_vectors").alias("representation"), dims_e.cast("bigint").alias("dimensions"),
                              F.lit(0.0).alias("sparsity"), F.lit("dense").alias("type"))
    return a.unionByName(b)


@query("svd", "F13")
def q_svd(spark, sf):
    _, vocab, w = fitted(spark, sf)
    n_terms = vocab.count()
    return TF.svd(w, n_terms, k=10)
