"""Registered queries: word vectors (G*), embedding analytics (H*), sequences."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nazar.functions import lexicons as LX
from nazar.functions.mathx import rnd, rnd_sql
from nazar.operators import cleaning as C
from nazar.operators import sequence as Q
from nazar.operators import vectors as V
from nazar.plans import fixtures as X
from nazar.plans import sqltext as S
from nazar.plans.registry import query
from nazar.session import saved

EMO = LX.DEFAULT_EMOJI_MAP
STOP = LX.FIXTURE_STOPWORDS
MAX_LEN = 128
SEQ_VEC_LEN = 100


# ---------------------------------------------------------------- fixture inputs

def review_tokens(spark, sf):
    r = X.reviews(spark, sf)
    return r.select("id", C.preprocess_tokens(F.col("comment"), "medium", STOP, emoji_map=EMO).alias("tokens"))


def word_index(spark, sf, tokens=None):
    return Q.build_word_index(review_tokens(spark, sf) if tokens is None else tokens, min_freq=2)


def review_vectors(spark, sf, index):
    """Vectors for review words: the embedding with vec_id = 2·idx (about half the words get one)."""
    e = X.table(spark, sf, "embeddings")
    ix = index.filter(F.col("idx") >= 2)
    return ix.join(e, e.vec_id == ix.idx * 2).select("word", e.embedding.cast("array<double>").alias("vec"))


def tokens_and_vectors(spark, sf):
    """Tokens, written once as both read them, and the vectors of their words."""
    toks = saved(review_tokens(spark, sf))
    return toks, review_vectors(spark, sf, word_index(spark, sf, toks))


def probes(spark, sf):
    """One probe per embedding label: its word with the smallest vec_id."""
    wv = X.word_vectors(spark, sf).withColumn("_v", F.expr("CAST(substr(word, 2) AS BIGINT)"))
    first = wv.groupBy("grp").agg(F.min("_v").alias("_v"))
    return wv.join(first, ["grp", "_v"]).select(F.col("word").alias("qword"), F.col("vec").alias("qvec"))


def triples(spark, sf):
    """Per label: (1st, 2nd, 3rd word) → expected 4th word, in vec_id order."""
    wv = X.word_vectors(spark, sf).withColumn("_v", F.expr("CAST(substr(word, 2) AS BIGINT)"))
    r = wv.withColumn("_r", F.row_number().over(W.partitionBy("grp").orderBy("_v"))).filter(F.col("_r") <= 4)
    p = r.groupBy("grp").pivot("_r", [1, 2, 3, 4]).agg(F.first("word"))
    return p.select(F.col("1").alias("a"), F.col("2").alias("b"), F.col("3").alias("c"), F.col("4").alias("expected"))


TOKENS_SQL = S.remove_stopwords(S.tokenize(S.clean_text("comment", "medium", EMO)), STOP)
BASE_CTE = f"""rt AS (SELECT id, {TOKENS_SQL} AS tokens FROM reviews),
wf AS (SELECT word, count(*) AS freq FROM (SELECT unnest(tokens) AS word FROM rt) GROUP BY word HAVING count(*) >= 2),
widx AS (SELECT '<PAD>' AS word, 0 AS idx, CAST(0 AS BIGINT) AS freq UNION ALL SELECT '<UNK>', 1, 0 UNION ALL
         SELECT word, CAST(row_number() OVER (ORDER BY freq DESC, word) + 1 AS INTEGER), freq FROM wf),
rv AS (SELECT w.word, CAST(e.embedding AS DOUBLE[]) AS vec FROM widx w JOIN embeddings e ON e.vec_id = w.idx * 2
       WHERE w.idx >= 2)"""
WV_CTE = """wv AS (SELECT word, vec, grp, CAST(substr(word, 2) AS BIGINT) AS v FROM word_vectors),
wu AS (SELECT word, grp, v, list_transform(vec, lambda x: x / nrm) AS u
       FROM (SELECT *, sqrt(list_sum(list_transform(vec, lambda y: y * y))) AS nrm FROM wv))"""


def _round_arr_sql(e, d=9):
    return f"list_transform({e}, lambda x: {rnd_sql('x', d)})"


def _round_arr(c, d=9):
    return F.transform(c, lambda x: rnd(x, d))


# ---------------------------------------------------------------- I1–I5

@query("build_word_index", "I1", f"WITH {BASE_CTE} SELECT word, idx, freq FROM widx", ("reviews",))
def q_build_word_index(spark, sf):
    return word_index(spark, sf)


@query("encode_sequences", "I2", f"""WITH {BASE_CTE},
ex AS (SELECT id, unnest(tokens) AS word, unnest(range(0, len(tokens))) AS pos FROM rt),
j AS (SELECT ex.id, ex.pos, coalesce(w.idx, 1) AS idx FROM ex LEFT JOIN widx w ON ex.word = w.word WHERE ex.pos < {MAX_LEN}),
g AS (SELECT id, list(idx ORDER BY pos) AS ids FROM j GROUP BY id)
SELECT r.id, md5(array_to_string(list_concat(coalesce(g.ids, []), list_transform(range(0, {MAX_LEN} - len(coalesce(g.ids, []))), lambda i: 0)), ',')) AS h,
  CAST(len(coalesce(g.ids, [])) AS INTEGER) AS length
FROM rt r LEFT JOIN g ON r.id = g.id""", ("reviews",))
def q_encode_sequences(spark, sf):
    toks = saved(review_tokens(spark, sf))
    e = Q.encode_sequences(toks, word_index(spark, sf, toks), max_len=MAX_LEN)
    return e.select("id", F.md5(F.array_join("ids", ",")).alias("h"), "length")


@query("embedding_coverage", "I3", f"""WITH {BASE_CTE}
SELECT count(*) AS vocab_size, count(rv.word) AS found, count(rv.word) / count(*) AS coverage
FROM widx LEFT JOIN rv ON widx.word = rv.word""", ("reviews",))
def q_embedding_coverage(spark, sf):
    ix = word_index(spark, sf)
    return Q.embedding_coverage(ix, review_vectors(spark, sf, ix))


@query("sequence_vectors", "I4", f"""WITH {BASE_CTE},
ex AS (SELECT id, unnest(tokens) AS word, unnest(range(0, len(tokens))) AS pos FROM rt),
k AS (SELECT ex.id, CAST(ex.pos AS INTEGER) AS pos, coalesce(rv.vec, list_transform(range(0, 64), lambda i: 0.0)) AS vec
      FROM ex LEFT JOIN rv ON ex.word = rv.word WHERE ex.pos < {SEQ_VEC_LEN}),
pads AS (SELECT id, CAST(unnest(range(least(len(tokens), {SEQ_VEC_LEN}), {SEQ_VEC_LEN})) AS INTEGER) AS pos,
           list_transform(range(0, 64), lambda i: 0.0) AS vec FROM rt),
a AS (SELECT * FROM k UNION ALL SELECT * FROM pads)
SELECT id, count(*) AS n_positions, count(*) FILTER (WHERE list_sum(list_transform(vec, lambda x: abs(x))) > 0) AS n_known,
  {rnd_sql('sum(list_sum(vec))', 6)} AS total FROM a GROUP BY id""", ("reviews",))
def q_sequence_vectors(spark, sf):
    s = Q.sequence_vectors(*tokens_and_vectors(spark, sf), 64, max_len=SEQ_VEC_LEN)
    s = s.withColumn("_abs", F.aggregate("vec", F.lit(0.0), lambda a, x: a + F.abs(x))) \
         .withColumn("_sum", F.aggregate("vec", F.lit(0.0), lambda a, x: a + x))
    return s.groupBy("id").agg(F.count(F.lit(1)).alias("n_positions"),
                               F.count(F.when(F.col("_abs") > 0, 1)).alias("n_known"),
                               rnd(F.sum("_sum"), 6).alias("total"))


@query("encode_labels", "I5", """
SELECT sentiment_label, CAST(dense_rank() OVER (ORDER BY sentiment_label) - 1 AS INTEGER) AS label_code, count(*) AS n
FROM review_labels GROUP BY sentiment_label""", ("review_labels",))
def q_encode_labels(spark, sf):
    e = Q.encode_labels(X.review_labels(spark, sf))
    return e.groupBy("sentiment_label", "label_code").agg(F.count(F.lit(1)).alias("n"))


@query("encode_labels_fixed", "I5", """
SELECT sentiment_label, CAST(CASE sentiment_label WHEN 'positive' THEN 1 WHEN 'negative' THEN -1 END AS INTEGER) AS label_code, count(*) AS n
FROM review_labels GROUP BY sentiment_label""", ("review_labels",))
def q_encode_labels_fixed(spark, sf):
    e = Q.encode_labels(X.review_labels(spark, sf), mapping={"positive": 1, "negative": -1})
    return e.groupBy("sentiment_label", "label_code").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- G

@query("sentences", "G1", f"""WITH {BASE_CTE}, s AS (SELECT * FROM rt WHERE len(tokens) > 1)
SELECT (SELECT count(*) FROM (SELECT unnest(tokens) FROM s)) AS total_words,
  (SELECT count(DISTINCT w) FROM (SELECT unnest(tokens) AS w FROM s)) AS unique_words,
  count(*) AS n_sentences, avg(len(tokens)) AS mean_length FROM s""", ("reviews",))
def q_sentences(spark, sf):
    return V.sentences(review_tokens(spark, sf))


@query("vocab_coverage", "G3", f"""WITH {BASE_CTE},
c AS (SELECT word, count(*) AS freq FROM (SELECT unnest(tokens) AS word FROM rt) GROUP BY word),
top AS (SELECT word, freq FROM c ORDER BY freq DESC, word LIMIT 20)
SELECT count(*) AS unique_words, count(rv.word) AS in_model, count(rv.word) / count(*) AS coverage,
  (SELECT count(*) * coalesce(max(len(vec)), 0) FROM rv) * 4 / {float(2 ** 20)!r} AS model_size_mb,
  (SELECT coalesce(list(word ORDER BY freq DESC, word), []) FROM top) AS most_frequent_words,
  (SELECT coalesce(list(freq ORDER BY freq DESC, word), []) FROM top) AS most_frequent_counts FROM c LEFT JOIN rv ON c.word = rv.word""",
       ("reviews",))
def q_vocab_coverage(spark, sf):
    return V.vocab_coverage(*tokens_and_vectors(spark, sf))


@query("most_frequent_words", "G3", f"""WITH {BASE_CTE}
SELECT word, count(*) AS freq FROM (SELECT unnest(tokens) AS word FROM rt) GROUP BY word ORDER BY freq DESC, word LIMIT 20""",
       ("reviews",))
def q_most_frequent_words(spark, sf):
    return V.most_frequent_words(review_tokens(spark, sf))


@query("most_similar", "G4", f"""WITH {WV_CTE},
pr AS (SELECT w.word AS qword, w.u AS qu FROM wu w JOIN (SELECT grp, min(v) AS v FROM wu GROUP BY grp) m USING (grp, v)),
x AS (SELECT pr.qword AS query, wu.word, {rnd_sql('list_dot_product(wu.u, pr.qu)', 9)} AS cosine FROM wu, pr
      WHERE wu.word <> pr.qword)
SELECT query, word, cosine, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, word) AS INTEGER) AS rank FROM x)
WHERE rank <= 10""", ("word_vectors",))
def q_most_similar(spark, sf):
    return V.most_similar(X.word_vectors(spark, sf), probes(spark, sf), topn=10)


@query("analogy", "G5", f"""WITH {WV_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v) AS rn FROM wu),
t AS (SELECT max(CASE WHEN rn = 1 THEN word END) AS a, max(CASE WHEN rn = 2 THEN word END) AS b,
             max(CASE WHEN rn = 3 THEN word END) AS c, max(CASE WHEN rn = 4 THEN word END) AS expected,
             max(CASE WHEN rn = 1 THEN u END) AS ua, max(CASE WHEN rn = 2 THEN u END) AS ub,
             max(CASE WHEN rn = 3 THEN u END) AS uc FROM r WHERE rn <= 4 GROUP BY grp),
q AS (SELECT a || '|' || b || '|' || c AS query, a, b, c, expected,
        list_transform(list_zip(ub, uc, ua), lambda z: z[1] + z[2] - z[3]) AS q FROM t),
qn AS (SELECT *, list_transform(q, lambda x: x / nrm) AS qu FROM (SELECT *, sqrt(list_sum(list_transform(q, lambda y: y * y))) AS nrm FROM q)),
x AS (SELECT qn.query, qn.expected, wu.word, {rnd_sql('list_dot_product(wu.u, qn.qu)', 9)} AS cosine FROM wu, qn
      WHERE wu.word NOT IN (qn.a, qn.b, qn.c)),
top AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY cosine DESC, word) AS INTEGER) AS rank FROM x)
        WHERE rank <= 5)
SELECT query, word, cosine, rank, max(CAST(word = expected AS INTEGER)) OVER (PARTITION BY query) AS hit FROM top""",
       ("word_vectors",))
def q_analogy(spark, sf):
    r = V.analogy(X.word_vectors(spark, sf), triples(spark, sf), topn=5)
    return r.select("query", "word", "cosine", "rank", "hit")


@query("analogy_accuracy", "G5", f"""WITH {WV_CTE},
r AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY v) AS rn FROM wu),
t AS (SELECT max(CASE WHEN rn = 1 THEN word END) AS a, max(CASE WHEN rn = 2 THEN word END) AS b,
             max(CASE WHEN rn = 3 THEN word END) AS c, max(CASE WHEN rn = 4 THEN word END) AS expected,
             max(CASE WHEN rn = 1 THEN u END) AS ua, max(CASE WHEN rn = 2 THEN u END) AS ub,
             max(CASE WHEN rn = 3 THEN u END) AS uc FROM r WHERE rn <= 4 GROUP BY grp),
q AS (SELECT a || '|' || b || '|' || c AS query, a, b, c, expected,
        list_transform(list_zip(ub, uc, ua), lambda z: z[1] + z[2] - z[3]) AS q FROM t),
qn AS (SELECT *, sqrt(list_sum(list_transform(q, lambda y: y * y))) AS nrm FROM q),
x AS (SELECT qn.query, wu.word = qn.expected AS hit, wu.word, {rnd_sql('list_dot_product(wu.u, qn.q) / qn.nrm', 9)} AS cosine FROM wu, qn
      WHERE wu.word NOT IN (qn.a, qn.b, qn.c)),
top AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY query ORDER BY cosine DESC, word) <= 200),
h AS (SELECT query, max(CAST(hit AS INTEGER)) AS hit FROM top GROUP BY query)
SELECT CAST(sum(hit) AS BIGINT) AS correct, count(*) AS total, avg(hit) AS accuracy FROM h""", ("word_vectors",))
def q_analogy_accuracy(spark, sf):
    return V.analogy_accuracy(V.analogy(X.word_vectors(spark, sf), triples(spark, sf), topn=200))


@query("silhouette", "G7", """WITH d AS (
  SELECT a.word, a.grp, b.grp AS other, list_distance(a.vec, b.vec) AS dist
  FROM word_vectors a JOIN word_vectors b ON a.word <> b.word),
m AS (SELECT word, grp, other, avg(dist) AS md FROM d GROUP BY ALL),
s AS (SELECT word, grp, max(CASE WHEN other = grp THEN md END) AS a, min(CASE WHEN other <> grp THEN md END) AS b FROM m GROUP BY ALL),
sv AS (SELECT grp, CASE WHEN a IS NULL THEN 0.0 WHEN greatest(a, b) > 0 THEN (b - a) / greatest(a, b) ELSE 0.0 END AS s FROM s)
SELECT grp, count(*) AS n, """ + rnd_sql('avg(s)', 6) + " AS mean_silhouette FROM sv GROUP BY grp", ("word_vectors",))
def q_silhouette(spark, sf):
    s = V.silhouette(X.word_vectors(spark, sf), "grp", "word", "vec")
    return s.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), rnd(F.avg("silhouette"), 6).alias("mean_silhouette"))


@query("group_coherence", "G8", f"""WITH {WV_CTE},
p AS (SELECT a.grp, list_dot_product(a.u, b.u) AS c FROM wu a JOIN wu b ON a.grp = b.grp AND a.word < b.word)
SELECT grp, (SELECT count(*) FROM wu w WHERE w.grp = p.grp) AS n, {rnd_sql('avg(c)', 6)} AS mean_cosine,
  {rnd_sql('stddev_pop(c)', 6)} AS std_cosine FROM p GROUP BY grp""", ("word_vectors",))
def q_group_coherence(spark, sf):
    g = V.group_coherence(X.word_vectors(spark, sf), "grp")
    return g.select("grp", "n", rnd(F.col("mean_cosine"), 6).alias("mean_cosine"),
                    rnd(F.col("std_cosine"), 6).alias("std_cosine"))


@query("lookup_vector", "G9", f"""WITH {BASE_CTE}
SELECT w.word, {rnd_sql('list_sum(rv.vec)', 9)} AS vec_sum, rv.vec IS NULL AS missing FROM widx w LEFT JOIN rv ON w.word = rv.word""",
       ("reviews",))
def q_lookup_vector(spark, sf):
    ix = word_index(spark, sf)
    l = V.lookup_vector(ix.select("word"), review_vectors(spark, sf, ix))
    return l.select("word", rnd(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x), 9).alias("vec_sum"),
                    F.col("vec").isNull().alias("missing"))


def _doc_vec_sql(agg):
    return f"""WITH {BASE_CTE},
ex AS (SELECT id, unnest(tokens) AS word FROM rt),
comp AS (SELECT ex.id, unnest(rv.vec) AS val, unnest(range(0, len(rv.vec))) AS dim FROM ex JOIN rv ON ex.word = rv.word),
per AS (SELECT id, dim, {agg}(val) AS v FROM comp GROUP BY id, dim),
arr AS (SELECT id, list(v ORDER BY dim) AS doc_vec FROM per GROUP BY id)
SELECT rt.id, {_round_arr_sql('arr.doc_vec', 9)} AS doc_vec FROM rt LEFT JOIN arr ON rt.id = arr.id"""


for _how, _agg in (("average", "avg"), ("sum", "sum"), ("max", "max")):
    def _mk(how=_how):
        def fn(spark, sf):
            d = V.doc_vector(*tokens_and_vectors(spark, sf), how)
            return d.select("id", _round_arr(F.col("doc_vec"), 9).alias("doc_vec"))
        return fn
    query(f"doc_vector_{_how}", "G10", _doc_vec_sql(_agg), ("reviews",))(_mk())

FIXTURE_GROUPS = {"group_a": ["w1", "w2", "w3"], "group_b": ["w3", "w4", "w5"], "group_c": ["w10", "w11"]}


@query("assign_semantic_group", "G11", """
WITH t AS (SELECT * FROM (VALUES """ + ", ".join(
    f"('{w}', '{g}', {i})" for i, (g, ws) in enumerate(FIXTURE_GROUPS.items()) for w in ws) + """) t(word, grp, ord)),
f AS (SELECT word, arg_min(grp, ord) AS grp FROM t GROUP BY word)
SELECT w.word, coalesce(f.grp, 'other') AS "group" FROM word_vectors w LEFT JOIN f ON w.word = f.word""", ("word_vectors",))
def q_assign_semantic_group(spark, sf):
    return V.assign_semantic_group(X.word_vectors(spark, sf).select("word"), FIXTURE_GROUPS)


@query("train_word2vec", "G2")
def q_train_word2vec(spark, sf):
    _, vecs = V.train_word2vec(review_tokens(spark, sf))
    return vecs.select("word", F.size("vec").alias("dim"))


@query("kmeans", "G6")
def q_kmeans(spark, sf):
    _, sizes, cost = V.kmeans(X.word_vectors(spark, sf), k=10)
    return sizes.withColumn("inertia", F.lit(float(cost)))


@query("pca", "G12")
def q_pca(spark, sf):
    proj, ratios = V.pca(X.word_vectors(spark, sf), 10)
    return spark.createDataFrame([(i, r) for i, r in enumerate(ratios)], "component int, variance_ratio double")


@query("kmeans_identities", "G6", """
SELECT count(*) AS points, CAST(10 AS BIGINT) AS clusters, true AS inertia_is_sum_of_squares FROM word_vectors""", ("word_vectors",))
def q_kmeans_identities(spark, sf):
    assigned, sizes, cost = V.kmeans(X.word_vectors(spark, sf), k=10)
    # Σ‖x − mean of its cluster‖² = Σ (n − 1)·variance, when the centres have settled on the means: within 1 %
    spread = V.vector_summary(assigned, ["cluster"], "vec", "variance")
    total = spread.agg(F.sum(F.aggregate("variance", F.lit(0.0), lambda a, x: a + x) * (F.col("count") - 1))).scalar()
    near = F.abs(total - F.lit(float(cost))) <= 0.01 * F.lit(float(cost))
    return sizes.agg(F.sum("size").alias("points"), F.count(F.lit(1)).alias("clusters")).withColumn("inertia_is_sum_of_squares", near)


@query("pca_identities", "G12", """
SELECT CAST(unnest(range(0, 10)) AS INTEGER) AS component, true AS variance_is_explained, true AS not_above_the_one_before""")
def q_pca_identities(spark, sf):
    vectors = X.word_vectors(spark, sf)
    proj, ratios = V.pca(vectors, 10)
    whole = V.vector_summary(vectors, [], "vec", "variance").select(F.aggregate("variance", F.lit(0.0), lambda a, x: a + x)).scalar()
    own = V.vector_summary(proj, [], "projection", "variance").select(F.posexplode("variance").alias("component", "v"))
    ratio = F.element_at(F.array(*[F.lit(r) for r in ratios]), F.col("component") + 1)
    before = F.element_at(F.array(*[F.lit(r) for r in [1.0, *ratios]]), F.col("component") + 1)
    return own.select("component", (F.abs(F.col("v") / whole - ratio) < 1e-9).alias("variance_is_explained"), (ratio <= before).alias("not_above_the_one_before"))


# ---------------------------------------------------------------- H

TV_CTE = """comp AS (SELECT id, pos, mask, unnest(vec) AS val, unnest(range(0, len(vec))) AS dim FROM token_vectors)"""
_POOL_AGG = {"cls": "arg_min(val, pos)", "mean": "avg(val)", "max": "max(val)",
             "masked": "sum(mask * val) / greatest(CAST(sum(mask) AS DOUBLE), 1e-9)"}

for _how in ("cls", "mean", "max", "masked"):
    def _mkp(how=_how):
        def fn(spark, sf):
            p = V.pool_tokens(X.token_vectors(spark, sf), how)
            return p.select("id", _round_arr(F.col("pooled"), 9).alias("pooled"))
        return fn
    query(f"pool_tokens_{_how}", "H1", f"""WITH {TV_CTE},
per AS (SELECT id, dim, {_POOL_AGG[_how]} AS v FROM comp GROUP BY id, dim)
SELECT id, {_round_arr_sql('list(v ORDER BY dim)', 9)} AS pooled FROM per GROUP BY id""", ("token_vectors",))(_mkp())


@query("compare_pooling", "H2", f"""WITH {TV_CTE},
pooled AS (SELECT id, """ + ", ".join(f"list(v_{h} ORDER BY dim) AS {h}" for h in _POOL_AGG) + """ FROM (
  SELECT id, dim, """ + ", ".join(f"{a} AS v_{h}" for h, a in _POOL_AGG.items()) + """ FROM comp GROUP BY id, dim) GROUP BY id),
pairs AS (""" + " UNION ALL ".join(
    f"SELECT '{a}_vs_{b}' AS pair, list_dot_product({a}, {b}) / (sqrt(list_dot_product({a}, {a})) * sqrt(list_dot_product({b}, {b}))) AS cos FROM pooled"
    for i, a in enumerate(_POOL_AGG) for b in list(_POOL_AGG)[i + 1:]) + f""")
SELECT pair, {rnd_sql('avg(cos)', 6)} AS mean, {rnd_sql('stddev_pop(cos)', 6)} AS std, {rnd_sql('min(cos)', 6)} AS min,
  {rnd_sql('max(cos)', 6)} AS max FROM pairs GROUP BY pair""", ("token_vectors",))
def q_compare_pooling(spark, sf):
    c = V.compare_pooling(X.token_vectors(spark, sf))
    return c.select("pair", *[rnd(F.col(k), 6).alias(k) for k in ("mean", "std", "min", "max")])


@query("embedding_stats", "H3", f"""WITH e AS (SELECT CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
c AS (SELECT unnest(vec) AS val FROM e), n AS (SELECT sqrt(list_dot_product(vec, vec)) AS n FROM e)
SELECT {rnd_sql('(SELECT avg(val) FROM c)', 9)} AS mean, {rnd_sql('(SELECT stddev_pop(val) FROM c)', 9)} AS std,
  (SELECT min(val) FROM c) AS min, (SELECT max(val) FROM c) AS max,
  {rnd_sql('avg(n)', 9)} AS norm_mean, {rnd_sql('stddev_pop(n)', 9)} AS norm_std FROM n""")
def q_embedding_stats(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    s = V.embedding_stats(e)
    return s.select(*[rnd(F.col(k), 9).alias(k) for k in ("mean", "std")], "min", "max",
                    *[rnd(F.col(k), 9).alias(k) for k in ("norm_mean", "norm_std")])


@query("dim_stats", "H4", f"""WITH c AS (SELECT unnest(CAST(embedding AS DOUBLE[])) AS val,
  unnest(range(0, len(embedding))) AS dim FROM embeddings)
SELECT CAST(dim AS INTEGER) AS dim, {rnd_sql('avg(val)', 9)} AS mean, {rnd_sql('stddev_pop(val)', 9)} AS std FROM c GROUP BY dim""")
def q_dim_stats(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    d = V.dim_stats(e)
    return d.select(F.col("dim").cast("int").alias("dim"), rnd(F.col("mean"), 9).alias("mean"),
                    rnd(F.col("std"), 9).alias("std"))


@query("norm_histogram", "H4", """WITH n AS (SELECT sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS x
  FROM embeddings), mm AS (SELECT min(x) AS lo, max(x) AS hi FROM n),
b AS (SELECT lo, hi, CAST(CASE WHEN hi = lo THEN 0 ELSE least(49, floor((x - lo) * 50 / (hi - lo))) END AS INTEGER) AS bin FROM n, mm)
SELECT bin, count(*) AS n FROM b GROUP BY bin""")
def q_norm_histogram(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    return V.norm_histogram(e, 50)


@query("dim_correlation", "H5", f"""WITH c AS (SELECT vec_id, unnest(CAST(embedding[1:50] AS DOUBLE[])) AS val,
  unnest(range(0, 50)) AS dim FROM embeddings)
SELECT CAST(a.dim AS INTEGER) AS dim_a, CAST(b.dim AS INTEGER) AS dim_b, {rnd_sql('corr(a.val, b.val)', 6)} AS corr
FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.dim < b.dim GROUP BY a.dim, b.dim""")
def q_dim_correlation(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    c = V.dim_correlation(e, 50)
    return c.select("dim_a", "dim_b", rnd(F.col("corr"), 6).alias("corr"))


@query("pair_similarity_stats", "H7", f"""WITH {WV_CTE},
p AS (SELECT list_dot_product(a.u, b.u) AS c FROM wu a JOIN wu b ON a.word <> b.word)
SELECT count(*) AS n_pairs, {rnd_sql('avg(c)', 6)} AS mean, {rnd_sql('stddev_pop(c)', 6)} AS std,
  {rnd_sql('min(c)', 6)} AS min, {rnd_sql('max(c)', 6)} AS max FROM p""", ("word_vectors",))
def q_pair_similarity_stats(spark, sf):
    s = V.pair_similarity_stats(X.word_vectors(spark, sf))
    return s.select("n_pairs", *[rnd(F.col(k), 6).alias(k) for k in ("mean", "std", "min", "max")])


@query("label_centroids", "H8", f"""WITH c AS (SELECT grp, unnest(vec) AS val, unnest(range(0, len(vec))) AS dim FROM word_vectors),
cen AS (SELECT grp, list(v ORDER BY dim) AS centroid FROM (SELECT grp, dim, avg(val) AS v FROM c GROUP BY ALL) GROUP BY grp),
st AS (SELECT grp, count(*) AS count, avg(sqrt(list_dot_product(vec, vec))) AS norm_mean,
         stddev_pop(sqrt(list_dot_product(vec, vec))) AS norm_std FROM word_vectors GROUP BY grp)
SELECT st.grp, count, {rnd_sql('norm_mean', 9)} AS norm_mean, {rnd_sql('norm_std', 9)} AS norm_std,
  {_round_arr_sql('centroid', 9)} AS centroid FROM st JOIN cen USING (grp)""", ("word_vectors",))
def q_label_centroids(spark, sf):
    c = V.label_centroids(X.word_vectors(spark, sf))
    return c.select("grp", "count", rnd(F.col("norm_mean"), 9).alias("norm_mean"),
                    rnd(F.col("norm_std"), 9).alias("norm_std"), _round_arr(F.col("centroid"), 9).alias("centroid"))


@query("norm_histogram_by_label", "H8", """WITH n AS (SELECT grp, sqrt(list_dot_product(vec, vec)) AS x FROM word_vectors),
mm AS (SELECT grp, min(x) AS lo, max(x) AS hi FROM n GROUP BY grp),
b AS (SELECT grp, CAST(CASE WHEN hi = lo THEN 0 ELSE least(29, floor((x - lo) * 30 / (hi - lo))) END AS INTEGER) AS bin FROM n JOIN mm USING (grp))
SELECT grp, bin, count(*) AS n FROM b GROUP BY grp, bin""", ("word_vectors",))
def q_norm_histogram_by_label(spark, sf):
    return V.norm_histogram(X.word_vectors(spark, sf), 30, "grp")


@query("centroid_distances", "H8", f"""WITH c AS (SELECT grp, unnest(vec) AS val, unnest(range(0, len(vec))) AS dim FROM word_vectors),
cen AS (SELECT grp, list(v ORDER BY dim) AS centroid FROM (SELECT grp, dim, avg(val) AS v FROM c GROUP BY ALL) GROUP BY grp)
SELECT a.grp AS l1, b.grp AS l2, {rnd_sql('list_distance(a.centroid, b.centroid)', 6)} AS distance
FROM cen a JOIN cen b ON a.grp < b.grp""", ("word_vectors",))
def q_centroid_distances(spark, sf):
    d = V.centroid_distances(V.label_centroids(X.word_vectors(spark, sf)))
    return d.select("l1", "l2", rnd(F.col("distance"), 6).alias("distance"))


@query("effective_dims", "H6")
def q_effective_dims(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    dim = e.select(F.max(F.size("vec"))).first()[0]
    _, ratios = V.pca(e, dim)
    cum, k95 = 0.0, None
    for i, r in enumerate(ratios):
        cum += r
        if k95 is None and cum >= 0.95:
            k95 = i + 1
    rows = [(i, r, k95) for i, r in enumerate(ratios[:10])]
    return spark.createDataFrame(rows, "component int, variance_ratio double, dims_for_95 int")


@query("effective_dims_identities", "H6", """
SELECT CAST(max(len(embedding)) AS INTEGER) AS components, 1.0::DOUBLE AS ratio_sum, true AS falling, true AS reaches_95 FROM embeddings""")
def q_effective_dims_identities(spark, sf):
    e = X.table(spark, sf, "embeddings").select(F.col("embedding").cast("array<double>").alias("vec"))
    _, ratios = V.pca(e, e.select(F.max(F.size("vec"))).first()[0])
    falling = all(a >= b for a, b in zip(ratios, ratios[1:], strict=False))
    row = (len(ratios), round(sum(ratios), 9), falling, any(sum(ratios[:k + 1]) >= 0.95 for k in range(len(ratios))))
    return spark.createDataFrame([row], "components int, ratio_sum double, falling boolean, reaches_95 boolean")
