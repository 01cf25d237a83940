"""Registered queries: scans, sources and sinks (A*).

File-format queries write data derived from the given tables to the shared
scratch folder and read it back through the operator under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from nazar.functions import lexicons as LX
from nazar.functions.mathx import rnd, rnd_sql
from nazar.plans import fixtures as X
from nazar.plans import sqltext as S
from nazar.plans.registry import query
from nazar.sources import files as FS
from nazar.sources import replies as R

SCRAPED_AT = "2024-01-31 00:00:00"


@query("read_reviews", "A1", f"""
SELECT id, app_name, md5(comment) AS h, rating FROM reviews WHERE comment IS NOT NULL AND length({S.py_strip('comment')}) > 0""",
       ("reviews",))
def q_read_reviews(spark, sf):
    path = FS.scratch_path(spark, "reviews_csv")
    FS.write_reviews_csv(X.reviews(spark, sf).select("id", "app_name", "comment", "rating"), path)
    r = FS.read_reviews(spark, path)
    return r.select("id", "app_name", F.md5("comment").alias("h"), "rating")


_BLANKED = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 11 = 0 THEN '  ' ELSE md5(comment) END"


@query("dropped_reviews", "A1", f"""
SELECT count(*) AS total, CAST(count(*) FILTER (WHERE {_BLANKED} IS NULL OR length(trim({_BLANKED})) = 0) AS BIGINT) AS dropped FROM reviews""", ("reviews",))
def q_dropped_reviews(spark, sf):
    path = FS.scratch_path(spark, "reviews_csv")
    FS.write_reviews_csv(X.reviews(spark, sf).select("id", "app_name", F.expr(_BLANKED).alias("comment"), "rating"), path)
    return FS.dropped_reviews(spark, path, multi_line=False)


@query("pick_text_column", "A2", """
SELECT id, md5(comment) AS h, sentiment_label FROM labelled_reviews WHERE comment IS NOT NULL AND length(comment) > 0""",
       ("labelled_reviews",))
def q_pick_text_column(spark, sf):
    out = FS.pick_text_column(X.labelled_reviews(spark, sf))
    return out.select("id", F.md5("text").alias("h"), "sentiment_label")


def reply_docs(spark, sf):
    return R.reply_documents(X.table(spark, sf, "conversations"))


@query("flatten_review_reply", "A3", f"""
SELECT conv_id * 1000 + turn AS id, 'ir.example.app' || CAST(conv_id % 11 AS VARCHAR) AS app_package,
  'app' || CAST(conv_id % 11 AS VARCHAR) AS app_name, role AS "user", md5(text) AS h,
  CAST(1 + (conv_id + turn) % 5 AS INTEGER) AS rating,
  CAST(CASE WHEN turn % 4 <> 0 THEN turn * 3 ELSE 0 END AS INTEGER) AS likes,
  CAST(CASE WHEN turn % 5 <> 0 THEN turn * 5 ELSE 0 END AS INTEGER) AS total_votes,
  translate(CAST(1380 + (conv_id + turn) % 25 AS VARCHAR) || '/' || lpad(CAST(1 + ((conv_id + turn) * 7) % 12 AS VARCHAR), 2, '0')
    || '/' || lpad(CAST(1 + ((conv_id + turn) * 13) % 29 AS VARCHAR), 2, '0'), '0123456789', '۰۱۲۳۴۵۶۷۸۹') AS date,
  100000 + conv_id AS version_code, coalesce(role = 'assistant' AND role <> 'system', false) AS from_developer,
  CASE WHEN turn % 3 <> 0 THEN turn % 2 = 1 ELSE false END AS is_edited, '{SCRAPED_AT}' AS scraped_at
FROM conversations""")
def q_flatten_review_reply(spark, sf):
    out = R.flatten_review_reply(reply_docs(spark, sf), scraped_at=F.lit(SCRAPED_AT))
    return out.select("id", "app_package", "app_name", "user", F.md5("comment").alias("h"), "rating", "likes",
                      "total_votes", "date", "version_code", "from_developer", "is_edited", "scraped_at")


@query("next_cursor", "A3b", """
WITH pg AS (SELECT conv_id, CAST(floor(turn / 10) AS BIGINT) AS page FROM conversations GROUP BY ALL),
lp AS (SELECT conv_id, max(page) AS last_page FROM pg GROUP BY conv_id)
SELECT pg.conv_id, pg.page, CASE WHEN page < last_page THEN 'conv' || CAST(pg.conv_id AS VARCHAR) || '|' || CAST(page + 1 AS VARCHAR) END
  AS cursor FROM pg JOIN lp USING (conv_id)""")
def q_next_cursor(spark, sf):
    d = reply_docs(spark, sf)
    return d.select("conv_id", "page", R.next_cursor(d).alias("cursor"))


@query("read_apps", "A4", """
SELECT DISTINCT 'ir.example.' || source AS package_name, source AS app_name FROM documents""")
def q_read_apps(spark, sf):
    src = X.table(spark, sf, "documents").select(F.col("source").alias("app_name")).distinct()
    apps = src.select(F.concat(F.lit("ir.example."), F.col("app_name")).alias("package_name"), "app_name")
    path = FS.scratch_path(spark, "apps_json")
    FS.write_apps_json(apps, path)
    return FS.read_apps(spark, path)


@query("read_app_lines", "A4", """
SELECT DISTINCT 'ir.example.' || source AS package_name, source AS app_name FROM documents""")
def q_read_app_lines(spark, sf):
    src = X.table(spark, sf, "documents").select(F.col("source").alias("app_name")).distinct()
    path = FS.scratch_path(spark, "apps_jsonl")
    src.select(F.concat(F.lit("ir.example."), F.col("app_name")).alias("package_name"), "app_name").write.mode("overwrite").json(path)
    return FS.read_apps(spark, path, lines=True)


# category → emoji → text, a category a language: the entries of two categories overlap
_EMOJI_JSON = """SELECT lang AS category, right(source, 1) || CASE WHEN ascii(right(source, 1)) % 2 = 0 THEN lang ELSE '' END AS emoji, max(source) AS text
FROM documents WHERE lang IS NOT NULL AND source <> '' GROUP BY 1, 2"""
_LANGS = ["de", "en", "es", "fr"]
_FLAT = f"""WITH m AS ({_EMOJI_JSON}), r AS (SELECT *, row_number() OVER (PARTITION BY emoji ORDER BY category DESC) AS k FROM m)
"""


def _emoji_flat(spark, sf):
    d = X.table(spark, sf, "documents").where("lang IS NOT NULL AND source <> ''")
    m = d.groupBy(F.col("lang").alias("category"), F.expr("concat(right(source, 1), if(ascii(right(source, 1)) % 2 = 0, lang, ''))").alias("emoji")).agg(F.max("source").alias("text"))
    per = m.groupBy("category").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("emoji", "text")))).alias("e"))
    path = FS.scratch_path(spark, "emoji_json")
    # one JSON document, as the original file: a row a language
    per.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("category", "e")))).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return FS.load_emoji_map(spark, path, _LANGS)


@query("load_emoji_map", "A5", _FLAT + "SELECT emoji, text, category FROM r WHERE k = 1")
def q_load_emoji_map(spark, sf):
    return _emoji_flat(spark, sf).select("emoji", "text", "category")


@query("emoji_counts", "A5", _FLAT + "SELECT category, count(*) AS n_emoji FROM r WHERE k = 1 GROUP BY category")
def q_emoji_counts(spark, sf):
    return FS.emoji_counts(_emoji_flat(spark, sf))


@query("load_stopwords", "A5", f"""
WITH w AS (SELECT word, count(*) AS n FROM (SELECT unnest({S.words('lower(text)')}) AS word FROM documents) GROUP BY word),
top AS (SELECT word FROM w ORDER BY n DESC, word LIMIT 50)
SELECT word FROM top UNION SELECT * FROM (VALUES {", ".join(f"({S.lit(w)})" for w in LX.CUSTOM_STOPWORDS)}) c(word)""")
def q_load_stopwords(spark, sf):
    from nazar.operators.profile import top_words
    d = X.table(spark, sf, "documents").select(F.col("text").alias("comment"))
    top = top_words(d, 50)
    path = FS.scratch_path(spark, "stopwords_txt")
    top.select(F.concat(F.lit("  "), F.col("word")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
    return FS.load_stopwords(spark, path, LX.CUSTOM_STOPWORDS)


def _versions_count_sql():
    from nazar.plans.q_text import versions_cte
    return f"WITH v AS ({versions_cte()}) SELECT version, count(*) AS n FROM v WHERE kept GROUP BY version"


@query("write_versions", "A6", _versions_count_sql(), ("reviews",))
def q_write_versions(spark, sf):
    from nazar.plans.q_text import versions_df
    path = FS.scratch_path(spark, "versions_parquet")
    FS.write_versions(versions_df(spark, sf).filter("kept").select("id", "version", "comment_processed"), path)
    back = spark.read.parquet(path)
    return back.groupBy("version").agg(F.count(F.lit(1)).alias("n"))


@query("write_report", "A7")
def q_write_report(spark, sf):
    from nazar.operators import profile as PR
    st = PR.length_stats(X.reviews(spark, sf))
    rows = st.select(F.inline(F.array(*[F.struct(F.lit("length").alias("section"), F.lit(c).alias("key"),
                                                 F.col(c).cast("double").alias("value")) for c in st.columns])))
    path = FS.scratch_path(spark, "report_json")
    FS.write_report(rows, path)
    return FS.read_report(spark, path)


@query("batch_requests", "A8", f"""
SELECT id, 'comment_' || CAST(id AS VARCHAR) AS custom_id,
  md5(replace({S.lit(R.USER_PROMPT_TEMPLATE)}, '{{comment}}', comment)) AS user_h, {R.MAX_TOKENS} AS max_tokens
FROM reviews WHERE comment IS NOT NULL AND length(comment) > 10""", ("reviews",))
def q_batch_requests(spark, sf):
    from nazar.operators.labels import label_candidates
    b = R.batch_requests(label_candidates(X.reviews(spark, sf)))
    return b.select("id", F.get_json_object("line", "$.custom_id").alias("custom_id"),
                    F.md5(F.get_json_object("line", "$.body.messages[1].content")).alias("user_h"),
                    F.get_json_object("line", "$.body.max_tokens").cast("int").alias("max_tokens"))


@query("read_batch_results", "A9", f"""
WITH l AS ({R.BATCH_RESULTS_SQL})
SELECT replace(json_extract_string(line, '$.custom_id'), 'comment_', '') AS id,
  CAST(json_extract(line, '$.response.status_code') AS INTEGER) AS status_code,
  CASE WHEN CAST(json_extract(line, '$.response.status_code') AS INTEGER) = 200
    THEN json_extract_string(line, '$.response.body.choices[0].message.content') END AS raw_label,
  CASE WHEN CAST(json_extract(line, '$.response.status_code') AS INTEGER) = 200
    THEN coalesce(CAST(json_extract(line, '$.response.body.usage.prompt_tokens') AS BIGINT), 0) END AS input_tokens,
  CASE WHEN CAST(json_extract(line, '$.response.status_code') AS INTEGER) = 200
    THEN coalesce(CAST(json_extract(line, '$.response.body.usage.completion_tokens') AS BIGINT), 0) END AS output_tokens,
  CASE WHEN CAST(json_extract(line, '$.response.status_code') AS INTEGER) = 200
    THEN coalesce(CAST(json_extract(line, '$.response.body.usage.total_tokens') AS BIGINT), 0) END AS total_tokens,
  CASE WHEN CAST(json_extract(line, '$.response.status_code') AS INTEGER) = 200 THEN NULL ELSE 'Batch API error' END AS error
FROM l""")
def q_read_batch_results(spark, sf):
    lines = R.batch_result_lines(X.table(spark, sf, "documents"), X.table(spark, sf, "labels"))
    return R.read_batch_results(lines)


@query("save_load_embeddings", "A10", f"""
SELECT label, count(*) AS n, {rnd_sql('sum(list_sum(CAST(embedding AS DOUBLE[])))', 6)} AS total FROM embeddings GROUP BY label""")
def q_save_load_embeddings(spark, sf):
    path = FS.scratch_path(spark, "embeddings_parquet")
    FS.save_embeddings(X.table(spark, sf, "embeddings"), path)
    e = FS.load_embeddings(spark, path)
    s = F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda a, x: a + x)
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum(s), 6).alias("total"))


@query("save_load_vocab", "A11", None)
def q_save_load_vocab(spark, sf):
    from nazar.plans.q_features import fitted
    _, vocab, _ = fitted(spark, sf)
    path = FS.scratch_path(spark, "vocab_parquet")
    FS.save_vocab(vocab, path)
    v = FS.load_vocab(spark, path)
    return v.select("term", "idx", "df", rnd(F.col("idf")).alias("idf"))


def _vocab_sql():
    from nazar.plans.q_features import with_tfidf
    return with_tfidf(f"SELECT term, idx, df, {rnd_sql('idf')} AS idf FROM vocab")


def register_late():
    """The A11 oracle reuses the TF-IDF SQL (imported lazily to avoid a cycle)."""
    from nazar.plans.fixtures import with_tables
    from nazar.plans.registry import REGISTRY, Query
    q = REGISTRY["save_load_vocab"]
    REGISTRY["save_load_vocab"] = Query(q.name, q.fn, with_tables(_vocab_sql(), "reviews"), q.op_id)


register_late()
