"""JSON sources and sinks of the collection and labelling stages.

All parsing is ``from_json`` with an explicit schema (no inference pass over
the data) followed by ``explode``/struct access; all writing is
``to_json(struct(...))``.  Both are per-row, shuffle-free projections.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nazar.functions import dates as D

# ---------------------------------------------------------------- A3 / A3b

REVIEW_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("user", T.StringType()),
    T.StructField("comment", T.StringType()), T.StructField("likes", T.IntegerType()),
    T.StructField("total", T.IntegerType()), T.StructField("rate", T.IntegerType()),
    T.StructField("versionCode", T.LongType()), T.StructField("date", T.StringType()),
    T.StructField("reply", T.StringType()), T.StructField("fromDeveloper", T.BooleanType()),
    T.StructField("isEdited", T.BooleanType()),
])

REPLY_SCHEMA = T.StructType([
    T.StructField("properties", T.StructType([T.StructField("statusCode", T.IntegerType()),
                                              T.StructField("errorMessage", T.StringType())])),
    T.StructField("singleReply", T.StructType([T.StructField("reviewReply", T.StructType([
        T.StructField("reviews", T.ArrayType(REVIEW_SCHEMA)),
        T.StructField("nextPageCursor", T.StringType())]))])),
])


def flatten_review_reply(replies: DataFrame, json_col: str = "json", app_package_col: str = "app_package",
                         app_name_col: str = "app_name", scraped_at: Column | None = None,
                         time_col: str | None = None) -> DataFrame:
    """A3: one row per review of every reply document, 13 columns, defaults for
    missing keys (likes/total 0, flags false).  ``scraped_at`` is a literal
    timestamp, or the document's ``time_col``, or the current time."""
    keep = [F.col(time_col).alias("_t")] if time_col else []
    p = replies.select(F.col(app_package_col).alias("app_package"), F.col(app_name_col).alias("app_name"),
                       F.from_json(F.col(json_col), REPLY_SCHEMA).alias("r"), *keep)
    rv = (p.select("app_package", "app_name", *(["_t"] if time_col else []),
                   F.explode_outer("r.singleReply.reviewReply.reviews").alias("v"))
          .filter(F.col("v").isNotNull()))
    if time_col:
        scraped_at = F.col("_t")
    scraped_at = scraped_at if scraped_at is not None else F.current_timestamp()
    return rv.select(
        F.col("v.id").alias("id"), "app_package", "app_name", F.col("v.user").alias("user"),
        F.col("v.comment").alias("comment"), F.col("v.rate").alias("rating"),
        F.coalesce(F.col("v.likes"), F.lit(0)).alias("likes"),
        F.coalesce(F.col("v.total"), F.lit(0)).alias("total_votes"),
        F.col("v.date").alias("date"), F.col("v.versionCode").alias("version_code"),
        F.coalesce(F.col("v.fromDeveloper"), F.lit(False)).alias("from_developer"),
        F.coalesce(F.col("v.isEdited"), F.lit(False)).alias("is_edited"),
        scraped_at.alias("scraped_at"))


def next_cursor(replies: DataFrame, json_col: str = "json") -> Column:
    """The pagination cursor of a reply document (null when absent)."""
    return F.get_json_object(F.col(json_col), "$.singleReply.reviewReply.nextPageCursor")


PAGE_SIZE = 10


def reply_documents(conversations: DataFrame, n_apps: int = 11) -> DataFrame:
    """Reply documents derived from ``conversations`` (test input for A3).

    Turns are grouped into pages of ``PAGE_SIZE`` reviews — a bounded group per
    (conversation, page) — and serialised with ``to_json``.  Some keys are
    left null so the parser's defaults are exercised.
    """
    c = conversations
    page = F.floor(c.turn / PAGE_SIZE).cast("bigint")
    review = F.struct(
        (c.conv_id * 1000 + c.turn).alias("id"), c.role.alias("user"), c.text.alias("comment"),
        F.when(c.turn % 4 != 0, (c.turn * 3).cast("int")).alias("likes"),
        F.when(c.turn % 5 != 0, (c.turn * 5).cast("int")).alias("total"),
        (F.lit(1) + (c.conv_id + c.turn) % 5).cast("int").alias("rate"),
        (F.lit(100000) + c.conv_id).alias("versionCode"),
        D.jalali_fixture(c.conv_id + c.turn).alias("date"),
        F.lit(None).cast("string").alias("reply"),
        F.when(c.role != "system", c.role == "assistant").alias("fromDeveloper"),
        F.when(c.turn % 3 != 0, c.turn % 2 == 1).alias("isEdited"))
    pages = (c.withColumn("page", page).groupBy("conv_id", "page")
             .agg(F.sort_array(F.collect_list(F.struct(c.turn.alias("t"), review.alias("v")))).alias("items")))
    last = F.max("page").over(__import__("pyspark.sql", fromlist=["Window"]).Window.partitionBy("conv_id"))
    pages = pages.withColumn("last_page", last)
    cursor = F.when(F.col("page") < F.col("last_page"),
                    F.concat(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("|"),
                             (F.col("page") + 1).cast("string")))
    doc = F.struct(F.struct(F.lit(200).alias("statusCode"), F.lit("").alias("errorMessage")).alias("properties"),
                   F.struct(F.struct(F.transform("items", lambda x: x["v"]).alias("reviews"),
                                     cursor.alias("nextPageCursor")).alias("reviewReply")).alias("singleReply"))
    app = (F.col("conv_id") % n_apps).cast("string")
    return pages.select("conv_id", "page", F.concat(F.lit("ir.example.app"), app).alias("app_package"),
                        F.concat(F.lit("app"), app).alias("app_name"), F.to_json(doc).alias("json"))


# ---------------------------------------------------------------- A8 / A9

# Re-authored prompt texts (the originals are Persian; only their role matters).
SYSTEM_PROMPT = ("You label the sentiment of user reviews of banking apps. "
                 "Answer with exactly one word: positive, negative or neutral.")
USER_PROMPT_TEMPLATE = 'Sentiment of this review:\n\nReview: "{comment}"\n\nSentiment:'
MODEL = "sentiment-labeller"
MAX_TOKENS = 50
TEMPERATURE = 0.2


def batch_requests(df: DataFrame, id_col: str = "id", text_col: str = "comment",
                   system_prompt: str = SYSTEM_PROMPT, template: str = USER_PROMPT_TEMPLATE,
                   model: str = MODEL) -> DataFrame:
    """One JSON request line per review (custom id, prompt with the comment)."""
    user = F.replace(F.lit(template), F.lit("{comment}"), F.col(text_col))
    body = F.struct(F.lit(model).alias("model"),
                    F.array(F.struct(F.lit("system").alias("role"), F.lit(system_prompt).alias("content")),
                            F.struct(F.lit("user").alias("role"), user.alias("content"))).alias("messages"),
                    F.lit(MAX_TOKENS).alias("max_tokens"), F.lit(TEMPERATURE).alias("temperature"))
    req = F.struct(F.concat(F.lit("comment_"), F.col(id_col).cast("string")).alias("custom_id"),
                   F.lit("POST").alias("method"), F.lit("/v1/chat/completions").alias("url"), body.alias("body"))
    return df.select(F.col(id_col), F.to_json(req).alias("line"))


RESULT_SCHEMA = T.StructType([
    T.StructField("custom_id", T.StringType()),
    T.StructField("response", T.StructType([
        T.StructField("status_code", T.IntegerType()),
        T.StructField("body", T.StructType([
            T.StructField("choices", T.ArrayType(T.StructType([
                T.StructField("message", T.StructType([T.StructField("content", T.StringType())]))]))),
            T.StructField("usage", T.StructType([
                T.StructField("prompt_tokens", T.LongType()), T.StructField("completion_tokens", T.LongType()),
                T.StructField("total_tokens", T.LongType())]))]))])),
])


def read_batch_results(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """(id, raw_label, status_code, input/output/total tokens, error) per result line."""
    r = lines.select(F.from_json(F.col(line_col), RESULT_SCHEMA).alias("r"))
    ok = F.col("r.response.status_code") == 200
    return r.select(
        F.replace(F.col("r.custom_id"), F.lit("comment_"), F.lit("")).alias("id"),
        F.col("r.response.status_code").alias("status_code"),
        F.when(ok, F.col("r.response.body.choices")[0]["message"]["content"]).alias("raw_label"),
        F.when(ok, F.coalesce(F.col("r.response.body.usage.prompt_tokens"), F.lit(0))).alias("input_tokens"),
        F.when(ok, F.coalesce(F.col("r.response.body.usage.completion_tokens"), F.lit(0))).alias("output_tokens"),
        F.when(ok, F.coalesce(F.col("r.response.body.usage.total_tokens"), F.lit(0))).alias("total_tokens"),
        F.when(~F.coalesce(ok, F.lit(False)), F.lit("Batch API error")).alias("error"))


def batch_result_lines(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Result lines derived from labelled documents (test input for A9/E5/E6/E8)."""
    d = documents.select("doc_id", "n_chars").join(labels, "doc_id")
    lab = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    k = F.col("doc_id") % 5
    content = (F.when(k == 0, F.concat(F.upper(lab), F.lit("\n")))
               .when(k == 1, F.concat(F.lit("  "), lab))
               .when(k == 2, F.concat(lab, F.lit(".")))
               .when(k == 3, F.concat(F.upper(F.substring(lab, 1, 1)), F.substring(lab, 2, 100)))
               .otherwise(lab))
    failed = F.col("doc_id") % 23 == 0
    pt = (F.lit(180) + F.ceil(F.col("n_chars") / 4.0)).cast("bigint")
    ct = (F.lit(1) + F.col("doc_id") % 3).cast("bigint")
    body = F.when(~failed, F.struct(
        F.array(F.struct(F.struct(content.alias("content")).alias("message"))).alias("choices"),
        F.struct(pt.alias("prompt_tokens"), ct.alias("completion_tokens"), (pt + ct).alias("total_tokens")).alias("usage")))
    resp = F.struct(F.when(failed, 500).otherwise(200).alias("status_code"), body.alias("body"))
    line = F.to_json(F.struct(F.concat(F.lit("comment_"), F.col("doc_id").cast("string")).alias("custom_id"),
                              resp.alias("response")))
    return d.select(line.alias("line"))


BATCH_RESULTS_SQL = """
SELECT json_object('custom_id', 'comment_' || CAST(d.doc_id AS VARCHAR),
  'response', json_object('status_code', CASE WHEN d.doc_id % 23 = 0 THEN 500 ELSE 200 END,
    'body', CASE WHEN d.doc_id % 23 = 0 THEN NULL ELSE json_object(
      'choices', json_array(json_object('message', json_object('content',
          CASE d.doc_id % 5 WHEN 0 THEN upper(lab) || chr(10) WHEN 1 THEN '  ' || lab WHEN 2 THEN lab || '.'
               WHEN 3 THEN upper(substr(lab, 1, 1)) || substr(lab, 2, 100) ELSE lab END))),
      'usage', json_object('prompt_tokens', 180 + CAST(ceil(d.n_chars / 4.0) AS BIGINT),
                           'completion_tokens', 1 + d.doc_id % 3,
                           'total_tokens', 180 + CAST(ceil(d.n_chars / 4.0) AS BIGINT) + 1 + d.doc_id % 3)) END)) AS line
FROM documents d JOIN (SELECT doc_id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive'
                                           ELSE 'neutral' END AS lab FROM labels) l ON d.doc_id = l.doc_id"""
