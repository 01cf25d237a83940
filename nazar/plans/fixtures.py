"""Logical tables of the review domain, derived from the driver's parquet tables.

Each logical table has two definitions that must agree row for row:
a Spark builder (used by the queries) and a DuckDB CTE (used by the oracle SQL).
All builders read parquet lazily, so Catalyst prunes columns and pushes
filters into the scan of whatever the query finally uses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Class codes of the three sentiment labels (code = alphabetical rank).
LABELS = ["negative", "neutral", "positive"]
LABEL_CODE = {"negative": 0, "neutral": 1, "positive": 2}

# Two app names with no reviews, so the collection log has failed apps.
EXTRA_APPS = ["app_without_reviews_a", "app_without_reviews_b"]

# Prediction fixtures: per model, (modulus on n_chars, multiplier/modulus on doc_id, ...)
# score_a = 1 + n_chars % m0, score_b = 1 + (doc_id*k1) % m1, score_c = 1 + (doc_id*k2) % m2,
# p_k = score_k^3 / sum(score^3).  Model order is the list order.
MODEL_SCORES = [
    ("logistic", 97, 31, 89, 17, 83),
    ("cnn", 89, 29, 83, 13, 79),
    ("lstm", 83, 37, 79, 19, 73),
]


# Category lexicon for the registered tagging queries: markers that occur in the
# fixture prose (the shipped banking categories are Persian and would match nothing).
FIXTURE_CATEGORIES = [
    ("english_markers", "the"), ("english_markers", "with"),
    ("french_markers", "des"), ("french_markers", "elle"),
    ("german_markers", "und"), ("german_markers", "nicht"),
    ("spanish_markers", "los"), ("spanish_markers", "para"),
]


# Persian-script form of the fixture prose, letter by letter: Arabic letter forms (ي ك أ ة), a
# diacritic (for u) and Persian digits stand among the letters, so every rule has rows to change.
_LATIN = "abcdefghijklmnopqrstuvwxyz"
_PERSIAN = "ابچدیفگهيجكلمنوپقرستُأخژةز"
PERSIAN_FROM = _LATIN + _LATIN.upper() + "0123456789"
PERSIAN_TO = _PERSIAN * 2 + "۰۱۲۳۴۵۶۷۸۹"
# Words and signs of the prose that become emoji: mapped ones, and one that is only removed.
PERSIAN_EMOJI = [("the ", "👍 "), ("ing ", "😂😂 "), ("les ", "🚀"), (".\n", "😡\n")]
PERSIAN_SUFFIXES = ["ها", "ان", "ی", "ت"]


def to_persian(word: str) -> str:
    return word.translate(str.maketrans(PERSIAN_FROM, PERSIAN_TO))


# Lemmas of normalised Persian-script words.
PERSIAN_LEMMAS = [("اند", "و"), ("وف", "از"), ("دیر", "دی"), ("ند", "نا"), ("لا", "ل"), ("دی", "د")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- Spark side

def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    from nazar.session import spread
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text", "lang"))
    return d.select(
        d.doc_id.alias("id"),
        d.source.alias("app_name"),
        d.text.alias("comment"),
        d.lang,
        (F.lit(1) + (d.doc_id % 5)).cast("int").alias("rating"),
    )


def persian(text):
    for word, emoji in PERSIAN_EMOJI:
        text = F.replace(text, F.lit(word), F.lit(emoji))
    return F.translate(text, PERSIAN_FROM, PERSIAN_TO)


def persian_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reviews(spark, sf_dir).withColumn("comment", persian(F.col("comment")))


def label_expr(quality, toxic):
    return (F.when(toxic == 1, F.lit("negative"))
            .when(quality == 1, F.lit("positive"))
            .otherwise(F.lit("neutral")))


def review_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    lb = table(spark, sf_dir, "labels")
    return lb.select(lb.doc_id.alias("id"), label_expr(lb.quality, lb.toxic).alias("sentiment_label"))


def labelled_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    # labels is a key subset of documents; a plain inner join on id lets AQE
    # choose broadcast (labels is small) or sort-merge at scale.
    return reviews(spark, sf_dir).join(review_labels(spark, sf_dir), "id")


def apps(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = table(spark, sf_dir, "documents").select(F.col("source").alias("app_name")).distinct()
    extra = spark.createDataFrame([(a,) for a in EXTRA_APPS], "app_name string")
    return src.unionByName(extra)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.to_date(e.ts).alias("day"), e.event_type.alias("label"))


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.concat(F.lit("w"), e.vec_id.cast("string")).alias("word"),
                    e.embedding.cast("array<double>").alias("vec"),
                    e.label.alias("grp"))


def token_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pos, mask, vec): a label plays a document, vec_id order its positions."""
    e = table(spark, sf_dir, "embeddings")
    pos = (F.row_number().over(W.partitionBy("label").orderBy("vec_id")) - 1).cast("int")
    return (e.select(e.label.cast("bigint").alias("id"), pos.alias("pos"),
                     e.embedding.cast("array<double>").alias("vec"))
            .withColumn("mask", (F.col("pos") <= 30).cast("int"))
            .select("id", "pos", "mask", "vec"))


def _cube(c):
    return c * c * c


def predictions(spark: SparkSession, sf_dir: str, models: list[str] | None = None) -> DataFrame:
    """(id, model, y_true, y_pred, proba, text) for every labelled document and model."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "text")
    lab = table(spark, sf_dir, "labels")
    base = docs.join(lab, "doc_id")
    y_true = (F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 1, 2).otherwise(1)).cast("int")
    parts = []
    for name, m0, k1, m1, k2, m2 in MODEL_SCORES:
        if models is not None and name not in models:
            continue
        a = _cube((F.lit(1) + F.col("n_chars") % m0).cast("double"))
        b = _cube((F.lit(1) + (F.col("doc_id") * k1) % m1).cast("double"))
        c = _cube((F.lit(1) + (F.col("doc_id") * k2) % m2).cast("double"))
        tot = a + b + c
        proba = F.array(a / tot, b / tot, c / tot)
        y_pred = (F.when((a >= b) & (a >= c), 0).when(b >= c, 1).otherwise(2)).cast("int")
        parts.append(base.select(F.col("doc_id").alias("id"), F.lit(name).alias("model"),
                                 y_true.alias("y_true"), y_pred.alias("y_pred"),
                                 proba.alias("proba"), F.col("text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# ---------------------------------------------------------------- DuckDB side

def persian_sql(e: str) -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    for word, emoji in PERSIAN_EMOJI:
        e = f"replace({e}, {quoted(word)}, {quoted(emoji)})"
    return f"translate({e}, {quoted(PERSIAN_FROM)}, {quoted(PERSIAN_TO)})"


def _pred_sql(name, m0, k1, m1, k2, m2):
    def cube(e):
        return f"(CAST({e} AS DOUBLE) * CAST({e} AS DOUBLE) * CAST({e} AS DOUBLE))"
    a = cube(f"1 + d.n_chars % {m0}")
    b = cube(f"1 + (d.doc_id * {k1}) % {m1}")
    c = cube(f"1 + (d.doc_id * {k2}) % {m2}")
    return f"""SELECT d.doc_id AS id, '{name}' AS model,
  CAST(CASE WHEN l.toxic = 1 THEN 0 WHEN l.quality = 1 THEN 2 ELSE 1 END AS INTEGER) AS y_true,
  CAST(CASE WHEN {a} >= {b} AND {a} >= {c} THEN 0 WHEN {b} >= {c} THEN 1 ELSE 2 END AS INTEGER) AS y_pred,
  [{a} / ({a} + {b} + {c}), {b} / ({a} + {b} + {c}), {c} / ({a} + {b} + {c})] AS proba,
  d.text AS text
FROM documents d JOIN labels l ON d.doc_id = l.doc_id"""


CTE = {
    "reviews": "SELECT doc_id AS id, source AS app_name, text AS comment, lang, "
               "CAST(1 + doc_id % 5 AS INTEGER) AS rating FROM documents",
    "persian_reviews": f"SELECT id, app_name, {persian_sql('comment')} AS comment, lang, rating FROM reviews",
    "review_labels": "SELECT doc_id AS id, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 "
                     "THEN 'positive' ELSE 'neutral' END AS sentiment_label FROM labels",
    "labelled_reviews": "SELECT r.*, l.sentiment_label FROM reviews r JOIN review_labels l ON r.id = l.id",
    "apps": "SELECT DISTINCT source AS app_name FROM documents UNION ALL "
            + " UNION ALL ".join(f"SELECT '{a}'" for a in EXTRA_APPS),
    "daily": "SELECT CAST(ts AS DATE) AS day, event_type AS label FROM events",
    "word_vectors": "SELECT 'w' || CAST(vec_id AS VARCHAR) AS word, CAST(embedding AS DOUBLE[]) AS vec, "
                    "label AS grp FROM embeddings",
    "token_vectors": "SELECT id, pos, CAST(pos <= 30 AS INTEGER) AS mask, vec FROM ("
                     "SELECT CAST(label AS BIGINT) AS id, CAST(row_number() OVER (PARTITION BY label "
                     "ORDER BY vec_id) - 1 AS INTEGER) AS pos, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings)",
    "predictions": " UNION ALL ".join(_pred_sql(*m) for m in MODEL_SCORES),
}

# CTEs a logical table needs before it (dependency order).
_DEPS = {"labelled_reviews": ["reviews", "review_labels"], "persian_reviews": ["reviews"]}


def with_tables(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs of the named logical tables (and their deps)."""
    order: list[str] = []
    for n in names:
        for d in _DEPS.get(n, []) + [n]:
            if d not in order:
                order.append(d)
    ctes = ",\n".join(f"{n} AS ({CTE[n]})" for n in order)
    sql = sql.strip()
    if sql.upper().startswith("WITH "):
        return f"WITH {ctes},\n{sql[5:]}"
    return f"WITH {ctes}\n{sql}"
