"""File sources and sinks.

Readers take explicit schemas (no inference pass); writers are plain
DataFrameWriter calls.  Scratch output goes under the shared checkpoint
folder named by ``spark.checkpoint.dir`` (never a machine-local path).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nazar.functions import text as TX
from nazar.session import ensure_checkpoint_dir

REVIEW_CSV_SCHEMA = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("app_name", T.StringType()),
    T.StructField("comment", T.StringType()), T.StructField("rating", T.IntegerType()),
])

TEXT_CANDIDATES = ["comment_cleaned", "comment_processed", "comment", "text"]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/nazar-io/{name}-{uuid.uuid4().hex[:12]}"


def _review_rows(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').csv(path)


def _has_comment():
    return F.coalesce(F.length(TX.py_strip(F.col("comment"))) > 0, F.lit(False))


def read_reviews(spark: SparkSession, path: str, schema: T.StructType = REVIEW_CSV_SCHEMA, multi_line: bool = True) -> DataFrame:
    """A1: CSV with header; ``comment`` required; rows with a null or blank comment dropped
    (count them with ``dropped_reviews``).  Quoted fields may hold line breaks; a file is then
    read by one task.  Without such fields (``multi_line=False``) large files are split."""
    df = _review_rows(spark, path, schema, multi_line)
    if "comment" not in df.columns:
        raise ValueError("input must contain a 'comment' column")
    return df.filter(_has_comment())


def dropped_reviews(spark: SparkSession, path: str, schema: T.StructType = REVIEW_CSV_SCHEMA, multi_line: bool = True) -> DataFrame:
    """A1: rows read and rows dropped."""
    return _review_rows(spark, path, schema, multi_line).agg(F.count(F.lit(1)).alias("total"), F.count_if(~_has_comment()).alias("dropped"))


def write_reviews_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def pick_text_column(df: DataFrame, candidates: list[str] = TEXT_CANDIDATES, label_col: str | None = "sentiment_label"):
    """A2: the first existing candidate column as ``text``; null/empty texts and
    null labels dropped."""
    col = next((c for c in candidates if c in df.columns), None)
    if col is None:
        raise ValueError(f"none of {candidates} present")
    out = df.withColumn("text", F.col(col)).filter(F.col("text").isNotNull() & (F.length("text") > 0))
    if label_col and label_col in df.columns:
        out = out.filter(F.col(label_col).isNotNull())
    return out


APPS_SCHEMA = T.StructType([T.StructField("package_name", T.StringType()), T.StructField("app_name", T.StringType())])


def read_apps(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """A4: app dimension from a JSON array of {package_name, app_name} (a file is one task's),
    or with ``lines`` from an object a line, which splits."""
    return spark.read.schema(APPS_SCHEMA).option("multiLine", not lines).json(path)


def write_apps_json(apps: DataFrame, path: str) -> None:
    """One JSON array document (the app dimension is small: one partition)."""
    arr = apps.agg(F.to_json(F.collect_list(F.struct("package_name", "app_name"))).alias("value"))
    arr.coalesce(1).write.mode("overwrite").text(path)


def load_stopwords(spark: SparkSession, path: str | None, custom: list[str]) -> DataFrame:
    """A5: stopword file lines (stripped, non-empty) ∪ custom list, distinct."""
    parts = []
    if path:
        lines = spark.read.text(path).select(TX.py_strip(F.col("value")).alias("word"))
        parts.append(lines.filter(F.length("word") > 0))
    parts.append(spark.createDataFrame([(w,) for w in custom], "word string"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


EMOJI_MAP_TYPE = "map<string,map<string,string>>"


def load_emoji_map(spark: SparkSession, path: str, category_order: list[str]) -> DataFrame:
    """A5: category → emoji → text JSON flattened to (pos, emoji, text, category);
    a later category wins on a duplicate emoji; ``pos`` keeps first-seen order."""
    raw = spark.read.text(path, wholetext=True)
    m = raw.select(F.from_json("value", EMOJI_MAP_TYPE).alias("m"))
    order = F.create_map(*[x for i, c in enumerate(category_order) for x in (F.lit(c), F.lit(i))])
    cats = m.select(F.explode("m").alias("category", "emap"))
    rows = cats.select("category", F.element_at(order, F.col("category")).alias("ci"),
                       F.posexplode(F.map_entries("emap")).alias("ei", "kv"))
    rows = rows.select("category", "ci", "ei", F.col("kv.key").alias("emoji"), F.col("kv.value").alias("text"))
    from pyspark.sql import Window as W
    last = W.partitionBy("emoji").orderBy(F.col("ci").desc())
    first = W.partitionBy("emoji").orderBy("ci", "ei")
    return (rows.withColumn("_win", F.row_number().over(last)).withColumn("_first", F.first(F.struct("ci", "ei")).over(first))
                .filter(F.col("_win") == 1)
                .select("emoji", "text", "category", F.col("_first.ci").alias("_c"), F.col("_first.ei").alias("_e"))
                .withColumn("pos", F.dense_rank().over(W.orderBy("_c", "_e")).cast("int")).drop("_c", "_e"))


def emoji_counts(flat: DataFrame) -> DataFrame:
    return flat.groupBy("category").agg(F.count(F.lit(1)).alias("n_emoji"))


def write_versions(stacked: DataFrame, path: str) -> None:
    """One partition folder per preprocessing version."""
    stacked.write.mode("overwrite").partitionBy("version").parquet(path)


def write_report(metrics: DataFrame, path: str) -> None:
    """Metric rows (section, key, value) as JSON lines."""
    metrics.select("section", "key", F.col("value").cast("string").alias("value")).write.mode("overwrite").json(path)


def read_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("section string, key string, value string").json(path)


def save_embeddings(df: DataFrame, path: str) -> None:
    """A10: ids, labels and float vectors as parquet."""
    df.write.mode("overwrite").parquet(path)


def load_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def save_vocab(vocab: DataFrame, path: str) -> None:
    """Fitted vocabulary + idf."""
    vocab.select("term", "idx", "df", "idf").write.mode("overwrite").parquet(path)


def load_vocab(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
