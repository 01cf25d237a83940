"""Profiling of text tables.

All are single aggregations (partial + final) or aggregations of an
exploded word stream; top-k uses ordered limits, histograms a broadcast
one-row min/max.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nazar.functions import patterns as P
from nazar.functions import text as T
from nazar.functions.mathx import rnd
from nazar.operators.labels import equal_width_bins


def length_stats(df: DataFrame, text_col: str = "comment") -> DataFrame:
    """Mean / median / min / max / sample std of character length."""
    n = F.length(text_col)
    return df.agg(F.avg(n).alias("mean"), F.median(n).cast("double").alias("median"), F.min(n).alias("min"),
                  F.max(n).alias("max"), rnd(F.stddev_samp(n), 6).alias("std"))


def duplicates(df: DataFrame, text_col: str = "comment") -> DataFrame:
    """Unique and duplicate counts (distinct over non-null texts)."""
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_distinct(F.sha2(F.col(text_col), 256)).alias("unique_comments")) \
             .withColumn("duplicate_comments", F.col("total") - F.col("unique_comments"))


def count_by_app(df: DataFrame, app_col: str = "app_name") -> DataFrame:
    """D3: reviews per app."""
    return df.groupBy(app_col).agg(F.count(F.lit(1)).alias("n"))


def n_apps(df: DataFrame, app_col: str = "app_name") -> DataFrame:
    return df.agg(F.count_distinct(app_col).alias("apps_count"))


def rating_distribution(df: DataFrame, rating_col: str = "rating") -> DataFrame:
    """Count per rating."""
    return df.groupBy(rating_col).agg(F.count(F.lit(1)).alias("n"))


def mean_rating(df: DataFrame, rating_col: str = "rating") -> DataFrame:
    return df.agg(F.avg(rating_col).alias("average_rating"))


def script_ratio(df: DataFrame, text_col: str = "comment", char_class: str = P.PERSIAN_CHAR) -> DataFrame:
    """Share of rows containing a character of ``char_class`` (null counts as no)."""
    hit = F.coalesce(F.col(text_col).rlike(char_class), F.lit(False)).cast("int")
    return df.agg(F.avg(hit).alias("ratio"))


def version_stats(stacked: DataFrame, text_col: str = "comment_processed") -> DataFrame:
    """Per version count, length mean/median/min/max/std, mean words, unique, duplicate rate."""
    n = F.length(text_col)
    words = F.size(T.split_ws(F.col(text_col)))
    agg = stacked.groupBy("version").agg(
        F.count(F.lit(1)).alias("total_comments"), F.avg(n).alias("avg_length"),
        F.median(n).cast("double").alias("median_length"), F.min(n).alias("min_length"), F.max(n).alias("max_length"),
        rnd(F.stddev_samp(n), 6).alias("std_length"), F.avg(words).alias("avg_words"),
        F.count_distinct(F.sha2(F.col(text_col), 256)).alias("unique_comments"))
    return agg.withColumn("duplicate_rate", 1 - F.col("unique_comments") / F.col("total_comments"))


def length_histogram(df: DataFrame, text_col: str = "comment", bins: int = 50, group_cols=None) -> DataFrame:
    """Equal-width histogram of character lengths."""
    return equal_width_bins(df, F.length(text_col), bins, group_cols)


def word_histogram(df: DataFrame, text_col: str = "comment", bins: int = 30, group_cols=None) -> DataFrame:
    """Equal-width histogram of whitespace word counts."""
    return equal_width_bins(df, F.size(T.split_ws(F.col(text_col))), bins, group_cols)


def top_words(df: DataFrame, n: int = 20, text_col: str = "comment") -> DataFrame:
    """N most frequent lower-cased words (ties: word asc); partial
    aggregation on the exploded stream, then an ordered limit."""
    w = df.select(F.explode_outer(T.words(F.lower(F.col(text_col)))).alias("word")).filter(F.col("word").isNotNull())
    c = w.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return c.orderBy(F.col("n").desc(), F.col("word")).limit(n)


def class_share_by_version(stacked: DataFrame, label_col: str = "sentiment_label",
                           text_col: str = "comment_processed") -> DataFrame:
    """Label share and mean processed length per (version, label).

    The per-version total comes from a second, tiny aggregate joined back —
    not a window over raw rows."""
    c = stacked.groupBy("version", label_col).agg(F.count(F.lit(1)).alias("n"),
                                                  F.avg(F.length(text_col)).alias("avg_length"))
    tot = c.groupBy("version").agg(F.sum("n").alias("_tot"))
    return c.join(F.broadcast(tot), "version").select(
        "version", label_col, "n", (F.col("n") / F.col("_tot")).alias("share"), "avg_length")


def corpus_summary(df: DataFrame, text_col: str = "comment", label_col: str | None = "sentiment_label",
                   labels: list[str] | None = None) -> DataFrame:
    """Mean whitespace tokens per document, unique documents, label counts."""
    aggs = [F.count(F.lit(1)).alias("n_docs"), F.avg(F.size(T.split_ws(F.col(text_col)))).alias("avg_document_length"),
            F.count_distinct(F.sha2(F.col(text_col), 256)).alias("unique_documents")]
    if label_col and labels:
        aggs += [F.count(F.when(F.col(label_col) == l, 1)).alias(f"n_{l}") for l in labels]
    return df.agg(*aggs)


def words_count(c: Column) -> Column:
    return F.size(T.split_ws(c))
