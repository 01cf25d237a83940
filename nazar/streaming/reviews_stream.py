"""Structured Streaming over review reply documents (extension; the batch
operators are pure column plans, so the same expressions run on streams).

  readStream(json lines) → A3 flatten → C14 clean → watermark + dropDuplicates(id)
  → 1-day tumbling window counts per label (E7 as a stream).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from nazar.functions import text as TX
from nazar.sources.replies import flatten_review_reply

REPLY_FILE_SCHEMA = T.StructType([
    T.StructField("app_package", T.StringType()), T.StructField("app_name", T.StringType()),
    T.StructField("json", T.StringType()), T.StructField("event_time", T.TimestampType()),
])


def review_stream(spark: SparkSession, path: str, level: str = "medium", max_files_per_trigger: int = 100) -> DataFrame:
    """Streaming reviews: one row per review of every reply document dropped into ``path``."""
    raw = (spark.readStream.schema(REPLY_FILE_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
           .json(path))
    flat = _flatten_with_time(raw)
    return flat.withColumn("comment_cleaned", TX.clean_text(F.col("comment"), level))


def _flatten_with_time(raw: DataFrame) -> DataFrame:
    # keep the document's event time as the review's scrape time (the watermark column)
    return flatten_review_reply(raw, time_col="event_time")


def deduplicated(reviews: DataFrame, delay: str = "1 day") -> DataFrame:
    """Drop re-scraped reviews: first occurrence of an id within the watermark."""
    return reviews.withWatermark("scraped_at", delay).dropDuplicatesWithinWatermark(["id"])


def daily_label_counts(labelled: DataFrame, label_col: str = "sentiment_label", delay: str | None = None) -> DataFrame:
    """1-day tumbling-window counts per label; late rows beyond the watermark are
    dropped.  The watermark is the upstream one (``deduplicated``) unless ``delay`` is given."""
    w = labelled.withWatermark("scraped_at", delay) if delay else labelled
    return w.groupBy(F.window("scraped_at", "1 day").alias("day"), F.col(label_col)).agg(F.count(F.lit(1)).alias("n"))
