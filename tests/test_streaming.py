"""Structured Streaming extension: file source → parse → clean → windowed counts."""

import datetime as dt

from pyspark.sql import functions as F

from nazar.session import ensure_checkpoint_dir
from nazar.sources import replies as R
from nazar.streaming import reviews_stream as RS

from .conftest import SF001


def test_stream_daily_counts(spark):
    base = ensure_checkpoint_dir(spark)
    import uuid
    src = f"{base}/stream-src-{uuid.uuid4().hex[:8]}"
    docs = R.reply_documents(spark.read.parquet(f"{SF001}/conversations.parquet"))
    docs = docs.withColumn("event_time", F.lit(dt.datetime(2024, 1, 2, 10, 0)).cast("timestamp"))
    docs.select("app_package", "app_name", "json", "event_time").write.mode("overwrite").json(src)
    s = RS.review_stream(spark, src)
    labelled = RS.deduplicated(s).withColumn("sentiment_label", F.col("user"))
    agg = RS.daily_label_counts(labelled)
    name = f"daily_{uuid.uuid4().hex[:8]}"
    q = (agg.writeStream.outputMode("update").format("memory").queryName(name)
         .option("checkpointLocation", f"{base}/stream-ckpt-{uuid.uuid4().hex[:8]}").start())
    q.processAllAvailable()
    q.stop()
    got = {r["sentiment_label"]: r["n"] for r in spark.sql(f"SELECT * FROM {name}").collect()}
    exp = {r["role"]: r["n"] for r in spark.read.parquet(f"{SF001}/conversations.parquet")
           .groupBy("role").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == exp
