"""Spark session construction and a few cluster-safety helpers.

Everything here is configuration: the engine itself is plain Spark SQL.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows above which a "small" side is no longer broadcast.  Lexicons, vocabularies
# (capped by max_features), class tables and label maps are far below it.
BROADCAST_ROW_LIMIT = 2_000_000


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "nazar") -> SparkSession:
    """Session with AQE (coalescing + skew-join splitting) and the UI off.

    On a cluster ``master`` stays None so spark-submit decides; the shuffle
    partition count is then left to the cluster config and AQE coalesces it.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", os.environ.get("NAZAR_DRIVER_MEMORY", "16g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    A cluster sets it to a shared file system; only when it is unset (local
    runs and tests) do we fall back to a fresh scratch folder.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        d = tempfile.mkdtemp(prefix="nazar-ckpt-", dir=os.environ.get("NAZAR_SCRATCH", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared checkpoint folder (survives executor loss)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def saved(df: DataFrame) -> DataFrame:
    """``df`` written as a table in the shared checkpoint folder and read back: compressed, by column,
    for wide rows that several readers take (``cut_lineage`` writes whole rows, as they lie in memory)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/nazar-saved/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT,
                       known_bound: int | None = None) -> DataFrame:
    """Broadcast hint only for a side whose size is bounded by construction.

    ``known_bound`` is a structural bound on the rows (``max_features`` of a
    vocabulary, number of classes, sample size × vocabulary).  Without one the
    join is left unhinted: AQE measures the materialised side at runtime and
    turns the sort-merge join into a broadcast join only when it is below
    ``spark.sql.adaptive.autoBroadcastJoinThreshold`` — a size check that costs
    no extra job and never broadcasts a side that grew with the data.
    """
    if known_bound is not None and known_bound <= limit:
        return F.broadcast(df)
    return df


def broadcast_lexicon(df: DataFrame, limit: int = BROADCAST_ROW_LIMIT) -> DataFrame:
    """Broadcast a small user table (lexicon, category list, per-label table)
    after checking its row count; above the limit the join is left to a shuffle.
    Counting is cheap here: these tables are inputs or one row per label, not
    a pipeline over the data."""
    n = df.limit(limit + 1).count()
    return F.broadcast(df) if n <= limit else df


def spread(df: DataFrame) -> DataFrame:
    """Round-robin a scan that yields fewer partitions than the cluster has cores.

    Small inputs (a few row groups) otherwise run CPU-heavy text work in one
    task; on large inputs the scan already has thousands of splits and this is
    a no-op, so no shuffle is added at scale.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < par:
        return df.repartition(par)
    return df
