"""Reading tables, cutting lineage in the shared folder, and bounded Arrow batches."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nazar.session import ensure_checkpoint_dir

#: Rows and bytes an Arrow batch may hold on its way to a Python worker.
BATCH_ROWS = 2_000
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def save(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder of ``spark.checkpoint.dir`` and read it
    back: a lost executor then re-reads files instead of running the plan again."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/nazar-llm/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes as well as rows: texts may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def hash_order(key: str, seed: int):
    """A fixed pseudo-random order of rows, the same on every run."""
    return F.xxhash64(F.lit(seed), F.col(key).cast("string"))


def spread_out(df: DataFrame) -> DataFrame:
    """Deal a scan with fewer splits than cores over all cores (a no-op on large inputs)."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
