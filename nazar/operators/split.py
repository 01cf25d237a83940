"""Deterministic stratified splits, folds and class weights.

Order within a class is md5(seed:id) (same hex in every engine).  The rank
of a row inside its class comes from ``cumulative_below`` — bucketed prefix
counts — so a class holding a third of all rows is still ranked by many
parallel tasks, not one window task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nazar.operators.common import cumulative_below


def md5_key(id_col: str = "id", seed: int = 42):
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))


def rank_in_class(df: DataFrame, label_col: str, id_col: str = "id", seed: int = 42, buckets: int = 64) -> DataFrame:
    """Adds ``rank`` (1-based, md5 order) and ``class_size`` per label."""
    k = df.withColumn("_k", md5_key(id_col, seed)).withColumn("_one", F.lit(1))
    # first 15 hex digits as a number: monotone with the hex order, used to bucket
    k = k.withColumn("_kn", F.conv(F.substring("_k", 1, 15), 16, 10).cast("bigint"))
    r = cumulative_below(k, [label_col], "_k", ["_one"], buckets, tiebreak=[id_col], bucket_col="_kn")
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("class_size"))  # one row per class
    return (r.join(F.broadcast(sizes), label_col)
             .withColumn("rank", (F.col("_one_below") + 1).cast("bigint"))
             .drop("_k", "_kn", "_one", "_one_below"))


def stratified_split(df: DataFrame, label_col: str, test: float = 0.2, id_col: str = "id", seed: int = 42) -> DataFrame:
    """Per class the first ceil(test·m_c) rows (md5 order) are test."""
    r = rank_in_class(df, label_col, id_col, seed)
    cut = F.ceil(F.lit(test) * F.col("class_size"))
    return r.withColumn("split", F.when(F.col("rank") <= cut, "test").otherwise("train")).drop("rank", "class_size")


def three_way_split(df: DataFrame, label_col: str, test: float = 0.2, val: float = 0.1, id_col: str = "id",
                    seed: int = 42) -> DataFrame:
    """Test first, then val of the remainder with share val/(1−test)."""
    r = rank_in_class(df, label_col, id_col, seed)
    t = F.ceil(F.lit(test) * F.col("class_size"))
    v = F.ceil(F.lit(val / (1 - test)) * (F.col("class_size") - t))
    split = F.when(F.col("rank") <= t, "test").when(F.col("rank") <= t + v, "val").otherwise("train")
    return r.withColumn("split", split).drop("rank", "class_size")


def stratified_folds(df: DataFrame, label_col: str, k: int = 5, id_col: str = "id", seed: int = 42) -> DataFrame:
    """I8: fold = (rank − 1) mod k within each class (sizes differ by ≤ 1 per class)."""
    r = rank_in_class(df, label_col, id_col, seed)
    return r.withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).drop("rank", "class_size")


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """weight_c = n / (K · m_c)."""
    sizes = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("m"))
    n = df.agg(F.count(F.lit(1))).scalar()
    kc = sizes.agg(F.count(F.lit(1))).scalar()
    return sizes.select(label_col, "m", (n / (kc * F.col("m"))).alias("weight"))


def with_class_weights(df: DataFrame, label_col: str, weight_col: str = "weight") -> DataFrame:
    """Attach I9 weights to every row (broadcast: one row per class) for ``weightCol``."""
    w = class_weights(df, label_col).select(label_col, F.col("weight").alias(weight_col))
    return df.join(F.broadcast(w), label_col)


def expected_test_size(m: int, test: float) -> int:
    return math.ceil(test * m)
