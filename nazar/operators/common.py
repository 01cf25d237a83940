"""Small distributed building blocks shared by operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nazar.session import cut_lineage


def global_row_number(df: DataFrame, order_cols: list[str], out: str = "row_num") -> DataFrame:
    """1-based row number in ``order_cols`` order without a single-partition window.

    Range-partition on the key, number rows inside each partition with
    ``monotonically_increasing_id`` (partition id in the upper bits), and add
    the prefix sum of per-partition counts — the only single-task step works
    on one row per partition.  The ranged rows are written once (reliable
    checkpoint): counts and rows must come from the same partitions, and a
    range exchange planned twice samples its bounds twice.
    """
    ranged = cut_lineage(df.repartitionByRange(*order_cols).sortWithinPartitions(*order_cols)
                         .withColumn("_mid", F.monotonically_increasing_id()))
    pid = F.shiftright(F.col("_mid"), 33)
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    counts = ranged.groupBy(pid.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    offsets = counts.select("_pid", (F.sum("_n").over(W.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return (ranged.withColumn("_pid", pid).join(F.broadcast(offsets), "_pid")
            .withColumn(out, (F.col("_off") + local + 1).cast("bigint"))
            .drop("_pid", "_mid", "_off"))


def computed(df: DataFrame, out: str, c: Column) -> DataFrame:
    """Adds column ``out``, computed once a row: a filter on it stays above, where a plain column's
    expression would be copied into the filter and run again."""
    return df.select("*", F.inline_outer(F.array(F.struct(c.alias(out)))))


def scalar(df: DataFrame, expr: Column) -> Column:
    """A one-value aggregate of ``df`` as a scalar-subquery Column (evaluated once)."""
    return df.select(expr).scalar()


def n_rows(df: DataFrame) -> Column:
    return scalar(df, F.count(F.lit(1)))


def class_grid(spark, classes: list[int], a: str = "y_true", b: str = "y_pred") -> DataFrame:
    """All (a, b) class pairs as a literal table (K² rows, no join)."""
    pairs = [F.struct(F.lit(i).cast("int").alias(a), F.lit(j).cast("int").alias(b)) for i in classes for j in classes]
    return spark.range(1).select(F.inline(F.array(*pairs)))


def class_table(spark, classes: list[int], name: str = "cls") -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(c).cast("int") for c in classes])).alias(name))


def cumulative_below(groups: DataFrame, part_cols: list[str], order_col: str, sum_cols: list[str],
                     buckets: int = 64, tiebreak: list[str] | None = None, bucket_col: str | None = None) -> DataFrame:
    """Exclusive running sums of ``sum_cols`` in ascending ``order_col`` within each
    ``part_cols`` group (columns ``<c>_below``), without a one-task window.

    ``groups`` holds one row per (part, order value).  Approximate quantiles
    of the order value cut each part into ``buckets`` ranges; bucket totals
    (parts × buckets rows) give offsets, and the running sum inside a bucket
    is a window partitioned by (part, bucket) — many parallel tasks, each
    holding one range of distinct values.  The bucket of a value is a pure
    function of the value, so ties never straddle buckets and the result is
    exact.
    """
    probs = [i / buckets for i in range(1, buckets)]
    bcol = bucket_col or order_col  # numeric, monotone with the order
    bounds = groups.groupBy(*part_cols).agg(
        F.percentile_approx(bcol, probs, 10000).alias("_bounds"))
    # one row per part: bounded by the number of parts (classes, pairs)
    g = groups.join(F.broadcast(bounds), part_cols)
    g = g.withColumn("_b", F.size(F.filter("_bounds", lambda x: x < F.col(bcol)))).drop("_bounds")
    tot = g.groupBy(*part_cols, "_b").agg(*[F.sum(c).alias(f"_t_{c}") for c in sum_cols])
    w_off = W.partitionBy(*part_cols).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    off = tot.select(*part_cols, "_b", *[F.coalesce(F.sum(f"_t_{c}").over(w_off), F.lit(0)).alias(f"_o_{c}")
                                         for c in sum_cols])
    w_loc = W.partitionBy(*part_cols, "_b").orderBy(order_col, *(tiebreak or [])) \
             .rowsBetween(W.unboundedPreceding, -1)
    loc = g.select("*", *[F.coalesce(F.sum(c).over(w_loc), F.lit(0)).alias(f"_l_{c}") for c in sum_cols])
    out = loc.join(F.broadcast(off), part_cols + ["_b"])
    return out.select(*groups.columns, *[(F.col(f"_o_{c}") + F.col(f"_l_{c}")).alias(f"{c}_below") for c in sum_cols])
