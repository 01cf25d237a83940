"""Error analysis (L1–L19) over (id, y_true, y_pred, proba, text).

Each analysis is a flag or bucket column plus one grouped aggregation;
"first k" examples are ordered by id and taken with a per-group
row_number (≤ k rows kept per group) or an ordered limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nazar.functions import patterns as P
from nazar.functions import text as T

# Bucket edges of the error analyses, (lo, hi] each.
LENGTH_BINS = [0, 50, 100, 200, 400, None]
WORD_BINS = [0, 5, 10, 20, 50, None]
CONFIDENCE_BINS = [0.0, 0.5, 0.7, 0.8, 0.9, 1.0]
CALIBRATION_BINS = [i * 0.1 for i in range(11)]
# Emoji ranges of the error report (four blocks).
ERROR_EMOJI = r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}]"


def with_flags(preds: DataFrame) -> DataFrame:
    """Adds is_error, confidence (max probability) and argmax class."""
    conf = F.array_max("proba")
    return preds.withColumn("is_error", (F.col("y_true") != F.col("y_pred")).cast("int")) \
                .withColumn("confidence", conf) \
                .withColumn("argmax", (F.array_position("proba", conf) - 1).cast("int"))


def error_summary(preds: DataFrame) -> DataFrame:
    """L1."""
    e = F.col("y_true") != F.col("y_pred")
    return preds.agg(F.count(F.lit(1)).alias("total_samples"), F.count(F.when(e, 1)).alias("total_errors"),
                     F.avg(e.cast("double")).alias("error_rate"))


def confusion_pairs(preds: DataFrame) -> DataFrame:
    """L2: (y_true, y_pred, n) of the errors."""
    return preds.filter(F.col("y_true") != F.col("y_pred")).groupBy("y_true", "y_pred") \
                .agg(F.count(F.lit(1)).alias("n"))


def errors_per_class(preds: DataFrame, classes: list[int]) -> DataFrame:
    """L3: per true class total, errors, error rate, correct (absent class = zeros)."""
    from nazar.operators.common import class_table
    c = preds.groupBy(F.col("y_true").alias("cls")).agg(
        F.count(F.lit(1)).alias("total"), F.count(F.when(F.col("y_true") != F.col("y_pred"), 1)).alias("errors"))
    j = class_table(preds.sparkSession, classes).join(c, "cls", "left")
    tot, err = F.coalesce("total", F.lit(0)), F.coalesce("errors", F.lit(0))
    return j.select("cls", tot.alias("total"), err.alias("errors"),
                    F.when(tot > 0, err / tot).otherwise(0.0).alias("error_rate"), (tot - err).alias("correct"))


def first_k_per_group(df: DataFrame, group_cols: list[str], k: int, order_col: str = "id") -> DataFrame:
    w = W.partitionBy(*group_cols).orderBy(order_col)
    return df.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)


def error_examples(preds: DataFrame, k: int = 5) -> DataFrame:
    """L4: first k errors (by id) of every (true, pred) pair, with confidence."""
    e = with_flags(preds).filter(F.col("is_error") == 1)
    return first_k_per_group(e, ["y_true", "y_pred"], k).select("y_true", "y_pred", "rank", "id", "confidence",
                                                                "proba", "text")


def bucket(value: Column, edges: list) -> Column:
    """Index of the (lo, hi] bucket; None edge = +inf; values ≤ first edge → null."""
    expr = None
    for i in range(len(edges) - 1):
        lo, hi = edges[i], edges[i + 1]
        cond = value > lo if hi is None else (value > lo) & (value <= hi)
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def errors_by_bucket(preds: DataFrame, value: Column, edges: list) -> DataFrame:
    """Per (lo, hi] bucket total, errors, error rate, accuracy."""
    b = preds.select(bucket(value, edges).alias("bin"), (F.col("y_true") != F.col("y_pred")).cast("int").alias("e"))
    g = b.filter(F.col("bin").isNotNull()).groupBy("bin").agg(F.count(F.lit(1)).alias("total"),
                                                             F.sum("e").cast("bigint").alias("errors"))
    return g.select("bin", "total", "errors", (F.col("errors") / F.col("total")).alias("error_rate"),
                    ((F.col("total") - F.col("errors")) / F.col("total")).alias("accuracy"))


def errors_by_length(preds: DataFrame, text_col: str = "text") -> DataFrame:
    """Character-length buckets 0-50-100-200-400-∞."""
    return errors_by_bucket(preds, F.length(text_col), LENGTH_BINS)


def errors_by_word_count(preds: DataFrame, text_col: str = "text") -> DataFrame:
    """Word-count buckets 0-5-10-20-50-∞."""
    return errors_by_bucket(preds, F.size(T.split_ws(F.col(text_col))), WORD_BINS)


def errors_by_lexicon_presence(preds: DataFrame, lexicons: dict[str, list[str]], text_col: str = "text") -> DataFrame:
    """For each lexicon, error rate of texts containing any of its words (substring) vs not."""
    parts = []
    for name, words in lexicons.items():
        has = F.lit(False)
        for w in words:
            has = has | (F.instr(F.col(text_col), w) > 0)
        parts.append(F.struct(F.lit(name).alias("lexicon"), has.alias("present")))
    ex = preds.select((F.col("y_true") != F.col("y_pred")).cast("int").alias("e"), F.inline(F.array(*parts)))
    g = ex.groupBy("lexicon", "present").agg(F.count(F.lit(1)).alias("total"), F.sum("e").cast("bigint").alias("errors"))
    return g.withColumn("error_rate", F.col("errors") / F.col("total"))


def common_words_in_errors(preds: DataFrame, stopwords: list[str], k: int = 10, min_texts: int = 3,
                           text_col: str = "text") -> DataFrame:
    """Per error pair with ≥ min_texts texts, the k most frequent words
    (lower-cased, > 2 chars, stopwords dropped; ties: word asc)."""
    e = preds.filter(F.col("y_true") != F.col("y_pred"))
    sizes = e.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= min_texts)
    w = (e.select("y_true", "y_pred", F.explode_outer(T.words(F.lower(F.col(text_col)))).alias("word"))
          .filter(F.col("word").isNotNull() & (F.length("word") > 2) & ~F.col("word").isin(*stopwords)))
    c = w.groupBy("y_true", "y_pred", "word").agg(F.count(F.lit(1)).alias("n")) \
         .join(F.broadcast(sizes.select("y_true", "y_pred")), ["y_true", "y_pred"])  # ≤ K² pairs
    win = W.partitionBy("y_true", "y_pred").orderBy(F.col("n").desc(), F.col("word"))
    return c.withColumn("rank", F.row_number().over(win).cast("int")).filter(F.col("rank") <= k)


def length_stats_error_vs_correct(preds: DataFrame, text_col: str = "text") -> DataFrame:
    """Mean / median / population std of the length, errors vs correct."""
    n = F.length(text_col)
    g = preds.groupBy((F.col("y_true") != F.col("y_pred")).alias("is_error"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.avg(n).alias("mean_length"),
                 F.median(n).cast("double").alias("median_length"), F.stddev_pop(n).alias("std_length"))


def emoji_rate_error_vs_correct(preds: DataFrame, text_col: str = "text", pattern: str = ERROR_EMOJI) -> DataFrame:
    """L10."""
    g = preds.groupBy((F.col("y_true") != F.col("y_pred")).alias("is_error"))
    has = F.coalesce(F.col(text_col).rlike(pattern), F.lit(False)).cast("int")
    return g.agg(F.count(F.lit(1)).alias("total"), F.sum(has).cast("bigint").alias("with_emoji"),
                 F.avg(has).alias("emoji_rate"))


def punctuation_density(preds: DataFrame, text_col: str = "text", chars: str = P.DENSITY_PUNCT) -> DataFrame:
    """Share of punctuation characters per text, mean / population std."""
    t = F.col(text_col)
    dens = F.when(F.length(t) > 0, (F.length(t) - F.length(F.translate(t, chars, ""))) / F.length(t)).otherwise(0.0)
    g = preds.groupBy((F.col("y_true") != F.col("y_pred")).alias("is_error"))
    return g.agg(F.avg(dens).alias("mean_density"), F.stddev_pop(dens).alias("std_density"))


def high_confidence_errors(preds: DataFrame, threshold: float = 0.8, k: int = 10) -> DataFrame:
    """First k errors (by id) with confidence ≥ threshold."""
    f = with_flags(preds).filter((F.col("is_error") == 1) & (F.col("confidence") >= threshold))
    return f.orderBy("id").limit(k).select("id", "y_true", "y_pred", "confidence", "proba", "text")


def low_confidence_correct(preds: DataFrame, threshold: float = 0.6, k: int = 10) -> DataFrame:
    """First k correct predictions (by id) with confidence ≤ threshold."""
    f = with_flags(preds).filter((F.col("is_error") == 0) & (F.col("confidence") <= threshold))
    return f.orderBy("id").limit(k).select("id", "y_true", "y_pred", "confidence", "proba", "text")


def confidence_bands(preds: DataFrame) -> DataFrame:
    """Bands 0-.5-.7-.8-.9-1 of the max probability."""
    return errors_by_bucket(preds, F.array_max("proba"), CONFIDENCE_BINS)


def calibration(preds: DataFrame, edges: list[float] = CALIBRATION_BINS) -> DataFrame:
    """Ten (lo, hi] confidence bins: mean confidence, accuracy of argmax(proba), count, gap."""
    conf = F.array_max("proba")
    # a generator holds the two values: inlined into every bin edge they outgrow the compiler's method size
    f = preds.select(F.inline(F.array(F.struct(conf.alias("confidence"), (F.array_position("proba", conf) - 1 == F.col("y_true")).cast("double").alias("hit")))))
    b = f.select(bucket(F.col("confidence"), edges).alias("bin"), "confidence", "hit")
    g = b.filter(F.col("bin").isNotNull()).groupBy("bin").agg(
        F.avg("confidence").alias("avg_confidence"), F.avg("hit").alias("accuracy"), F.count(F.lit(1)).alias("count"))
    lo = F.element_at(F.array(*[F.lit(x) for x in edges]), F.col("bin") + 1)
    hi = F.element_at(F.array(*[F.lit(x) for x in edges]), F.col("bin") + 2)
    return g.select("bin", lo.alias("bin_lower"), hi.alias("bin_upper"), "avg_confidence", "accuracy", "count",
                    F.abs(F.col("avg_confidence") - F.col("accuracy")).alias("calibration_error"))


def ece_mce(preds: DataFrame) -> DataFrame:
    """Expected (count-weighted) and maximum calibration error."""
    n = preds.agg(F.count(F.lit(1))).scalar()
    c = calibration(preds)
    return c.agg(F.sum(F.col("count") / n * F.col("calibration_error")).alias("ece"),
                 F.max("calibration_error").alias("mce"))


def worst_predictions(preds: DataFrame, k: int = 20) -> DataFrame:
    """The k most confident errors (ties: id)."""
    f = with_flags(preds).filter(F.col("is_error") == 1)
    return f.orderBy(F.col("confidence").desc(), "id").limit(k).select("id", "y_true", "y_pred", "confidence", "text")


def most_confused(preds: DataFrame, k: int = 20) -> DataFrame:
    """The k rows with the lowest max probability, with the error flag (ties: id)."""
    f = with_flags(preds)
    return f.orderBy(F.col("confidence").asc(), "id").limit(k).select(
        "id", "y_true", "y_pred", "is_error", (1 - F.col("confidence")).alias("confusion_score"), "confidence")


def misclassified_by_class(preds: DataFrame, k: int = 3) -> DataFrame:
    """Per true class the error count and the first k misclassified examples."""
    e = preds.filter(F.col("y_true") != F.col("y_pred"))
    cnt = e.groupBy("y_true").agg(F.count(F.lit(1)).alias("n_errors"))
    ex = first_k_per_group(e, ["y_true"], k).select("y_true", "rank", "id", "y_pred")
    return ex.join(F.broadcast(cnt), "y_true")  # one row per class
