"""Collection roll-ups (B*) and labelling / label analysis (E*).

Every function maps DataFrames to a DataFrame.  Group-bys use partial
(map-side) aggregation; shares are computed from the aggregated rows, so no
window ever runs over raw rows without a partition key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nazar.functions import text as T
from nazar.operators.common import global_row_number
from nazar.functions.mathx import rnd
from nazar.session import broadcast_lexicon

LABELS = ["negative", "neutral", "positive"]
# Label → ordinal used for the rating correlation.
LABEL_ORDINAL = {"negative": 1, "neutral": 2, "positive": 3}


# ------------------------------------------------------------------ B: collection

def cap_per_app(df: DataFrame, n: int = 200, app_col: str = "app_name", order_col: str = "id") -> DataFrame:
    """B1: first ``n`` reviews of every app (order = ``order_col``)."""
    w = W.partitionBy(app_col).orderBy(order_col)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


def collection_log(apps: DataFrame, reviews: DataFrame, app_col: str = "app_name") -> DataFrame:
    """B2: per app the number of collected reviews and a success/failed status."""
    counts = reviews.groupBy(app_col).agg(F.count(F.lit(1)).alias("n_reviews"))
    out = apps.select(app_col).join(counts, app_col, "left")
    n = F.coalesce(F.col("n_reviews"), F.lit(0)).cast("bigint")
    return out.select(app_col, n.alias("n_reviews"),
                      F.when(n > 0, "success").otherwise("failed").alias("status"))


def collection_totals(log: DataFrame) -> DataFrame:
    """B2 totals: apps, successful, failed, reviews."""
    return log.agg(F.count(F.lit(1)).alias("total_apps"),
                   F.sum(F.when(F.col("status") == "success", 1).otherwise(0)).cast("bigint").alias("successful_apps"),
                   F.sum(F.when(F.col("status") == "failed", 1).otherwise(0)).cast("bigint").alias("failed_apps"),
                   F.sum("n_reviews").cast("bigint").alias("total_reviews"))


def failed_apps(apps: DataFrame, reviews: DataFrame, app_col: str = "app_name") -> DataFrame:
    """Apps without a single review (anti join)."""
    return apps.select(app_col).join(reviews.select(app_col), app_col, "left_anti")


def avg_reviews_per_successful_app(log: DataFrame) -> DataFrame:
    """B4."""
    return (log.filter(F.col("status") == "success")
            .agg(F.avg("n_reviews").alias("avg_reviews_per_app")))


# ------------------------------------------------------------------ E: labelling jobs

def label_candidates(df: DataFrame, text_col: str = "comment", min_len: int = 10) -> DataFrame:
    """Rows worth labelling: text present and strictly longer than ``min_len``."""
    return df.filter(F.col(text_col).isNotNull() & (F.length(text_col) > min_len))


def sample_n(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Deterministic sample without replacement: the n smallest md5(seed:id).

    Runs as TakeOrderedAndProject (per-partition top-n, then a merge of n rows
    per partition), never a global sort.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.withColumn("_k", key).orderBy("_k").limit(n).drop("_k")


def estimate_cost(df: DataFrame, prompt_tokens_col: str, system_tokens: int,
                  price_in_per_1k: float, price_out_per_1k: float, out_tokens_per_row: int = 5) -> DataFrame:
    """Cost of labelling every row (token counts are an input column)."""
    inp = F.sum(F.lit(system_tokens) + F.col(prompt_tokens_col)).cast("bigint")
    n = F.count(F.lit(1))
    agg = df.agg(inp.alias("total_input_tokens"), (n * out_tokens_per_row).cast("bigint").alias("estimated_output_tokens"),
                 n.alias("n_rows"))
    ic = F.col("total_input_tokens") / 1000.0 * price_in_per_1k
    oc = F.col("estimated_output_tokens") / 1000.0 * price_out_per_1k
    return agg.select("total_input_tokens", "estimated_output_tokens",
                      ic.alias("input_cost"), oc.alias("output_cost"), (ic + oc).alias("total_cost"),
                      F.when(F.col("n_rows") > 0, (ic + oc) / F.col("n_rows")).otherwise(0.0).alias("cost_per_comment"))


def flat_cost_estimate(df: DataFrame, in_per_row: int = 100, out_per_row: int = 5,
                       price_in_per_1k: float = 0.000150, price_out_per_1k: float = 0.000600,
                       batch_threshold: int = 1000) -> DataFrame:
    """Flat per-row estimate and the batch-API saving line above a threshold."""
    n = F.count(F.lit(1))
    agg = df.agg(n.alias("n_comments"))
    total = (F.col("n_comments") * in_per_row / 1000.0 * price_in_per_1k
             + F.col("n_comments") * out_per_row / 1000.0 * price_out_per_1k)
    return agg.select("n_comments", total.alias("total_cost"),
                      F.try_divide(total, F.col("n_comments")).alias("cost_per_comment"),
                      F.when(F.col("n_comments") > batch_threshold, total * 0.5).alias("batch_savings"))


def assign_batches(df: DataFrame, size: int = 1000, order_col: str = "id") -> DataFrame:
    """Consecutive batches of ``size`` rows in ``order_col`` order (batch 1 first).

    The number comes from ``common.global_row_number`` (no one-task window).
    """
    numbered = global_row_number(df, [order_col], "row_num")
    return numbered.withColumn("batch_id", (F.floor((F.col("row_num") - 1) / size) + 1).cast("bigint"))


def validate_label(raw: Column) -> Column:
    """E5: strip + lower; anything outside the three classes becomes neutral."""
    v = F.lower(T.py_strip(raw))
    return F.when(v.isin(*LABELS), v).otherwise(F.lit("neutral"))


def validate_labels(df: DataFrame, raw_col: str = "raw_label") -> DataFrame:
    """E5 with the invalid count per original value."""
    v = F.lower(T.py_strip(F.col(raw_col)))
    return df.withColumn("sentiment_label", validate_label(F.col(raw_col))) \
             .withColumn("was_invalid", (~F.coalesce(v.isin(*LABELS), F.lit(False))).cast("int"))


def merge_labels(reviews: DataFrame, results: DataFrame, id_col: str = "id", order_col: str | None = None) -> DataFrame:
    """Left join of results by id-as-string; missing label → neutral, flagged.

    An id has one result: of several the last by ``order_col``, or without it the last label by
    name, so reviews are never multiplied."""
    r = results.select(F.col(id_col).cast("string").alias("_key"), F.col("sentiment_label").alias("_lab"),
                       (F.col(order_col) if order_col else F.lit(0)).alias("_at"))
    r = r.filter(F.col("_key").isNotNull()).groupBy("_key").agg(F.max(F.struct("_at", "_lab"))["_lab"].alias("_lab"))
    out = reviews.withColumn("_key", F.col(id_col).cast("string")).join(r, "_key", "left")
    return (out.withColumn("was_missing", F.col("_lab").isNull().cast("int"))
               .withColumn("sentiment_label", F.coalesce(F.col("_lab"), F.lit("neutral")))
               .drop("_key", "_lab"))


def daily_label_counts(df: DataFrame, ts_col: str = "day", label_col: str = "label",
                       labels: list[str] | None = None) -> DataFrame:
    """Day × label counts, pivoted, zero-filled.  Explicit pivot values avoid a
    distinct-values job; the pivot is a single partial aggregation."""
    day = F.to_date(F.col(ts_col)).alias("day")
    g = df.groupBy(day)
    p = g.pivot(label_col, labels) if labels else g.pivot(label_col)
    out = p.agg(F.count(F.lit(1)))
    return out.na.fill(0)


def label_usage(results: DataFrame, n_total: int | None = None, duration_s: float | None = None,
                price_in_per_1k: float = 0.000150, price_out_per_1k: float = 0.000600) -> DataFrame:
    """Token totals, cost, labelled/failed counts, success rate, rows per second."""
    agg = results.agg(
        F.count(F.lit(1)).alias("total_comments"),
        F.sum(F.coalesce(F.col("input_tokens"), F.lit(0))).cast("bigint").alias("input_tokens"),
        F.sum(F.coalesce(F.col("output_tokens"), F.lit(0))).cast("bigint").alias("output_tokens"),
        F.sum(F.when(F.col("error").isNull(), 1).otherwise(0)).cast("bigint").alias("labelled_comments"),
        F.sum(F.when(F.col("error").isNotNull(), 1).otherwise(0)).cast("bigint").alias("failed_comments"))
    cost = (F.col("input_tokens") / 1000.0 * price_in_per_1k + F.col("output_tokens") / 1000.0 * price_out_per_1k)
    cols = [F.col(c) for c in agg.columns] + [
        rnd(cost, 4).alias("total_cost_usd"),
        F.when(F.col("total_comments") > 0, F.col("labelled_comments") / F.col("total_comments"))
         .otherwise(0.0).alias("success_rate")]
    if duration_s:
        cols.append(rnd(F.col("labelled_comments") / F.lit(duration_s), 2).alias("comments_per_second"))
    return agg.select(*cols)


def label_distribution(df: DataFrame, label_col: str = "sentiment_label") -> DataFrame:
    """Count and percent (2 dp).  The share window runs over ≤ K aggregated rows."""
    c = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("pct", rnd(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy()), 2))


def rating_label_crosstab(df: DataFrame, rating_col: str = "rating", label_col: str = "sentiment_label",
                          labels: list[str] = LABELS) -> DataFrame:
    """Rating × label, row-normalised percentages (zero when absent)."""
    p = df.groupBy(rating_col).pivot(label_col, labels).agg(F.count(F.lit(1))).na.fill(0)
    tot = sum((F.col(l) for l in labels), F.lit(0))
    return p.select(rating_col, *[rnd(F.col(l) * 100.0 / tot, 2).alias(l) for l in labels])


def mean_rating_by_label(df: DataFrame, rating_col: str = "rating", label_col: str = "sentiment_label") -> DataFrame:
    """E11."""
    return df.groupBy(label_col).agg(rnd(F.avg(rating_col), 2).alias("avg_rating"))


def rating_label_corr(df: DataFrame, rating_col: str = "rating", label_col: str = "sentiment_label") -> DataFrame:
    """Pearson r of rating vs label ordinal; null with a single class."""
    ordv = F.when(F.col(label_col) == "negative", 1).when(F.col(label_col) == "neutral", 2) \
            .when(F.col(label_col) == "positive", 3)
    agg = df.agg(F.corr(F.col(rating_col).cast("double"), ordv.cast("double")).alias("r"),
                 F.count_distinct(F.col(label_col)).alias("k"))
    return agg.select(F.when(F.col("k") > 1, rnd(F.col("r"), 3)).alias("correlation"))


def app_label_share(df: DataFrame, app_col: str = "app_name", label_col: str = "sentiment_label",
                    labels: list[str] = LABELS) -> DataFrame:
    """App × label percentage pivot, zeros for absent labels."""
    p = df.groupBy(app_col).pivot(label_col, labels).agg(F.count(F.lit(1))).na.fill(0)
    tot = sum((F.col(l) for l in labels), F.lit(0))
    return p.select(app_col, tot.cast("bigint").alias("n_reviews"),
                    *[(F.col(l) * 100.0 / tot).alias(f"{l}_pct") for l in labels])


def net_score_topk(df: DataFrame, k: int = 5, app_col: str = "app_name",
                   label_col: str = "sentiment_label") -> DataFrame:
    """positive% − negative% per app; best k and worst k (ties by app name).

    Top-k on the per-app aggregate: ordered limits, no global window.
    """
    s = app_label_share(df, app_col, label_col).select(
        app_col, (F.col("positive_pct") - F.col("negative_pct")).alias("net_score"))
    best = (s.orderBy(F.col("net_score").desc(), F.col(app_col)).limit(k)
             .withColumn("side", F.lit("best")))
    worst = (s.orderBy(F.col("net_score").asc(), F.col(app_col)).limit(k)
              .withColumn("side", F.lit("worst")))
    return best.unionByName(worst)


def length_by_label(df: DataFrame, text_col: str = "comment", label_col: str = "sentiment_label") -> DataFrame:
    """Mean / median / sample std of the character length per label."""
    n = F.length(text_col)
    return df.groupBy(label_col).agg(rnd(F.avg(n), 2).alias("mean_len"),
                                     rnd(F.median(n), 2).alias("median_len"),
                                     rnd(F.stddev_samp(n), 2).alias("std_len"))


def top_words_by_label(df: DataFrame, k: int = 10, text_col: str = "comment",
                       label_col: str = "sentiment_label") -> DataFrame:
    """K most frequent lower-cased words per label (ties: word asc).

    Words are exploded per row and counted with a partial aggregation on
    (label, word); the ranking window is partitioned by label over the
    *aggregated* counts only.
    """
    words = (df.select(label_col, F.explode_outer(T.words(F.lower(F.col(text_col)))).alias("word"))
             .filter(F.col("word").isNotNull()))
    c = words.groupBy(label_col, "word").agg(F.count(F.lit(1)).alias("n"))
    w = W.partitionBy(label_col).orderBy(F.col("n").desc(), F.col("word"))
    return c.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def box_stats(df: DataFrame, value: Column, label_col: str = "sentiment_label") -> DataFrame:
    """Exact quartiles (linear interpolation, as pandas) of a value per label."""
    q = F.percentile(value.cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return (df.groupBy(label_col).agg(q.alias("q"), F.min(value).cast("double").alias("min"),
                                      F.max(value).cast("double").alias("max"))
              .select(label_col, "min", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"),
                      F.col("q")[2].alias("q3"), "max"))


def equal_width_bins(df: DataFrame, value: Column, bins: int, group_cols: list[str] | None = None) -> DataFrame:
    """D7 / E18 core: equal-width histogram between min and max (last bin closed).

    Equal values of a group are counted first, on the map side too; the range of a
    group and its bins come from these counts, so rows of a frequent group never
    meet on its key: what does is its distinct values.
    """
    group_cols = group_cols or []
    v = df.select(*group_cols, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    v = v.groupBy(*group_cols, "_v").agg(F.count(F.lit(1)).alias("_m"))
    mm = v.groupBy(*group_cols).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if not group_cols:  # one-row side, joined on a constant key: broadcast
        v, mm = v.withColumn("_g", F.lit(0)), F.broadcast(mm.withColumn("_g", F.lit(0)))
        group_keys = ["_g"]
    else:  # one row per group: AQE broadcasts it when small, shuffles when the groups are many
        group_keys = group_cols
    j = v.join(mm, group_keys)
    width = F.col("_hi") - F.col("_lo")
    b = F.when(width == 0, F.lit(0)).otherwise(
        F.least(F.lit(bins - 1), F.floor((F.col("_v") - F.col("_lo")) * bins / width))).cast("int")
    c = j.groupBy(*group_cols, b.alias("bin"), "_lo", "_hi").agg(F.sum("_m").alias("n"))
    lo_edge = F.col("_lo") + F.col("bin") * (F.col("_hi") - F.col("_lo")) / bins
    hi_edge = F.col("_lo") + (F.col("bin") + 1) * (F.col("_hi") - F.col("_lo")) / bins
    return c.select(*group_cols, "bin", lo_edge.alias("bin_start"), hi_edge.alias("bin_end"), "n")


# keywords up to which a category is a chain of substring tests; an automaton takes more
KEYWORDS_IN_ROW = 100
MAX_KEYWORDS = 200_000


def tag_categories(df: DataFrame, categories: DataFrame, text_col: str = "comment", id_col: str = "id") -> DataFrame:
    """(id, category) for every category with a keyword contained in the text.

    ``categories`` is a lexicon (category, keyword) of at most MAX_KEYWORDS rows, case ignored.
    A text is looked at once and gives its categories as an array in its row: by substring
    tests, or for many keywords by an automaton that finds all of them in one pass.  No text
    meets the lexicon in a join, and no tag is made twice.
    """
    rows = categories.select("category", F.lower("keyword").alias("keyword")).dropna().distinct().limit(MAX_KEYWORDS + 1).collect()
    if len(rows) > MAX_KEYWORDS:
        raise ValueError(f"more than {MAX_KEYWORDS} keywords")
    held: dict[str, list[str]] = {}
    for r in sorted(rows):
        held.setdefault(r.category, []).append(r.keyword)
    d = df.select(id_col, F.lower(F.col(text_col)).alias("_t"))
    if not held:
        return d.limit(0).select(id_col, F.lit("").alias("category"))
    if len(rows) <= KEYWORDS_IN_ROW:
        has = [F.when(reduce(lambda a, b: a | b, [F.contains("_t", F.lit(k)) for k in ks]), F.lit(c)) for c, ks in held.items()]
        tags = d.select(id_col, F.array_compact(F.array(*has)).alias("_c"))
        return tags.select(id_col, F.explode("_c").alias("category"))
    return _tagged_by_automaton(d, held, id_col)


def _tagged_by_automaton(d: DataFrame, held: dict[str, list[str]], id_col: str) -> DataFrame:
    """(id, category) of the lower-cased texts ``_t``: an Aho-Corasick automaton in each task."""
    shared = d.sparkSession.sparkContext.broadcast(held)

    def run(batches):
        import ahocorasick
        import pyarrow as pa
        of: dict[str, list[str]] = {}
        for c, ks in shared.value.items():
            for k in ks:
                of.setdefault(k, []).append(c)
        always = of.pop("", [])  # the empty keyword is in every text
        automaton = ahocorasick.Automaton()
        for k, cs in of.items():
            automaton.add_word(k, cs)
        if of:
            automaton.make_automaton()
        for b in batches:
            at, tag = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t is not None:
                    found = {*always, *(c for _, cs in (automaton.iter(t) if of else ()) for c in cs)}
                    at += [i] * len(found)
                    tag += sorted(found)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(tag, pa.string())], names=[id_col, "category"])

    return d.mapInArrow(run, f"{id_col} {dict(d.dtypes)[id_col]}, category string")


def label_share_by_category(tagged: DataFrame, labelled: DataFrame, id_col: str = "id",
                            label_col: str = "sentiment_label", labels: list[str] = LABELS) -> DataFrame:
    """Label mix (percent) per service category."""
    j = tagged.join(labelled.select(id_col, label_col), id_col)
    p = j.groupBy("category").pivot(label_col, labels).agg(F.count(F.lit(1))).na.fill(0)
    tot = sum((F.col(l) for l in labels), F.lit(0))
    return p.select("category", tot.cast("bigint").alias("n_reviews"),
                    *[rnd(F.col(l) * 100.0 / tot, 2).alias(f"{l}_pct") for l in labels])
