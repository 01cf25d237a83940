"""Sparse text features (F1–F18) in long form: (id, term, weight).

Plan shape of a fit (see README "TF-IDF plan"):
  terms → distinct (term, tf) arrays, counted in the row → shuffle on id   [counts]
  counts → explode → partial count per term → shuffle on term (one row per
       term and map task) → df/cf filter → top max_features → broadcast    [vocab]
  counts (the same exchange) → explode → ⋈ broadcast(vocab) → L2 norm window
       per id, where the rows already are.
Documents cross the network once, as arrays of distinct terms; nothing is
shuffled on (id, term).  The vocabulary side is bounded by ``max_features``
(or size-checked before broadcast when unbounded); frequent terms are
pre-aggregated map-side, so a term present in every document costs one row
per map task, not per document.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nazar.functions import text as T
from nazar.functions.mathx import rnd
from nazar.operators.common import global_row_number, n_rows
from nazar.operators.grams import gram_stats
from nazar.session import broadcast_if_small, cut_lineage


def term_counts(docs: DataFrame, terms_col: str = "terms", id_col: str = "id") -> DataFrame:
    """``_row_counts``, rows dealt by id (a row is a document: ids are unique), so what is computed
    per id afterwards needs no further shuffle, and all readers share this exchange."""
    return _row_counts(docs, terms_col, id_col).repartition(id_col)


def _row_counts(docs: DataFrame, terms_col: str, id_col: str) -> DataFrame:
    """(id, counts): every document's distinct terms with their counts, an array of (term, tf)
    made in the row: of the sorted terms, the places where a run ends give the runs' lengths."""
    # each step reads the columns of the step before more than once, so none is inlined into a lambda
    s = docs.select(id_col, F.sort_array(F.array_compact(terms_col)).alias("_s"))
    ends = F.transform("_s", lambda t, i: F.when((i + 1 == F.size("_s")) | (t != F.get("_s", i + 1)), i + 1))
    s = s.select(id_col, "_s", F.array_compact(ends).alias("_e"))
    run = lambda e, k: F.struct(F.get("_s", e - 1).alias("term"), (e - F.coalesce(F.get("_e", k - 1), F.lit(0))).cast("bigint").alias("tf"))
    return s.select(id_col, F.transform("_e", run).alias("counts"))


def exploded_counts(counts: DataFrame, id_col: str = "id") -> DataFrame:
    """(id, term, tf) of ``term_counts``."""
    # inline_outer + null filter: a plain inline makes the optimizer infer
    # size(counts) > 0 and push it below the exchange, counting every row twice
    return counts.select(id_col, F.inline_outer("counts")).filter(F.col("term").isNotNull())


def term_frequencies(docs: DataFrame, terms_col: str = "terms", id_col: str = "id") -> DataFrame:
    """(id, term, tf) raw counts."""
    return exploded_counts(term_counts(docs, terms_col, id_col), id_col)


def build_vocab(tf: DataFrame, n_docs: Column, min_df: int | float = 2, max_df: int | float = 0.8,
                max_features: int | None = 10000) -> DataFrame:
    """(term, df, cf, idx, idf).  df filter, then the ``max_features`` largest
    corpus counts (ties: term asc); idx = alphabetical rank; smooth idf."""
    return vocab_of(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf")), n_docs, min_df, max_df, max_features)


def vocab_of(st: DataFrame, n_docs: Column, min_df: int | float = 2, max_df: int | float = 0.8,
             max_features: int | None = 10000) -> DataFrame:
    """``build_vocab`` of the terms' (term, df, cf)."""
    lo = min_df if isinstance(min_df, int) else F.ceil(F.lit(min_df) * n_docs)
    hi = F.lit(max_df) if isinstance(max_df, int) else F.lit(max_df) * n_docs
    st = st.filter((F.col("df") >= lo) & (F.col("df") <= hi))
    if max_features:
        st = st.orderBy(F.col("cf").desc(), F.col("term")).limit(max_features)
        # bounded by max_features: one small sort for the alphabetical index
        st = st.withColumn("idx", (F.row_number().over(W.orderBy("term")) - 1).cast("int"))
    else:
        st = global_row_number(st, ["term"], "idx").withColumn("idx", (F.col("idx") - 1).cast("int"))
    idf = F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + F.col("df"))) + 1.0
    return st.withColumn("idf", idf)


def vocab_side(vocab: DataFrame, max_features: int | None) -> DataFrame:
    return broadcast_if_small(vocab, known_bound=max_features)


def tfidf_weights(tf: DataFrame, vocab: DataFrame, sublinear: bool = True, norm: bool = True,
                  id_col: str = "id", max_features: int | None = 10000) -> DataFrame:
    """(id, term, idx, weight).  Terms outside the vocabulary are dropped."""
    j = tf.join(vocab_side(vocab.select("term", "idx", "idf"), max_features), "term")
    base = (F.lit(1.0) + F.log(F.col("tf"))) if sublinear else F.col("tf").cast("double")
    w = j.withColumn("_w", base * F.col("idf"))
    if norm:
        nrm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(W.partitionBy(id_col)))
        w = w.withColumn("_w", F.col("_w") / nrm)
    return w.select(id_col, "term", "idx", F.col("_w").alias("weight"))


def fit_tfidf(docs: DataFrame, terms_col: str = "terms", id_col: str = "id", min_df=2, max_df=0.8,
              max_features: int | None = 10000, sublinear: bool = True, norm: bool = True,
              only: DataFrame | None = None, weigh: bool = True):
    """F4+F5 on a table of term arrays → (vocab, weights).  n counts every input
    row, including documents with no terms.  ``only`` (a table of ids): weights of
    these documents alone, taken before their terms become rows.  Without ``weigh`` the weights are
    None, and no document is shuffled: a task's terms are counted where they are."""
    n = n_rows(docs)
    counts = _row_counts(docs, terms_col, id_col)
    if not weigh:
        return build_vocab(exploded_counts(counts, id_col), n, min_df, max_df, max_features), None
    counts = counts.repartition(id_col)
    vocab = build_vocab(exploded_counts(counts, id_col), n, min_df, max_df, max_features)
    wanted = counts if only is None else counts.join(only.select(id_col), id_col, "left_semi")
    return vocab, tfidf_weights(exploded_counts(wanted, id_col), vocab, sublinear, norm, id_col, max_features)


def tfidf_transform(docs: DataFrame, vocab: DataFrame, terms_col: str = "terms", id_col: str = "id",
                    sublinear: bool = True, norm: bool = True, max_features: int | None = 10000) -> DataFrame:
    """weights of new documents against a stored vocabulary (unseen terms dropped)."""
    return tfidf_weights(term_frequencies(docs, terms_col, id_col), vocab, sublinear, norm, id_col, max_features)


# ---------------------------------------------------------------- term sources

def word_terms(tokens, ngram_max: int = 1) -> Column:
    """unigrams .. n-grams of a token array column reference."""
    out = T._c(tokens)
    for n in range(2, ngram_max + 1):
        out = F.concat(out, T.word_ngrams(tokens, n))
    return out


def with_word_terms(df: DataFrame, tokens: Column, ngram_max: int = 2, id_col: str = "id") -> DataFrame:
    """(id, terms) with word 1..n-grams; tokens are materialised first so the
    n-gram lambdas read a column instead of re-running the tokenizer."""
    t = df.select(id_col, tokens.alias("_tok"))
    return t.select(id_col, word_terms(F.col("_tok"), ngram_max).alias("terms"))


def sklearn_word_tokens(text) -> Column:
    """Tokens of the default word pattern: runs of ≥ 2 word characters."""
    return F.regexp_extract_all(T._c(text), F.lit(r"[\p{L}\p{N}_]{2,}"), 0)


def with_char_terms(df: DataFrame, text: Column, n_min: int = 2, n_max: int = 4, id_col: str = "id") -> DataFrame:
    """(id, terms) with all character n-grams, n_min ≤ n ≤ n_max."""
    s = df.select(id_col, T.normalize_for_char_ngrams(text).alias("_s"))
    s = s.select(id_col, T.characters("_s").alias("_a"))
    out = F.concat(*[T.char_ngrams(F.col("_a"), n) for n in range(n_min, n_max + 1)])
    return s.select(id_col, out.alias("terms"))


def char_vocab(df: DataFrame, text: Column, n_min: int = 2, n_max: int = 4, min_df: int | float = 2, max_df: int | float = 1.0,
               max_features: int | None = 5000, id_col: str = "id") -> DataFrame:
    """the vocabulary of ``with_char_terms``, its grams counted where the texts are: none becomes
    a row for a document."""
    s = df.select(T.normalize_for_char_ngrams(text).alias("_s"))
    return vocab_of(gram_stats(s, "_s", n_min, n_max), n_rows(df.select(id_col)), min_df, max_df, max_features)


# ---------------------------------------------------------------- analysis

def matrix_stats(weights: DataFrame, vocab: DataFrame, n_docs: Column) -> DataFrame:
    """rows, terms, non-zeros, sparsity."""
    nnz = weights.agg(F.count(F.lit(1)).alias("nnz"))
    v = vocab.agg(F.count(F.lit(1)).alias("n_terms")).scalar()
    return nnz.select(n_docs.alias("n_docs"), v.alias("n_terms"), "nnz",
                      (1.0 - F.col("nnz") / (n_docs * v)).alias("sparsity"))


def term_stats(weights: DataFrame, n_docs: Column) -> DataFrame:
    """F8: per term sum, mean over all documents (zeros included), max."""
    return weights.groupBy("term").agg(F.sum("weight").alias("sum"), F.max("weight").alias("max")) \
                  .withColumn("mean", F.col("sum") / n_docs)


def top_terms(weights: DataFrame, n: int = 50, n_docs: Column | None = None) -> DataFrame:
    """terms with the largest summed weight (ties: term asc)."""
    s = weights.groupBy("term").agg(rnd(F.sum("weight"), 6).alias("score"))
    return s.orderBy(F.col("score").desc(), F.col("term")).limit(n)


def ngram_mix(vocab: DataFrame) -> DataFrame:
    """uni / bi / tri-gram counts and ratios of the vocabulary."""
    spaces = F.size(F.split(F.col("term"), " ")) - 1
    agg = vocab.agg(F.count(F.lit(1)).alias("total_features"),
                    F.count(F.when(spaces == 0, 1)).alias("unigrams"),
                    F.count(F.when(spaces == 1, 1)).alias("bigrams"),
                    F.count(F.when(spaces == 2, 1)).alias("trigrams"))
    return agg.withColumn("unigram_ratio", F.col("unigrams") / F.col("total_features")) \
              .withColumn("bigram_ratio", F.col("bigrams") / F.col("total_features"))


def top_terms_by_class(weights: DataFrame, labels: DataFrame, k: int = 20, id_col: str = "id",
                       label_col: str = "sentiment_label") -> DataFrame:
    """mean weight of every term over the documents of a class (documents
    without the term count as zero); k best per class (ties: term asc).

    Class sizes come from a per-class count (one row per class, broadcast);
    the ranking window is partitioned by class over per-(class, term) sums.
    """
    sizes = labels.groupBy(label_col).agg(F.count(F.lit(1)).alias("_m"))
    j = weights.join(labels.select(id_col, label_col), id_col)
    s = j.groupBy(label_col, "term").agg(F.sum("weight").alias("_s"))
    s = s.join(F.broadcast(sizes), label_col).withColumn("score", rnd(F.col("_s") / F.col("_m"), 6))
    w = W.partitionBy(label_col).orderBy(F.col("score").desc(), F.col("term"))
    return (s.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= k)
             .select(label_col, "term", "score", "rank"))


def sample_ids(df: DataFrame, n: int, seed: int = 42, id_col: str = "id") -> DataFrame:
    """Deterministic sample of ``n`` ids (smallest md5(seed:id))."""
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    return df.select(id_col).distinct().withColumn("_k", key).orderBy("_k").limit(n).drop("_k")


def doc_similarity(weights: DataFrame, targets: DataFrame, id_col: str = "id", n_targets: int | None = None,
                   max_terms: int = 10000) -> DataFrame:
    """cosine of every document against a bounded set of target documents.

    ``targets`` is a small id set (e.g. ``sample_ids``); its rows are broadcast
    and joined on term, so each document row meets at most |targets| partner
    rows per term — the fan-out is bounded by the target set, never by the
    number of documents sharing a term.  Weights are L2-normalised, so the dot
    product is the cosine.  Pairs without a shared term (cosine 0) are absent.
    ``n_targets`` (e.g. the sample size) bounds the broadcast side without a
    counting job.  The weights are written once; both sides read them.
    """
    weights = cut_lineage(weights.select(id_col, "term", "weight"))
    t = weights.join(broadcast_if_small(targets.select(id_col), known_bound=n_targets), id_col).select(
        F.col(id_col).alias("id_b"), "term", F.col("weight").alias("w_b"))
    # rows of the target side ≤ targets × vocabulary size: a structural bound when known
    t = broadcast_if_small(t, known_bound=n_targets * max_terms if n_targets else None)
    j = weights.select(F.col(id_col).alias("id_a"), "term", F.col("weight").alias("w_a")).join(t, "term")
    return (j.filter(F.col("id_a") != F.col("id_b"))
             .groupBy("id_a", "id_b").agg(rnd(F.sum(F.col("w_a") * F.col("w_b")), 6).alias("cosine")))


def doc_similarity_stats(sim: DataFrame, n_pairs: Column | None = None) -> DataFrame:
    """Mean / max / min of the listed pair cosines."""
    return sim.agg(F.count(F.lit(1)).alias("n_pairs"), rnd(F.avg("cosine"), 6).alias("mean_cosine"),
                   F.max("cosine").alias("max_cosine"), F.min("cosine").alias("min_cosine"))


def text_length_features(df: DataFrame, text_col: str = "comment", id_col: str = "id") -> DataFrame:
    """chars, words, mean word length, sentences = count of . ! ? + 1."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    words = T.split_ws(t)
    mean_len = F.when(F.size(words) > 0,
                      F.aggregate(words, F.lit(0), lambda a, w: a + F.length(w)) / F.size(words)).otherwise(0.0)
    return df.select(id_col, F.length(t).alias("char_count"), F.size(words).alias("word_count"),
                     mean_len.alias("avg_word_length"), T.sentence_count(t).alias("sentence_count"))


def lexicon_features(df: DataFrame, positive: list[str], negative: list[str], text_col: str = "comment",
                     id_col: str = "id") -> DataFrame:
    """distinct positive / negative lexicon words among the whitespace words."""
    words = F.array_distinct(T.split_ws(F.coalesce(F.col(text_col), F.lit(""))))
    pos = F.size(F.filter(words, lambda w: w.isin(*positive)))
    neg = F.size(F.filter(words, lambda w: w.isin(*negative)))
    return df.select(id_col, pos.alias("positive_words"), neg.alias("negative_words"),
                     (pos - neg).alias("sentiment_score"))


def assemble_features(blocks: list[tuple[str, DataFrame]], id_col: str = "id") -> DataFrame:
    """F16: horizontal stack of long blocks (id, idx, value) with per-block offsets.

    Each block is (name, DataFrame(id, idx, value)); offsets are the running
    sum of block widths (max idx + 1), computed as scalars.
    """
    out = None
    offset = F.lit(0)
    for name, b in blocks:
        width = b.agg(F.max("idx") + 1).scalar()
        part = b.select(id_col, (F.col("idx") + offset).cast("int").alias("idx"), F.col("value").cast("double"),
                        F.lit(name).alias("block"))
        out = part if out is None else out.unionByName(part)
        offset = offset + width
    return out


def to_sparse_vectors(long: DataFrame, size: Column | int, id_col: str = "id") -> DataFrame:
    """(id, idx, value) → (id, features: SparseVector) at the pyspark.ml edge."""
    g = long.groupBy(id_col).agg(F.array_sort(F.collect_list(F.struct("idx", "value"))).alias("_e"))
    return g.select(id_col, F.transform("_e", lambda e: e["idx"]).alias("indices"),
                    F.transform("_e", lambda e: e["value"]).alias("values"))


def anova_f(weights: DataFrame, labels: DataFrame, k: int = 1000, id_col: str = "id",
            label_col: str = "sentiment_label") -> DataFrame:
    """one-way ANOVA F of every term's weight across classes (absent = 0); top k.

    Long form: per (term, class) Σx and Σx²; class sizes m_c and n are tiny
    aggregates.  SSB = Σ S_c²/m_c − S²/n, SSW = Σx² − Σ S_c²/m_c,
    F = (SSB/(K−1)) / (SSW/(n−K)), null when SSW = 0.
    """
    lab = labels.select(id_col, label_col)
    sizes = lab.groupBy(label_col).agg(F.count(F.lit(1)).alias("m"))
    n = n_rows(lab)
    kcls = sizes.agg(F.count(F.lit(1))).scalar()
    j = weights.join(lab, id_col)
    pc = j.groupBy("term", label_col).agg(F.sum("weight").alias("s"), F.sum(F.col("weight") ** 2).alias("q"))
    pc = pc.join(F.broadcast(sizes), label_col)
    per = pc.groupBy("term").agg(F.sum("s").alias("S"), F.sum("q").alias("Q"),
                                 F.sum(F.col("s") * F.col("s") / F.col("m")).alias("B"))
    ssb = F.col("B") - F.col("S") * F.col("S") / n
    ssw = F.col("Q") - F.col("B")
    f = F.when(ssw > 0, (ssb / (kcls - 1)) / (ssw / (n - kcls)))
    out = per.select("term", rnd(f, 6).alias("f_score"))
    return out.orderBy(F.col("f_score").desc_nulls_last(), F.col("term")).limit(k)


# numbers of one dense block of documents × terms, and partial products added up in one task
BLOCK_CELLS = 2_000_000
FAN_IN = 16


def _added(parts: DataFrame) -> np.ndarray:
    """The sum of the float64 arrays of (part, data), FAN_IN at a time in a reduction tree: the
    driver gets one."""
    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(d, np.float64) for d in pdf["data"])
        return pd.DataFrame({"part": [int(pdf["part"].min()) // FAN_IN], "data": [total.tobytes()]})

    n = parts.rdd.getNumPartitions()
    while n > 1:
        parts = parts.groupBy(F.floor(F.col("part") / FAN_IN)).applyInPandas(add, "part long, data binary")
        n = -(-n // FAN_IN)
    first = parts.first()
    return np.frombuffer(first["data"], np.float64) if first else np.zeros(0)


def _products(rows: DataFrame, basis: np.ndarray, gram: bool) -> np.ndarray:
    """Aᵀ(A·basis), or with ``gram`` (A·basis)ᵀ(A·basis), for the sparse rows (indices, values) of
    A: dense blocks of a few documents, a partial product per partition."""
    shared = rows.sparkSession.sparkContext.broadcast(basis)
    n_terms, width = basis.shape
    step = max(1, BLOCK_CELLS // n_terms)

    def run(batches):
        from pyspark import TaskContext
        total = np.zeros((width, width) if gram else (n_terms, width))
        for b in batches:
            cols, vals = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, step):
                ix, vx = cols.slice(lo, step), vals.slice(lo, step)
                block = np.zeros((len(ix), n_terms))
                row = np.repeat(np.arange(len(ix)), ix.value_lengths().to_numpy())
                block[row, ix.flatten().to_numpy()] = vx.flatten().to_numpy()
                y = block @ shared.value
                total += y.T @ y if gram else block.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([total.tobytes()], pa.binary())], names=["part", "data"])

    parts = rows.select("indices", "values").mapInArrow(run, "part long, data binary")
    shape = (width, width) if gram else (n_terms, width)
    added = _added(parts)
    return added.reshape(shape) if added.size else np.zeros(shape)


def svd(weights: DataFrame, n_terms: int, k: int = 10, id_col: str = "id", oversample: int = 20,
        passes: int = 6, seed: int = 42) -> DataFrame:
    """truncated SVD of the document × term matrix by a randomised range finder.

    Returns (component, singular value, explained-variance ratio σ²/‖X‖²_F).  A random basis of
    k + ``oversample`` term vectors is multiplied by AᵀA and made orthonormal ``passes`` times;
    the products run over blocks of documents, partial products are added in a tree, and only
    the basis (n_terms × (k + oversample) numbers, bounded by the vocabulary) is on the driver.
    """
    # 1,000 rows of at most n_terms terms in an Arrow batch
    rows = cut_lineage(to_sparse_vectors(weights.select(id_col, "idx", F.col("weight").alias("value")), n_terms, id_col))
    total = weights.agg(F.sum(F.col("weight") ** 2)).first()[0] or 0.0
    width = min(n_terms, k + oversample)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n_terms, width)))[0]
    for _ in range(passes):
        basis = np.linalg.qr(_products(rows, basis, gram=False))[0]
    values = np.sqrt(np.maximum(np.linalg.eigvalsh(_products(rows, basis, gram=True))[::-1], 0.0))[:k]
    return weights.sparkSession.createDataFrame([(i, float(v), float(v * v / total) if total else None) for i, v in enumerate(values)],
                                                "component int, singular_value double, variance_ratio double")


def feature_comparison(spark, reps: list[tuple[str, int, Column | float, str]]) -> DataFrame:
    """(representation, dimensions, sparsity, type)."""
    rows = None
    for name, dims, sparsity, kind in reps:
        one = spark.range(1).select(F.lit(name).alias("representation"), F.lit(dims).cast("bigint").alias("dimensions"),
                                    (sparsity if isinstance(sparsity, Column) else F.lit(float(sparsity)))
                                    .cast("double").alias("sparsity"), F.lit(kind).alias("type"))
        rows = one if rows is None else rows.unionByName(one)
    return rows
