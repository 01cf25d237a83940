"""Word vectors (G*) and contextual-embedding analytics (H*) on array<double> columns.

Vector maths uses higher-order array functions on *materialised* columns
(a lambda re-evaluates a captured expression per element).  Components never
become rows: per-group means, sums, extremes and variances are fixed-width
vector accumulators (``Summarizer``, combined on the map side), Gram matrices
are partial d × d sums of Arrow batches, added up per group.  Statistics over
pairs of vectors never emit the pairs:
* mean / std of pair cosines use Gram sums: Σ_{i<j} u_i·u_j = (‖Σu‖² − n)/2 and
  Σ_{i<j} (u_i·u_j)² = (‖Σ u uᵀ‖²_F − n)/2 for unit vectors u;
* min / max cosines and nearest words multiply blocks of vectors in numpy and
  pass on extremes or the best n of each query; bounds skip pairs of blocks.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nazar.functions.mathx import rnd
from nazar.session import BROADCAST_ROW_LIMIT, broadcast_if_small, broadcast_lexicon, cut_lineage, ensure_checkpoint_dir, saved

BLOCK_ROWS = 4_096  # vectors of each side that meet in one grouped task
CHUNK = 4 << 20  # numbers of one temporary array of a block
CACHED = 1 << 18  # distances that are worked on at once, so that they stay in a core's cache
SLAB = 16_384  # points that a task of silhouette holds while the clusters pass by
MAX_PROBES = 1_000  # query vectors that are sent to every task by most_similar; more meet in blocks
MAX_CLUSTERS = 10_000  # clusters whose means are sent to every task by silhouette; more meet in blocks
MAX_CELLS = 1_024  # cells that pair_similarity_stats cuts the unit sphere into, at most
PARTITION_TOKENS = 200_000  # tokens that one copy of a Word2Vec model is trained on in a pass
SHARED_NUMBERS = 8 << 20  # numbers of word vectors that are sent to every task by doc_vector; more are joined
HELD_GRAMS = 64 << 20  # bytes of Gram matrices a task holds before it passes them on


# ---------------------------------------------------------------- array helpers

def dot(a, b) -> Column:
    a, b = F.col(a) if isinstance(a, str) else a, F.col(b) if isinstance(b, str) else b
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a) -> Column:
    a = F.col(a) if isinstance(a, str) else a
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x))


def unit(a) -> Column:
    """Unit vector of an array column (prefer ``with_unit`` on large vectors:
    this form recomputes the norm inside the lambda)."""
    a = F.col(a) if isinstance(a, str) else a
    n = norm(a)
    return F.transform(a, lambda x: x / n)


def with_unit(df: DataFrame, vec_col: str, out: str) -> DataFrame:
    """Adds ``out`` = vec / ‖vec‖ with the norm materialised once per row."""
    return (df.withColumn("_nrm", norm(vec_col))
              .withColumn(out, F.transform(vec_col, lambda x: x / F.col("_nrm"))).drop("_nrm"))


def vector_summary(df: DataFrame, keys: list[str], vec_col: str, *metrics: str) -> DataFrame:
    """``keys`` and one array (``count``: a number) for each metric of ``pyspark.ml.stat.Summarizer``
    over the vectors of a key: accumulators of the vectors' width, combined before the shuffle.
    Null vectors are passed over; a key without any has no row (no keys: one row of nulls)."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    v = df.filter(F.col(vec_col).isNotNull()).select(*keys, array_to_vector(vec_col).alias("_v"))
    s = v.groupBy(*keys).agg(Summarizer.metrics(*metrics, "count").summary(F.col("_v")).alias("_s"))
    arrays = [vector_to_array(F.col(f"_s.{m}")).alias(m) for m in metrics if m != "count"]
    return s.select(*keys, *arrays, F.col("_s.count").alias("count")) if keys else \
        s.select(*[F.when(F.col("_s.count") > 0, vector_to_array(F.col(f"_s.{m}"))).alias(m) for m in metrics if m != "count"], F.col("_s.count").alias("count"))


def pop_std(variance: Column, n: Column) -> Column:
    """Population standard deviation of an unbiased variance."""
    return F.sqrt(F.greatest(variance * (n - 1) / n, F.lit(0.0)))


def _array_sum(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)


def gram_sums(df: DataFrame, key: str | None, vec_col: str) -> DataFrame:
    """key (if given), n, total (Σu), gram (Σ u uᵀ, flattened) of the unit vectors u of ``vec_col``:
    each task adds up whole batches by matrix products and passes on one d × d sum a key."""
    kind = dict(df.dtypes)[key] if key else "int"

    def run(batches):
        held: dict = {}

        def passed():
            cols = list(zip(*[(k, n, t.tolist(), g.ravel().tolist()) for k, (n, t, g) in held.items()], strict=True))
            held.clear()
            return pd.DataFrame(dict(zip(["key", "n", "total", "gram"], cols, strict=True)))

        size = 0
        for pdf in batches:
            pdf = pdf[pdf["vec"].notna()]
            if not len(pdf):
                continue
            u = np.vstack(pdf["vec"].to_numpy()).astype(np.float64)
            u /= np.linalg.norm(u, axis=1, keepdims=True)
            code, names = pd.factorize(pdf["key"], use_na_sentinel=False)
            order = np.argsort(code, kind="stable")
            cut = np.searchsorted(code[order], np.arange(len(names) + 1))
            for k, name in enumerate(names):
                own = u[order[cut[k]:cut[k + 1]]]
                name = None if pd.isna(name) else name
                n, t, g = held.get(name, (0, 0.0, 0.0))
                held[name] = (n + len(own), t + own.sum(axis=0), g + own.T @ own)
            size = len(held) * 8 * u.shape[1] * (u.shape[1] + 1)
            if size > HELD_GRAMS:
                yield passed()
        if held:
            yield passed()

    src = df.select((F.col(key) if key else F.lit(0)).alias("key"), F.col(vec_col).alias("vec"))
    parts = src.mapInPandas(run, f"key {kind}, n long, total array<double>, gram array<double>")
    n = parts.groupBy("key").agg(F.sum("n").alias("n"))
    t = vector_summary(parts, ["key"], "total", "sum").select("key", F.col("sum").alias("total"))
    g = vector_summary(parts, ["key"], "gram", "sum").select(F.col("key").alias("_k"), F.col("sum").alias("gram"))
    out = n.withColumnRenamed("key", "_n").join(t, F.col("_n").eqNullSafe(F.col("key"))).join(g, F.col("key").eqNullSafe(F.col("_k")))
    return out.select(*([F.col("key").alias(key)] if key else []), "n", "total", "gram")


# ---------------------------------------------------------------- G: word vectors

def sentences(docs: DataFrame, tokens_col: str = "tokens") -> DataFrame:
    """G1: keep token arrays with more than one token; totals."""
    # one pass, a document's number of tokens beside its words: a filter by it would clean the texts again
    s = docs.select(F.col(tokens_col).alias("_t"), F.size(tokens_col).alias("_n"))
    s = s.select("_n", F.posexplode_outer("_t").alias("_p", "w"))
    word, first = F.when(F.col("_n") > 1, F.col("w")), F.when((F.col("_n") > 1) & (F.col("_p") == 0), F.col("_n"))
    return s.agg(F.count(word).alias("total_words"), F.count_distinct(word).alias("unique_words"),
                 F.count(first).alias("n_sentences"), F.avg(first).alias("mean_length"))


def train_word2vec(docs: DataFrame, tokens_col: str = "tokens", dim: int = 200, window: int = 5, min_count: int = 2,
                   max_iter: int = 5, seed: int = 42, partitions: int | None = None):
    """Pyspark.ml Word2Vec (skip-gram, hierarchical softmax) → (model, vectors word, vec).

    Every partition trains its own copy of the model on its sentences, and the
    copies are averaged after each of the ``max_iter`` passes.  The sentences
    are dealt evenly: one partition for each PARTITION_TOKENS tokens, two at
    least, no more than twice the cores (an average of many short runs learns little).
    """
    from pyspark.ml.feature import Word2Vec
    # every pass reads the sentences: written once
    kept = cut_lineage(docs.select(tokens_col).filter(F.size(tokens_col) > 1))
    if not partitions:
        tokens = kept.agg(F.sum(F.size(tokens_col))).first()[0] or 0
        partitions = max(2, min(-(-tokens // PARTITION_TOKENS), 2 * docs.sparkSession.sparkContext.defaultParallelism))
    w2v = Word2Vec(vectorSize=dim, windowSize=window, minCount=min_count, maxIter=max_iter, seed=seed,
                   inputCol=tokens_col, outputCol="_doc_vec", numPartitions=partitions)
    model = w2v.fit(kept)
    # getVectors holds every vector three times on the driver, as doubles; the written model has them as floats
    path = f"{ensure_checkpoint_dir(docs.sparkSession)}/word2vec-{uuid.uuid4().hex}"
    model.write().save(path)
    vecs = docs.sparkSession.read.parquet(f"{path}/data").select("word", F.col("vector").cast("array<double>").alias("vec"))
    return model, vecs


def vocab_coverage(docs: DataFrame, vectors: DataFrame, tokens_col: str = "tokens", dim: int | None = None,
                   top: int = 20) -> DataFrame:
    """Unique words, words with a vector, ratio, model size in MB (vocab·dim·4/2²⁰; the vectors'
    own width unless given), and the ``top`` most frequent words with their counts (ties: word asc)."""
    words = docs.select(F.explode_outer(tokens_col).alias("word")).filter(F.col("word").isNotNull())
    c = saved(words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")))  # coverage and most frequent words read it
    j = c.join(vectors.select("word", F.lit(1).alias("_in")), "word", "left")
    d = F.lit(dim) if dim is not None else F.coalesce(F.max(F.size("vec")), F.lit(0))
    numbers = vectors.agg(F.count(F.lit(1)) * d).scalar()
    most = c.orderBy(F.col("freq").desc(), "word").limit(top)
    most = most.agg(F.array_sort(F.collect_list(F.struct((-F.col("freq")).alias("n"), "word")))).scalar()
    return j.agg(F.count(F.lit(1)).alias("unique_words"), F.count("_in").alias("in_model")) \
            .withColumn("coverage", F.col("in_model") / F.col("unique_words")) \
            .withColumn("model_size_mb", numbers * 4 / float(2 ** 20)) \
            .withColumn("_most", most) \
            .withColumn("most_frequent_words", F.transform("_most", lambda m: m["word"])) \
            .withColumn("most_frequent_counts", F.transform("_most", lambda m: -m["n"])).drop("_most")


def most_frequent_words(docs: DataFrame, tokens_col: str = "tokens", top: int = 20) -> DataFrame:
    """The most frequent words (ties: word asc)."""
    words = docs.select(F.explode_outer(tokens_col).alias("word")).filter(F.col("word").isNotNull())
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("freq")).orderBy(F.col("freq").desc(), "word").limit(top)


def _best(word: np.ndarray, cosine: np.ndarray, query: np.ndarray, topn: int) -> pd.DataFrame:
    """The topn words of each query (column of ``cosine``) by cosine, then word; NaN takes no part."""
    out = []
    for k in range(cosine.shape[1]):
        c = cosine[:, k]
        at = np.flatnonzero(~np.isnan(c))
        if len(at) > topn:  # all that reach the topn-th value: ties are decided by the word
            at = at[c[at] >= np.partition(c[at], len(at) - topn)[len(at) - topn]]
        order = at[np.lexsort((word[at].astype(str), -c[at]))][:topn]
        out.append(pd.DataFrame({"qword": np.repeat(query[k], len(order)), "word": word[order], "cosine": c[order]}))
    return pd.concat(out) if out else pd.DataFrame({"qword": [], "word": [], "cosine": []})


def _plain(best: pd.DataFrame) -> pd.DataFrame:
    """Strings as objects: an empty column of numbers is no column of strings."""
    return best.astype({"qword": object, "word": object})


def _cosines(word: np.ndarray, vec: np.ndarray, query: np.ndarray, qvec: np.ndarray) -> np.ndarray:
    """Cosines to 9 digits (NaN: a word itself, or no direction)."""
    with np.errstate(invalid="ignore", divide="ignore"):
        u, q = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (vec, qvec))
        c = np.floor(u @ q.T * 1e9 + 0.5) / 1e9
    c[word[:, None] == query[None]] = np.nan
    return c


def most_similar(vectors: DataFrame, queries: DataFrame, topn: int = 10) -> DataFrame:
    """For each query (qword, qvec) the topn vocabulary words by cosine,
    excluding the query word itself.

    Up to MAX_PROBES queries are one matrix sent to every task, which multiplies
    its vectors with it batch by batch and keeps the topn of each query; with
    more, blocks of vectors meet blocks of queries in grouped tasks.  Either way
    a task passes on topn rows a query at most, ranked once afterwards.
    """
    v, q = vectors.select("word", "vec").filter(F.col("vec").isNotNull()), queries.select("qword", "qvec").filter(F.col("qvec").isNotNull())
    schema = "qword string, word string, cosine double"
    few = q.limit(MAX_PROBES + 1).toPandas()
    if not len(few):
        return v.sparkSession.createDataFrame([], "query string, word string, cosine double, rank int")
    if len(few) <= MAX_PROBES:
        shared = v.sparkSession.sparkContext.broadcast((few["qword"].to_numpy(dtype=object), np.vstack(few["qvec"].to_numpy()).astype(np.float64)))

        def run(batches):
            names, matrix = shared.value
            held = pd.DataFrame({"qword": [], "word": [], "cosine": []})
            for pdf in batches:
                if len(pdf):
                    word = pdf["word"].to_numpy(dtype=object)
                    best = _best(word, _cosines(word, np.vstack(pdf["vec"].to_numpy()).astype(np.float64), names, matrix), names, topn)
                    held = pd.concat([held, best]) if len(held) else best
                    held = held.sort_values(["qword", "cosine", "word"], ascending=[True, False, True]).groupby("qword", sort=False).head(topn)
            yield _plain(held)

        found = v.mapInPandas(run, schema)
    else:
        def met(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y, xv, yv = _sides(pdf, "vec")
            if xv is None or yv is None:
                return _plain(pd.DataFrame({"qword": [], "word": [], "cosine": []}))
            word, name = (d["word"].to_numpy(dtype=object) for d in (x, y))
            return _plain(pd.concat([_best(word, _cosines(word, xv, name[lo:lo + 64], yv[lo:lo + 64]), name[lo:lo + 64], topn) for lo in range(0, len(y), 64)]))

        found = _met(v, q.toDF("word", "vec"), "word").applyInPandas(met, schema)
    w = W.partitionBy("qword").orderBy(F.col("cosine").desc(), F.col("word"))
    return (found.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= topn)
            .select(F.col("qword").alias("query"), "word", "cosine", "rank"))


def analogy(vectors: DataFrame, triples: DataFrame, topn: int = 5) -> DataFrame:
    """For (a, b, c, expected): top-n words by cosine with unit(b)+unit(c)−unit(a),
    inputs excluded; ``hit`` when expected is among them."""
    u = with_unit(vectors.select("word", "vec"), "vec", "u").select("word", "u")
    t = (triples.join(u.select(F.col("word").alias("a"), F.col("u").alias("ua")), "a")
                .join(u.select(F.col("word").alias("b"), F.col("u").alias("ub")), "b")
                .join(u.select(F.col("word").alias("c"), F.col("u").alias("uc")), "c"))
    t = t.select("a", "b", "c", "expected",
                 F.zip_with(F.zip_with("ub", "uc", lambda x, y: x + y), "ua", lambda x, y: x - y).alias("q"))
    q = t.select(F.concat_ws("|", "a", "b", "c").alias("qword"), F.col("q").alias("qvec"))
    res = most_similar(vectors, q, topn=topn + 3)
    parts = res.withColumn("_abc", F.split("query", r"\|"))
    parts = parts.filter(~F.array_contains(F.col("_abc"), F.col("word")))
    w = W.partitionBy("query").orderBy(F.col("cosine").desc(), F.col("word"))
    top = parts.withColumn("rank", F.row_number().over(w).cast("int")).filter(F.col("rank") <= topn).drop("_abc")
    exp = triples.select(F.concat_ws("|", "a", "b", "c").alias("query"), "expected")
    hits = top.join(exp, "query").groupBy("query").agg(F.max((F.col("word") == F.col("expected")).cast("int")).alias("hit"))
    return top.join(hits, "query")


def analogy_accuracy(result: DataFrame) -> DataFrame:
    """Correct / total analogies."""
    per = result.select("query", "hit").distinct()
    return per.agg(F.sum("hit").cast("bigint").alias("correct"), F.count(F.lit(1)).alias("total"),
                   F.avg("hit").alias("accuracy"))


def kmeans(vectors: DataFrame, k: int, seed: int = 42, vec_col: str = "vec"):
    """Pyspark.ml KMeans → (assignments, cluster sizes, inertia)."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector
    data = vectors.withColumn("features", array_to_vector(vec_col))
    model = KMeans(k=k, seed=seed, featuresCol="features").fit(data)
    assigned = model.transform(data).select(*[c for c in vectors.columns], F.col("prediction").alias("cluster"))
    sizes = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    return assigned, sizes, model.summary.trainingCost


def _met(points: DataFrame, reference: DataFrame, id_col: str):
    """Both sides cut into hashed blocks, every block of one with every block of the other:
    rows with _role (0 point, 1 reference), grouped by the two blocks."""
    n_p, n_r = (max(1, -(-d.count() // BLOCK_ROWS)) for d in (points, reference))

    def at(n: int) -> Column:
        return F.pmod(F.xxhash64(id_col), F.lit(n)).cast("int")

    def all_of(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = points.select(*points.columns, F.lit(0).alias("_role"), at(n_p).alias("_i"), all_of(n_r).alias("_j"))
    right = reference.select(*reference.columns, F.lit(1).alias("_role"), at(n_r).alias("_j"), all_of(n_p).alias("_i"))
    return left.unionByName(right, allowMissingColumns=True).groupBy("_i", "_j")


def _sides(pdf: pd.DataFrame, vec_col: str):
    x, y = pdf[pdf["_role"] == 0], pdf[pdf["_role"] == 1]
    return x, y, *(np.vstack(d[vec_col].to_numpy()).astype(np.float64) if len(d) else None for d in (x, y))


def _distance_sums(x: np.ndarray, xi: np.ndarray, y: np.ndarray, yi: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row of x: sums and numbers of the distances to the rows of y, by column of ``member``
    (y rows × clusters, 0/1); rows with the same id are left out."""
    s, c = np.zeros((len(x), member.shape[1])), np.zeros((len(x), member.shape[1]), dtype=np.int64)
    step = max(1, CHUNK // max(1, y.size))
    for lo in range(0, len(x), step):
        part = slice(lo, lo + step)
        d = np.sqrt(((x[part, None, :] - y[None, :, :]) ** 2).sum(-1))
        itself = xi[part, None] == yi[None, :]
        s[part] = np.where(itself, 0.0, d) @ member
        c[part] = (~itself) @ member
    return s, c


def _silhouette_value(per: DataFrame, keys: list[str], own: Column) -> DataFrame:
    """a (own cluster), b (nearest other cluster) and s = (b − a)/max(a, b) from the sums _s and
    numbers _c of distances of a point to clusters."""
    mean = F.when(F.col("_c") > 0, F.col("_s") / F.col("_c"))
    ab = per.groupBy(*keys).agg(F.max(F.when(own, mean)).alias("_a"), F.min(F.when(~own, mean)).alias("_b"))
    most = F.greatest("_a", "_b")
    return ab.withColumn("silhouette", F.when(F.col("_a").isNull(), 0.0).when(most > 0, (F.col("_b") - F.col("_a")) / most).otherwise(0.0))


def silhouette(points: DataFrame, cluster_col: str = "grp", id_col: str = "word", vec_col: str = "vec",
               reference: DataFrame | None = None) -> DataFrame:
    """Euclidean silhouette with given assignments: a = mean distance to the own cluster (self
    excluded), b = least mean distance to another cluster, s = (b − a)/max(a, b), 0 for
    singletons, null without another cluster.  One row per point, never the pairs.

    The mean distance of x to a cluster with mean μ and spread σ² (mean squared distance to μ)
    lies between ‖x − μ‖ and √(‖x − μ‖² + σ²).  So a point meets its own cluster and those whose
    lower bound does not exceed the least upper bound of all others: the rest cannot be nearest.
    The points are written once, a cluster's beside each other; a task takes SLAB of them and reads
    the clusters they need block by block, so neither points nor pairs are multiplied on disk.
    With a ``reference`` other than the points, or too many clusters to send around, all rows meet.
    """
    spark = points.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/nazar-saved/{uuid.uuid4().hex}"
    src = points.select(id_col, cluster_col, vec_col)
    src.repartitionByRange(cluster_col, id_col).sortWithinPartitions(cluster_col).write.parquet(path)
    pts = spark.read.schema(src.schema).parquet(path)
    one = lambda: pts.withColumn("_uid", F.monotonically_increasing_id()).checkpoint()
    if reference is not None:
        return _silhouette_all(one(), reference.select(id_col, cluster_col, vec_col), cluster_col, id_col, vec_col)
    stats = vector_summary(pts, [cluster_col], vec_col, "mean", "variance")
    few = stats.limit(MAX_CLUSTERS + 1).toPandas()
    if len(few) > MAX_CLUSTERS or few[cluster_col].isna().any():
        return _silhouette_all(own := one(), own.select(id_col, cluster_col, vec_col), cluster_col, id_col, vec_col)
    means = np.vstack(few["mean"].to_numpy()) if len(few) else np.zeros((0, 1))
    n = few["count"].to_numpy(dtype=float)
    spread = np.array([np.sum(v) for v in few["variance"]]) * (n - 1) / np.maximum(n, 1)
    shared = spark.sparkContext.broadcast((few[cluster_col].tolist(), means, spread, n))
    slab, block = max(1, min(SLAB, 4 * CHUNK // max(1, len(few)))), BLOCK_ROWS

    def run(batches):
        from pyarrow import dataset, fs
        names, means, spread, n = shared.value
        place = {c: i for i, c in enumerate(names)}
        system, at = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
        members = dataset.dataset(at, filesystem=system, format="parquet")

        def done(rows: pa.Table) -> pa.RecordBatch:
            x = np.vstack([np.asarray(v, dtype=np.float64) for v in rows[vec_col].to_pylist()])
            own = np.array([place[c] for c in rows[cluster_col].to_pylist()])
            each = np.arange(len(x))
            d = np.stack([np.sqrt(((x - m) ** 2).sum(axis=1)) for m in means], axis=1)
            upper = np.sqrt(d * d + spread)
            upper[each, own] = np.inf
            # a little room for rounding: a cluster too many does no harm
            wanted = d <= upper.min(axis=1, keepdims=True) * (1 + 1e-9) + 1e-12
            wanted[each, own] = True
            a, b, other = np.zeros(len(x)), np.full(len(x), np.inf), np.zeros(len(x), dtype=bool)
            for c in np.flatnonzero(wanted.any(axis=0)):
                at = np.flatnonzero(wanted[:, c])
                total = np.zeros(len(at))
                for y in members.to_batches(columns=[vec_col], filter=dataset.field(cluster_col) == names[c], batch_size=block):
                    if len(y):
                        total += _summed_distances(x[at], np.array(y.column(0).flatten(), dtype=np.float64).reshape(len(y), -1))
                mine = own[at] == c
                a[at[mine]] = total[mine] / max(1.0, n[c] - 1)
                far = at[~mine]
                b[far], other[far] = np.minimum(b[far], total[~mine] / n[c]), True
            most = np.where(other, np.maximum(a, b), a)
            alone = n[own] == 1
            with np.errstate(invalid="ignore", divide="ignore"):
                value = np.where(alone | ~((most > 0) | np.isnan(most)), 0.0, (b - a) / most)
            out = pa.array(value, mask=~alone & ~other & (a != 0))
            return pa.RecordBatch.from_arrays([rows[id_col].combine_chunks(), rows[cluster_col].combine_chunks(), out], names=[id_col, cluster_col, "silhouette"])

        held, many = [], 0
        for batch in batches:
            for lo in range(0, batch.num_rows, slab):
                held.append(batch.slice(lo, slab))
                many += held[-1].num_rows
                if many >= slab:
                    yield done(pa.Table.from_batches(held))
                    held, many = [], 0
        if many:
            yield done(pa.Table.from_batches(held))

    # quadratic work over few bytes: tasks by points, not by the bytes of their file
    tasks = max(spark.sparkContext.defaultParallelism, -(-int(n.sum()) // slab))
    kinds = ", ".join(f"{c} {pts.schema[c].dataType.simpleString()}" for c in (id_col, cluster_col))
    return pts.repartition(tasks).mapInArrow(run, f"{kinds}, silhouette double")


def _summed_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Per row of x the sum of its distances to the rows of y: ‖x‖² + ‖y‖² − 2x·y around the mean of y
    by one matrix product, and plain differences where that would cancel (equal rows: exactly 0)."""
    centre = y.mean(axis=0)
    xc, yc = x - centre, y - centre
    xx, yy = (xc * xc).sum(axis=1), (yc * yc).sum(axis=1)
    turned, most = np.ascontiguousarray(-2.0 * yc.T), yy.max()
    out, step, pairs = np.zeros(len(x)), max(1, CACHED // len(y)), max(1, CHUNK // max(1, x.shape[1]))
    for lo in range(0, len(x), step):
        part = slice(lo, lo + step)
        d = xc[part] @ turned
        d += xx[part, None]
        d += yy
        if not d.min() >= 1e-4 * (xx[part].max() + most):
            i, j = np.nonzero(d < 1e-4 * (xx[part, None] + yy))
            for k in range(0, len(i), pairs):
                p, q = i[k:k + pairs], j[k:k + pairs]
                d[p, q] = ((x[lo + p] - y[q]) ** 2).sum(axis=1)
        out[part] = np.sqrt(d, out=d).sum(axis=1)
    return out


def _silhouette_all(pts: DataFrame, ref: DataFrame, cluster_col: str, id_col: str, vec_col: str) -> DataFrame:
    """Every point with every reference row, block by block; a row with the point's id and cluster is itself."""
    kinds = dict(pts.dtypes)

    def sums(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_role", id_col], kind="stable")
        x, y, xv, yv = _sides(pdf, vec_col)
        code, names = pd.factorize(pdf[cluster_col], use_na_sentinel=False)
        k = len(names)
        s, c = np.zeros((len(x), k)), np.zeros((len(x), k), dtype=np.int64)
        if len(x) and len(y):
            # an id within its cluster
            same = pd.factorize(pd.MultiIndex.from_arrays([pdf[id_col], code]))[0]
            s, c = _distance_sums(xv, same[:len(x)], yv, same[len(x):], np.eye(k)[code[len(x):]])
        return pd.DataFrame({"_uid": np.repeat(x["_uid"].to_numpy().astype(np.int64), k), id_col: np.repeat(x[id_col].to_numpy(), k),
                             cluster_col: np.repeat(x[cluster_col].to_numpy(), k), "_other": np.tile(np.asarray(names), len(x)),
                             "_s": s.ravel(), "_c": c.ravel()})

    schema = f"_uid long, {id_col} {kinds[id_col]}, {cluster_col} {kinds[cluster_col]}, _other {kinds[cluster_col]}, _s double, _c long"
    per = _met(pts, ref, id_col).applyInPandas(sums, schema)
    per = per.groupBy("_uid", id_col, cluster_col, "_other").agg(F.sum("_s").alias("_s"), F.sum("_c").alias("_c"))
    return _silhouette_value(per, ["_uid", id_col, cluster_col], F.col("_other").eqNullSafe(F.col(cluster_col))).select(id_col, cluster_col, "silhouette")


def _pair_moments(n: Column, total, gram) -> tuple[Column, Column]:
    """Mean and mean square of the cosines over all pairs of n unit vectors, from their Gram sums."""
    pairs = n * (n - 1) / 2
    square = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x * x)
    return ((square(total) - n) / 2) / pairs, ((square(gram) - n) / 2) / pairs


def group_coherence(vectors: DataFrame, group_col: str = "grp", vec_col: str = "vec") -> DataFrame:
    """Mean and population std of the cosine over all within-group pairs, from
    Gram sums (no pairs, and no components, become rows)."""
    g = gram_sums(vectors, group_col, vec_col).filter(F.col("n") > 1)
    mean, ex2 = _pair_moments(F.col("n"), F.col("total"), F.col("gram"))
    g = g.select(group_col, "n", mean.alias("mean_cosine"), ex2.alias("_q"))
    return g.select(group_col, "n", "mean_cosine",
                    F.sqrt(F.greatest(F.col("_q") - F.col("mean_cosine") * F.col("mean_cosine"), F.lit(0.0))).alias("std_cosine"))


def lookup_vector(words: DataFrame, vectors: DataFrame) -> DataFrame:
    """The vector of each word, null when absent (left join)."""
    return words.join(broadcast_if_small(vectors.select("word", "vec")), "word", "left")


def _doc_parts(docs: DataFrame, vectors: DataFrame, how: str) -> DataFrame:
    """id, n (known words, each vector of a word counted) and vec, the sum (or maximum) of their
    vectors, for each row of docs (id, tokens) with a known word.  The vectors are one matrix sent
    to every task; a document's words never become rows."""
    few = vectors.toPandas()
    names, code = np.unique(few["word"].to_numpy(dtype=str), return_inverse=True) if len(few) else (np.zeros(0, str), np.zeros(0, int))
    matrix = np.vstack(few["vec"].to_numpy()).astype(np.float64)[np.argsort(code, kind="stable")] if len(few) else np.zeros((0, 1))
    times = np.bincount(code, minlength=len(names))  # a word may have several vectors
    shared = docs.sparkSession.sparkContext.broadcast((names.tolist(), matrix, times))
    kind = docs.schema["id"].dataType.simpleString()

    def run(batches):
        names, matrix, times = shared.value
        place = {w: i for i, w in enumerate(names)}
        add = np.maximum if how == "max" else np.add
        if len(names):
            matrix = add.reduceat(matrix, np.cumsum(times) - times, axis=0)
        for pdf in batches:
            ids, ns, vecs = [], [], []
            for k, tokens in enumerate(pdf["tokens"]):
                at = [i for i in map(place.get, tokens if tokens is not None else ()) if i is not None]
                if at:
                    ids.append(k)
                    ns.append(int(times[at].sum()))
                    vecs.append(add.reduce(matrix[at], axis=0))
            yield pd.DataFrame({"id": pdf["id"].iloc[ids].reset_index(drop=True), "n": pd.Series(ns, dtype="int64"), "vec": pd.Series(vecs, dtype=object)})

    return docs.mapInPandas(run, f"id {kind}, n long, vec array<double>")


def doc_vector(docs: DataFrame, vectors: DataFrame, how: str = "average", tokens_col: str = "tokens",
               id_col: str = "id", zeros_when_empty: int | None = None) -> DataFrame:
    """Average / sum / max of the known words' vectors per document
    (null when no word is known, or zeros of the given dim).  Up to SHARED_NUMBERS numbers of
    vectors are sent to every task, and a row a document is shuffled; more are joined word by word."""
    metric = {"average": "mean", "sum": "sum", "max": "max"}[how]
    known = vectors.select("word", "vec").filter(F.col("vec").isNotNull() & F.col("word").isNotNull())
    # the size of the vectors, which are written: they are counted, then read
    known = cut_lineage(known)
    if (known.agg(F.sum(F.size("vec"))).first()[0] or 0) <= SHARED_NUMBERS:
        parts = _doc_parts(docs.select(F.col(id_col).alias("id"), F.col(tokens_col).alias("tokens")), known, how).withColumnRenamed("id", id_col)
        sums = vector_summary(parts, [id_col], "vec", "max" if how == "max" else "sum").toDF(id_col, "_v", "_c")
        if how == "average":
            n = parts.groupBy(F.col(id_col).alias("_id")).agg(F.sum("n").alias("_n"))
            sums = sums.join(n, F.col(id_col).eqNullSafe(F.col("_id"))).withColumn("_v", F.transform("_v", lambda x: x / F.col("_n")))
        arr = sums.select(id_col, F.col("_v").alias("doc_vec"))
    else:
        ex = docs.select(id_col, F.explode_outer(tokens_col).alias("word")).filter(F.col("word").isNotNull())
        arr = vector_summary(ex.join(known, "word"), [id_col], "vec", metric).select(id_col, F.col(metric).alias("doc_vec"))
    out = docs.select(id_col).join(arr, id_col, "left")
    if zeros_when_empty:
        out = out.withColumn("doc_vec", F.coalesce("doc_vec", F.array_repeat(F.lit(0.0), zeros_when_empty)))
    return out


def assign_semantic_group(words: DataFrame, groups: dict[str, list[str]]) -> DataFrame:
    """First group (in dict order) listing the word, else 'other'."""
    spark = words.sparkSession
    rows = [(w, g, i) for i, (g, ws) in enumerate(groups.items()) for w in ws]
    t = spark.createDataFrame(rows, "word string, group string, ord int")
    first = t.groupBy("word").agg(F.min_by("group", "ord").alias("group"))
    return words.join(F.broadcast(first), "word", "left").withColumn("group", F.coalesce("group", F.lit("other")))


def pca(vectors: DataFrame, k: int, vec_col: str = "vec"):
    """Pyspark.ml PCA → (projection, explained variance ratios)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    data = vectors.withColumn("_f", array_to_vector(vec_col))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(data)
    proj = model.transform(data).withColumn("projection", vector_to_array("_p")).drop("_f", "_p")
    ratios = [float(x) for x in model.explainedVariance.toArray()]
    return proj, ratios


# ---------------------------------------------------------------- H: embeddings

STRATEGIES = ("cls", "mean", "max", "masked")


def pool_all(tokens: DataFrame, strategies=STRATEGIES, id_col: str = "id") -> DataFrame:
    """H1: (id, pos, mask, vec) → id and one pooled vector for each strategy, in one aggregation.

    cls = vector at the smallest position; mean / max over all positions
    (padding included); masked = Σ mask·v / max(Σ mask, 1e-9).
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer
    unknown = set(strategies) - set(STRATEGIES)
    if unknown:
        raise ValueError(f"unknown strategies {sorted(unknown)}")
    t = tokens.filter(F.col("vec").isNotNull())
    t = t.select(id_col, "pos", "mask", "vec", array_to_vector("vec").alias("_v"),
                 array_to_vector(F.transform("vec", lambda x: x * F.col("mask"))).alias("_m"))
    aggs = {"cls": F.min_by("vec", "pos"), "mean": Summarizer.mean(F.col("_v")), "max": Summarizer.max(F.col("_v")),
            "masked": Summarizer.sum(F.col("_m"))}
    g = t.groupBy(id_col).agg(*[aggs[s].alias(s) for s in strategies], F.sum("mask").cast("double").alias("_mask"))
    weight = F.greatest(F.col("_mask"), F.lit(1e-9))
    arrays = {s: F.col(s) if s == "cls" else vector_to_array(s) for s in strategies}
    g = g.select(id_col, "_mask", *[arrays[s].alias(s) for s in strategies])
    return g.select(id_col, *[(F.transform(s, lambda x: x / weight) if s == "masked" else F.col(s)).alias(s) for s in strategies])


def pool_tokens(tokens: DataFrame, how: str = "mean", id_col: str = "id") -> DataFrame:
    """H1 for one strategy: id, pooled."""
    return pool_all(tokens, (how,), id_col).withColumnRenamed(how, "pooled")


def compare_pooling(tokens: DataFrame, strategies=STRATEGIES, id_col: str = "id") -> DataFrame:
    """H2: per strategy pair, mean / pop-std / min / max of the per-row cosine."""
    pooled = pool_all(tokens, strategies, id_col)
    pairs = [(a, b) for i, a in enumerate(strategies) for b in strategies[i + 1:]]
    cos = F.array(*[F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), (dot(a, b) / (norm(a) * norm(b))).alias("cos")) for a, b in pairs])
    allp = pooled.select(F.inline_outer(cos)).filter(F.col("pair").isNotNull())
    return allp.groupBy("pair").agg(F.avg("cos").alias("mean"), F.stddev_pop("cos").alias("std"),
                                    F.min("cos").alias("min"), F.max("cos").alias("max"))


def embedding_stats(vectors: DataFrame, vec_col: str = "vec") -> DataFrame:
    """H3: global mean / pop-std / min / max of all components; norm mean / pop-std."""
    s = vector_summary(vectors, [], vec_col, "mean", "variance", "min", "max")
    mean = _array_sum("mean") / F.size("mean")
    # Σ x² of a dimension over n rows: (n − 1)/n · variance + mean²
    square = _array_sum(F.zip_with("variance", "mean", lambda v, m: v * (F.col("count") - 1) / F.col("count") + m * m)) / F.size("mean")
    a = s.select(mean.alias("mean"), F.sqrt(F.greatest(square - mean * mean, F.lit(0.0))).alias("std"),
                 F.array_min("min").alias("min"), F.array_max("max").alias("max"))
    n = vectors.select(norm(vec_col).alias("n")).agg(F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"))
    return a.join(n)


def dim_stats(vectors: DataFrame, vec_col: str = "vec") -> DataFrame:
    """H4: mean and pop-std per dimension."""
    s = vector_summary(vectors, [], vec_col, "mean", "variance")
    per = F.zip_with("mean", "variance", lambda m, v: F.struct(m.alias("mean"), pop_std(v, F.col("count")).alias("std")))
    return s.select(F.posexplode(per).alias("dim", "_x")).select("dim", "_x.mean", "_x.std")  # one row a dimension


def norm_histogram(vectors: DataFrame, bins: int, label_col: str | None = None, vec_col: str = "vec") -> DataFrame:
    """H4 / H8: vectors by norm in ``bins`` equal ranges between the least and the greatest norm (of a label).
    Norms are grouped before they meet the label's range, so a label's rows never meet on one key."""
    from nazar.operators.labels import equal_width_bins
    keys = [label_col] if label_col else []
    return equal_width_bins(vectors, norm(vec_col), bins, keys or None).select(*keys, "bin", "n")


def dim_correlation(vectors: DataFrame, n_dims: int = 50, vec_col: str = "vec") -> DataFrame:
    """H5: Pearson correlation of the first n_dims dimensions (pyspark.ml
    Correlation: one distributed pass, n_dims² values on the driver)."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Correlation
    v = vectors.select(array_to_vector(F.slice(vec_col, 1, n_dims)).alias("f"))
    m = Correlation.corr(v, "f").first()[0].toArray()
    spark = vectors.sparkSession
    rows = [(i, j, float(m[i, j])) for i in range(m.shape[0]) for j in range(i + 1, m.shape[1])]
    return spark.createDataFrame(rows, "dim_a int, dim_b int, corr double")


def pair_similarity_stats(vectors: DataFrame, reference: DataFrame | None = None, key_col: str = "word",
                          vec_col: str = "vec") -> DataFrame:
    """H7: off-diagonal cosine statistics of the rows (n_pairs, mean, std, min, max); no pair
    becomes a row.

    Mean and std come from Gram sums, one pass.  For the extremes the unit sphere is cut into
    cells around some of the vectors; two cells' angle and radii bound the cosines between them,
    and cells meet, block by block in numpy, only where the bounds could beat the pairs of
    vectors and cell centres, which are known.  Where no bound helps, all cells meet: the exact
    fallback.  With a ``reference`` other than the rows, all rows meet, pairs of equal keys left out.
    """
    if reference is not None:
        return _pair_stats_all(vectors.select(key_col, vec_col), reference.select(key_col, vec_col), key_col, vec_col)
    ensure_checkpoint_dir(vectors.sparkSession)
    rows = vectors.filter(F.col(vec_col).isNotNull()).select(F.monotonically_increasing_id().alias("_uid"), F.col(vec_col).alias("vec")).checkpoint()
    sums = gram_sums(rows, None, "vec")
    mean, ex2 = _pair_moments(F.col("n"), F.col("total"), F.col("gram"))
    moments = sums.select("n", F.when(F.col("n") > 1, mean).alias("mean"), F.when(F.col("n") > 1, ex2).alias("_q")).first()
    n = moments.n if moments else 0
    lo, hi = _extreme_cosines(rows, n) if n > 1 else (None, None)
    out = (n * (n - 1), moments.mean, float(np.sqrt(max(moments._q - moments.mean ** 2, 0.0))), lo, hi) if n > 1 else (0, None, None, None, None)
    return vectors.sparkSession.createDataFrame([out], "n_pairs long, mean double, std double, min double, max double")


def _unit_rows(vecs) -> np.ndarray:
    x = np.vstack(vecs.to_numpy()).astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cells_that_meet(centres: np.ndarray, radius: np.ndarray, low: float, high: float) -> list[tuple[int, int]]:
    """Pairs of cells (i ≤ j) of unit vectors within an angle ``radius`` of their centre that may
    hold a cosine below ``low`` or above ``high``."""
    angle = np.arccos(np.clip(centres @ centres.T, -1.0, 1.0))
    reach = radius[:, None] + radius[None]
    most = np.cos(np.maximum(angle - reach, 0.0))
    least = np.cos(np.minimum(angle + reach, np.pi))
    i, j = np.nonzero((most > high - 1e-12) | (least < low + 1e-12))
    return [(int(a), int(b)) for a, b in zip(i, j, strict=True) if a <= b]


def _extreme_cosines(rows: DataFrame, n: int) -> tuple[float, float]:
    """The least and the greatest cosine of two of the rows (_uid, vec)."""
    spark = rows.sparkSession
    n_cells = min(MAX_CELLS, -(-n // BLOCK_ROWS))
    some = rows.orderBy(F.xxhash64(F.lit(1), "_uid")).limit(n_cells).toPandas()
    uids, centres = some["_uid"].to_numpy(), _unit_rows(some["vec"])
    shared = spark.sparkContext.broadcast((uids, centres))

    def dealt(batches):
        uids, centres = shared.value
        for pdf in batches:
            if len(pdf):
                c = _unit_rows(pdf["vec"]) @ centres.T
                cell = c.argmax(axis=1)
                near = c[np.arange(len(c)), cell]
                other = pdf["_uid"].to_numpy()[:, None] != uids[None]
                yield pd.DataFrame({"_uid": pdf["_uid"], "vec": pdf["vec"], "cell": cell.astype(np.int32), "angle": np.arccos(np.clip(near, -1.0, 1.0)),
                                    "lo": np.where(other, c, np.inf).min(axis=1), "hi": np.where(other, c, -np.inf).max(axis=1)})

    cells = rows.mapInPandas(dealt, "_uid long, vec array<double>, cell int, angle double, lo double, hi double").checkpoint()
    per = cells.groupBy("cell").agg(F.max("angle").alias("angle"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.count("*").alias("n")).toPandas()
    radius, blocks = np.zeros(len(uids)), np.zeros(len(uids), dtype=int)
    radius[per["cell"]], blocks[per["cell"]] = per["angle"], -(-per["n"].to_numpy() // BLOCK_ROWS)
    low, high = float(per["lo"].min()), float(per["hi"].max())
    pairs = [(i, j, int(blocks[i]), int(blocks[j])) for i, j in cells_that_meet(centres, radius, low, high) if blocks[i] and blocks[j]]
    if pairs:
        met = F.broadcast(spark.createDataFrame(pairs, "a int, b int, na int, nb int"))  # at most MAX_CELLS² rows
        at = lambda of: F.pmod(F.xxhash64("_uid"), F.col(of)).cast("int")
        each = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
        left = cells.join(met, F.col("cell") == F.col("a")).select("_uid", "vec", "a", "b", F.lit(0).alias("_role"), at("na").alias("i"), each("nb").alias("j"))
        right = cells.join(met, F.col("cell") == F.col("b")).select("_uid", "vec", "a", "b", F.lit(1).alias("_role"), at("nb").alias("j"), each("na").alias("i"))

        def extremes(pdf: pd.DataFrame) -> pd.DataFrame:
            x, y, xv, yv = _sides(pdf, "vec")
            if xv is None or yv is None:
                return pd.DataFrame({"lo": [], "hi": []})
            xv, yv = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (xv, yv))
            c = xv @ yv.T
            other = x["_uid"].to_numpy()[:, None] != y["_uid"].to_numpy()[None]
            return pd.DataFrame({"lo": [np.where(other, c, np.inf).min()], "hi": [np.where(other, c, -np.inf).max()]})

        found = left.unionByName(right).groupBy("a", "b", "i", "j").applyInPandas(extremes, "lo double, hi double").agg(F.min("lo"), F.max("hi")).first()
        low, high = min(low, found[0]), max(high, found[1])
    return low, high


def _pair_stats_all(rows: DataFrame, ref: DataFrame, key_col: str, vec_col: str) -> DataFrame:
    """Every row with every reference row, block by block; pairs of equal keys are left out."""
    def stats(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_role", key_col], kind="stable")
        x, y, xv, yv = _sides(pdf, vec_col)
        out = []
        if len(x) and len(y):
            xv, yv = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (xv, yv))
            xi, yi = x[key_col].to_numpy(), y[key_col].to_numpy()
            step = max(1, CHUNK // len(y))
            for lo in range(0, len(x), step):
                v = (xv[lo:lo + step] @ yv.T)[xi[lo:lo + step, None] != yi[None, :]]
                if v.size:
                    out.append((int(v.size), float(v.sum()), float((v * v).sum()), float(v.min()), float(v.max())))
        return pd.DataFrame(out, columns=["n", "s", "q", "mn", "mx"])

    parts = _met(rows, ref, key_col).applyInPandas(stats, "n long, s double, q double, mn double, mx double")
    a = parts.agg(F.sum("n").alias("n_pairs"), F.sum("s").alias("_s"), F.sum("q").alias("_q"),
                  F.min("mn").alias("min"), F.max("mx").alias("max"))
    mean = F.col("_s") / F.col("n_pairs")
    return a.select("n_pairs", mean.alias("mean"),
                    F.sqrt(F.greatest(F.col("_q") / F.col("n_pairs") - mean * mean, F.lit(0.0))).alias("std"),
                    "min", "max")


def label_centroids(vectors: DataFrame, label_col: str = "grp", vec_col: str = "vec") -> DataFrame:
    """H8: per label count, norm mean / pop-std and centroid vector."""
    cen = vector_summary(vectors, [label_col], vec_col, "mean").select(label_col, F.col("mean").alias("centroid"))
    st = vectors.select(label_col, norm(vec_col).alias("n")).groupBy(label_col).agg(
        F.count(F.lit(1)).alias("count"), F.avg("n").alias("norm_mean"), F.stddev_pop("n").alias("norm_std"))
    return st.join(cen, label_col)


def centroid_distances(centroids: DataFrame, label_col: str = "grp") -> DataFrame:
    """H8: Euclidean distance between every pair of label centroids (K labels →
    K(K−1)/2 rows; the centroid table has one row per label, size-checked)."""
    a = centroids.select(F.col(label_col).alias("l1"), F.col("centroid").alias("c1"))
    b = broadcast_lexicon(centroids.select(F.col(label_col).alias("l2"), F.col("centroid").alias("c2")),
                          limit=min(BROADCAST_ROW_LIMIT, 10_000))
    j = a.join(b, F.col("l1") < F.col("l2"))
    d = F.sqrt(F.aggregate(F.zip_with("c1", "c2", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x))
    return j.select("l1", "l2", d.alias("distance"))
