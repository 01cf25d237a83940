"""Quality classifier by positive-unlabelled learning.

Trusted positives (label 1) and unlabelled web text, with an estimated class prior, train a
linear scorer by the non-negative unbiased risk: pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1))
with the logistic loss; where the second part is negative, its gradient is followed backwards.
Features are shares of byte-class pairs, repetition and word shape of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nazar.llm import tables, tokens

#: Rows (expected) of the bounded training samples: trusted positives, and unlabelled texts.
POSITIVES, UNLABELLED = 4_000, 6_000
ROUNDS, RATE, RIDGE = 250, 0.05, 1e-4
#: Single-byte classes beside letters, digits, blanks and non-ASCII.
SIGNS = ".,!?;:'\"|$&%*#@-_/()<>=+~^[]{}\\`"


def _classes() -> tuple[np.ndarray, int]:
    c = np.zeros(256, dtype=np.int64)
    c[48:58], c[65:91], c[97:123], c[128:] = 1, 2, 3, 4
    c[32], c[10], c[9], c[13] = 5, 6, 5, 6
    for i, s in enumerate(SIGNS):
        c[ord(s)] = 7 + i
    return c, 7 + len(SIGNS)


CLASS, N_CLASS = _classes()
EXTRA = 5
WIDTH = N_CLASS * N_CLASS + EXTRA


def features(col: pa.Array) -> np.ndarray:
    """One row of WIDTH features a text; an empty or null text has zeros."""
    out = []
    for _, data, offsets in tokens.text_slices(col):
        rows = len(offsets) - 1
        x = np.zeros((rows, WIDTH), dtype=np.float32)
        size = np.diff(offsets)
        hashes, text, starts = tokens.words(data, offsets)
        shingle, of = tokens.shingles(hashes, text, rows)
        n_words = np.bincount(text, minlength=rows)
        n_shingles = np.bincount(of, minlength=rows)
        order = np.lexsort((shingle, of))
        s, o = shingle[order], of[order]
        fresh = np.ones(len(s), dtype=bool)
        fresh[1:] = (s[1:] != s[:-1]) | (o[1:] != o[:-1])
        distinct = np.bincount(o[fresh], minlength=rows)
        cls = CLASS[data]
        pair = cls[:-1] * N_CLASS + cls[1:]
        for r in range(rows):
            if size[r] > 1:
                p = pair[offsets[r]:offsets[r + 1] - 1]
                x[r, :-EXTRA] = np.sqrt(np.bincount(p, minlength=N_CLASS * N_CLASS) / len(p))
        some = size > 0
        x[some, -5] = np.log1p(size[some]) / 10
        x[some, -4] = np.log1p(n_words[some]) / 10
        x[some, -3] = (1 - distinct / np.maximum(n_shingles, 1))[some]
        x[some, -2] = (n_words / np.maximum(size, 1))[some]
        x[some, -1] = 1.0
        out.append(x)
    return np.concatenate(out) if out else np.zeros((0, WIDTH), np.float32)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_nnpu(x_pos: np.ndarray, x_un: np.ndarray, prior: float, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """(weights, bias) by Adam on the non-negative unbiased risk; all zeros without both samples."""
    full = np.zeros(x_pos.shape[1])
    if not len(x_pos) or not len(x_un):
        return full, 0.0
    spread = np.concatenate([x_pos, x_un]).std(axis=0)
    used = np.flatnonzero(spread > 1e-4)
    scale = (spread[used] + 0.02).astype(np.float32)
    xp, xu = x_pos[:, used] / scale, x_un[:, used] / scale
    w = np.zeros(len(used) + 1, dtype=np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        fp, fu = xp @ w[:-1] + w[-1], xu @ w[:-1] + w[-1]
        # logistic loss l(z) = log(1 + exp(-z)); gradients by the score
        neg = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        g_pos = -prior * sigmoid(-fp) / len(fp)
        g_un = sigmoid(fu) / len(fu)
        g_back = -prior * sigmoid(fp) / len(fp)
        if neg >= 0:
            gp, gu = g_pos + g_back, g_un
        else:
            gp, gu = -g_back, -g_un
        g = np.append(gp.astype(np.float32) @ xp + gu.astype(np.float32) @ xu, np.float32(gp.sum() + gu.sum()))
        g[:-1] += np.float32(RIDGE) * w[:-1]
        m, v = np.float32(0.9) * m + np.float32(0.1) * g, np.float32(0.999) * v + np.float32(0.001) * g * g
        w -= np.float32(RATE * (1 - t / (rounds + 1))) * (m / np.float32(1 - 0.9 ** t)) / (np.sqrt(v / np.float32(1 - 0.999 ** t)) + np.float32(1e-8))
    full[used] = w[:-1] / scale
    return full, float(w[-1])


def held_out(doc_id: str = "doc_id"):
    """True for the third of the ids whose labels no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 == 1, F.lit(False))


def _share(rows: int, of: int):
    return F.pmod(F.xxhash64(F.lit(41), "text"), F.lit(1 << 20)) < F.lit((1 << 20) * min(1.0, rows / max(1, of)))


def learn(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    """Fit on documents outside the held-out fold: positives are those labelled 1, unlabelled are
    all, whatever their label.  The prior is the share of 1 among the fold's labelled rows.
    One group holds the two bounded samples of distinct texts; the driver gets the weights."""
    tables.small_batches(docs.sparkSession)
    src = docs.where(~held_out()).select("doc_id", "text")
    known = labels.where(~held_out() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    n_pos, n_known = known.agg(F.sum((F.col("quality") == 1).cast("long")), F.count("*")).first()
    hashed = src.select("doc_id", F.xxhash64("text").alias("h"))
    n_docs = hashed.agg(F.countDistinct("h")).first()[0]
    if not n_pos or not n_docs:
        return np.zeros(WIDTH), 0.0
    prior = min(0.99, n_pos / n_known)
    n_pos = hashed.join(known.where("quality = 1").select("doc_id"), "doc_id").agg(F.countDistinct("h")).first()[0]
    src = src.where(_share(POSITIVES, n_pos) | _share(UNLABELLED, n_docs))
    sample = src.join(known, "doc_id", "left").select(
        "text", ((F.col("quality") == 1) & _share(POSITIVES, n_pos)).alias("pos"), _share(UNLABELLED, n_docs).alias("un"))

    sample = sample.where("pos or un").groupBy("text").agg(F.max("pos").alias("pos"), F.max("un").alias("un"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f2").tobytes() for r in x], pa.binary()), b.column(1), b.column(2)], names=["x", "pos", "un"])

    def fit(group: pa.Table) -> pa.Table:
        x = np.frombuffer(b"".join(group.column("x").to_pylist()), "<f2").reshape(-1, WIDTH).astype(np.float32)
        order = np.lexsort(x[:, -5:].T)  # the same sums on every run
        x = x[order]
        pos = np.array([bool(v) for v in group.column("pos").to_pylist()])[order]
        un = np.array([bool(v) for v in group.column("un").to_pylist()])[order]
        w, bias = fit_nnpu(x[pos], x[un], prior)
        return pa.table({"w": [np.append(w, bias).astype("<f8").tobytes()]})

    rows = sample.mapInArrow(run, "x binary, pos boolean, un boolean")
    got = rows.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "w binary").collect()
    w = np.frombuffer(got[0].w, "<f8") if got else np.zeros(WIDTH + 1)
    return w[:-1].copy(), float(w[-1])


def scan(docs: DataFrame, model: tuple[np.ndarray, float]) -> DataFrame:
    """doc_id, score (0 to 1), predicted: one row a document, each from its own whole text.  Null
    and empty texts get the score of a text without features."""
    spark = docs.sparkSession
    tables.small_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, bias = shared.value
        for b in batches:
            score = sigmoid(features(b.column(1)) @ w + bias)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64()), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return tables.spread_out(src).mapInArrow(run, "doc_id long, score double, predicted int")


def op7(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = learn(docs, tables.table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scan(docs, model).select("doc_id", held_out().alias("held_out"), "score", "predicted")
