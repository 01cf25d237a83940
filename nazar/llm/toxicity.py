"""Toxicity by cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - theta_k) with one weight vector for all ordered thresholds.  The
features are the words of a text and the first bytes of its words, hashed.  Labels mark toxic
or not; toxic training texts are graded 1 to 3 by thirds of the number of their features that
speak for toxicity in the training sample.  The output is the expected grade.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nazar.llm import tables, tokens

#: Rows (expected) of the bounded training samples of each side of the label.
TRAIN_ROWS = 6_000
SLOTS = 1 << 20
PREFIXES = (4, 5)
GRADES = 3
#: Training texts in which a feature must occur, and the deviations and the factor by which it must lean to the toxic side.
MIN_TEXTS, MIN_Z, MIN_LIFT = 20, 5.0, 5.0
ROUNDS, RATE, RIDGE = 300, 0.2, 2e-3
#: P(grade > 0) from which a text counts as toxic.
LEVEL = 0.25


def text_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature slot, text index) of the distinct features of each text."""
    hashes, text, starts = tokens.words(data, offsets)
    value = tokens._tables()["value"]
    slots = [(hashes & np.uint64(SLOTS - 1)).astype(np.int64)]
    texts = [text]
    for k in PREFIXES:
        h, whole = np.full(len(starts), k, dtype=np.uint64), np.ones(len(starts), dtype=bool)
        for i in range(k):
            at = np.minimum(starts + i, len(data) - 1)
            v = value[data[at]]
            whole &= (v > 0) & (starts + i < offsets[text + 1])
            h = (h ^ v) * np.uint64(0x100000001B3)
        slots.append((tokens.mix(h[whole]) & np.uint64(SLOTS - 1)).astype(np.int64))
        texts.append(text[whole])
    key = np.unique(np.concatenate(texts) * SLOTS + np.concatenate(slots)) if len(starts) else np.zeros(0, np.int64)
    return key % SLOTS, key // SLOTS


class Ordinal:
    """Weights of the kept features and the ordered thresholds."""

    def __init__(self, slots: np.ndarray, weights: np.ndarray, thetas: np.ndarray):
        self.slots, self.weights, self.thetas = slots, weights, thetas
        self.dense = np.zeros(SLOTS, dtype=np.float32)
        self.dense[slots] = weights

    def grades(self, z: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k: scores x thresholds."""
        return 1 / (1 + np.exp(-np.clip(z[:, None] - self.thetas[None, :], -30, 30)))


def fit_ordinal(slot: np.ndarray, text: np.ndarray, grade: np.ndarray, k: int = GRADES) -> tuple[np.ndarray, np.ndarray]:
    """(weights by slot 0..max, thresholds) of the cumulative-link model, by Adam."""
    n, width = len(grade), int(slot.max(initial=-1)) + 1
    share = [min(0.99, max(0.01, (grade > j).mean())) for j in range(k)]
    theta = np.log((1 - np.array(share)) / np.array(share))
    gap = np.log(np.maximum(np.diff(theta), 0.05))
    par = np.concatenate([np.zeros(width), theta[:1], gap])
    m, v = np.zeros_like(par), np.zeros_like(par)
    rows = np.arange(n)
    for t in range(1, ROUNDS + 1):
        cut = par[width] + np.concatenate([[0], np.cumsum(np.exp(par[width + 1:]))])
        z = np.bincount(text, weights=par[slot], minlength=n)
        s = 1 / (1 + np.exp(-np.clip(z[:, None] - cut[None, :], -30, 30)))
        upper = np.column_stack([np.ones(n), s])  # P(grade > j - 1)
        lower = np.column_stack([s, np.zeros(n)])
        p = np.maximum((upper - lower)[rows, grade], 1e-9)
        up, low = upper[rows, grade], lower[rows, grade]
        d_up, d_low = np.where(grade > 0, up * (1 - up), 0), np.where(grade < k, low * (1 - low), 0)
        g_z = -(d_up - d_low) / p / n
        g_cut = np.zeros(k)
        np.add.at(g_cut, np.maximum(grade - 1, 0)[grade > 0], (d_up / p / n)[grade > 0])
        np.add.at(g_cut, np.minimum(grade, k - 1)[grade < k], (-d_low / p / n)[grade < k])
        after = g_cut[::-1].cumsum()[::-1]
        g = np.concatenate([np.bincount(slot, weights=g_z[text], minlength=width) + RIDGE * par[:width] / 10, after[:1], after[1:] * np.exp(par[width + 1:])])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        par -= RATE * (1 - t / (ROUNDS + 1)) * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-8)
    return par[:width], par[width] + np.concatenate([[0], np.cumsum(np.exp(par[width + 1:]))])


def fit_sample(texts: pa.Array, toxic: np.ndarray) -> Ordinal:
    """Select features, grade the toxic texts and fit.  Without both sides no text is toxic."""
    slot, text, base = [], [], 0
    for _, data, offsets in tokens.text_slices(texts):
        s, t = text_features(data, offsets)
        slot.append(s)
        text.append(t + base)
        base += len(offsets) - 1
    none = Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, 30.0))
    if not toxic.any() or toxic.all() or not slot:
        return none
    slot, text = np.concatenate(slot), np.concatenate(text)
    pos = np.bincount(slot[toxic[text]], minlength=SLOTS)
    neg = np.bincount(slot[~toxic[text]], minlength=SLOTS)
    n_pos, n_neg = toxic.sum(), (~toxic).sum()
    p = (pos + neg) / (n_pos + n_neg)
    z = (pos / n_pos - neg / n_neg) / np.sqrt(np.maximum(p * (1 - p), 1e-9) * (1 / n_pos + 1 / n_neg))
    # features that speak against toxicity would only tell long texts from short ones
    kept = np.flatnonzero((pos + neg >= MIN_TEXTS) & (z >= MIN_Z) & (pos / n_pos > MIN_LIFT * neg / n_neg))
    if not len(kept):
        return none
    strong = np.zeros(SLOTS, dtype=bool)
    strong[kept] = True
    held = np.bincount(text[strong[slot]], minlength=base)
    cuts = np.quantile(held[toxic], [1 / 3, 2 / 3])
    grade = np.where(toxic, 1 + (held > cuts[0]).astype(int) + (held > cuts[1]).astype(int), 0)
    place = np.full(SLOTS, -1)
    place[kept] = np.arange(len(kept))
    use = place[slot] >= 0
    weights, thetas = fit_ordinal(place[slot[use]], text[use], grade)
    full = np.zeros(len(kept))
    full[:len(weights)] = weights
    return Ordinal(kept, full, thetas)


def learn(docs: DataFrame, labels: DataFrame) -> Ordinal:
    """Fit on a bounded sample of both sides of labels.toxic, in one group."""
    tables.small_batches(docs.sparkSession)
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic == 1: r["count"] for r in known.groupBy((F.col("toxic") == 1).cast("int").alias("toxic")).count().collect()}
    rate = F.when(F.col("toxic") == 1, F.lit(TRAIN_ROWS / max(1, sizes.get(True, 0)))).otherwise(F.lit(TRAIN_ROWS / max(1, sizes.get(False, 0))))
    some = known.where(F.pmod(F.xxhash64(F.lit(43), "doc_id"), F.lit(1 << 20)) < F.lit(1 << 20) * rate)
    sample = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where("text is not null")  # at most two bounded samples

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("doc_id").combine_chunks()
        model = fit_sample(group.column("text"), np.array(group.column("toxic").to_pylist()) == 1)
        return pa.table({"slots": [model.slots.astype("<i8").tobytes()], "weights": [model.weights.astype("<f8").tobytes()], "thetas": [model.thetas.astype("<f8").tobytes()]})

    got = sample.withColumn("one", F.lit(0)).groupBy("one").applyInArrow(fit, "slots binary, weights binary, thetas binary").collect()
    if not got:
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(GRADES, 30.0))
    return Ordinal(*[np.frombuffer(got[0][k], t) for k, t in (("slots", "<i8"), ("weights", "<f8"), ("thetas", "<f8"))])


def scan(docs: DataFrame, model: Ordinal) -> DataFrame:
    """doc_id, severity (expected grade), p_toxic (of a grade above 0), grade (the likeliest),
    toxic (p_toxic of LEVEL or more): one row a document, from its whole text.  Null and empty
    texts have no features."""
    spark = docs.sparkSession
    tables.small_batches(spark)
    shared = spark.sparkContext.broadcast((model.slots, model.weights, model.thetas))
    held: list[Ordinal] = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held[0] if held else Ordinal(*shared.value)
        for b in batches:
            above = []
            for _, data, offsets in tokens.text_slices(b.column(1)):
                slot, text = text_features(data, offsets)
                z = np.bincount(text, weights=model.dense[slot], minlength=len(offsets) - 1)
                above.append(model.grades(z))
            s = np.concatenate(above) if above else np.zeros((0, len(model.thetas)))
            each = np.column_stack([np.ones(len(s)), s]) - np.column_stack([s, np.zeros(len(s))])
            cols = [b.column(0), pa.array(s.sum(axis=1)), pa.array(s[:, 0]), pa.array(each.argmax(axis=1).astype(np.int32)), pa.array(s[:, 0] >= LEVEL)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "severity", "p_toxic", "grade", "toxic"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return tables.spread_out(src).mapInArrow(run, "doc_id long, severity double, p_toxic double, grade int, toxic boolean")


def op6(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, learn(docs, tables.table(spark, sf_dir, "labels").select("doc_id", "toxic")))
