"""Language ID by multilingual mixture inference.

Each language has a model of byte trigrams (third byte given the two before, word by word).
Every word of a text then has a likelihood under each language, and expectation-maximisation
finds the text's language proportions.  The language set is chosen by penalised likelihood:
the EM runs again on the text's k strongest languages for k = 1, 2, ... until the
log-likelihood less PENALTY * k * log(words) falls; the last set before stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nazar.llm import tables, tokens

#: Expected distinct texts of the training sample for each language (all, if it has fewer).
TRAIN_ROWS = 2_000
#: Slots of the hashed trigram tables.
SLOTS = 1 << 18
SMOOTH = 0.05
FIRST_ROUNDS, ROUNDS = 8, 4
PENALTY = 1.0
UNKNOWN = "und"


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(trigram slot, context, word index) of each byte in a word or right after it, with
    (text index) of each word and the words' number of grams."""
    rows = len(offsets) - 1
    size = np.diff(offsets)
    # a separator after every text
    place = np.arange(len(data)) + np.repeat(np.arange(rows), size)
    x = np.zeros(len(data) + rows, dtype=np.uint8)
    x[place] = data
    t = tokens._tables()
    upper = (x >= 65) & (x <= 90)
    x = np.where(upper, x + 32, x)
    x[~t["word"][x]] = 0
    before = np.zeros_like(x)
    before[1:] = x[:-1]
    second = np.zeros_like(x)
    second[2:] = x[:-2]
    second[before == 0] = 0
    used = np.flatnonzero((x > 0) | (before > 0))
    a, b, c = second[used].astype(np.uint32), before[used].astype(np.uint32), x[used].astype(np.uint32)
    context = (a << 8) | b
    slot = ((((context << 8) | c) * np.uint32(2654435761)) >> np.uint32(32 - 18)).astype(np.int64)
    opens = b == 0
    starts = np.flatnonzero(opens)
    ends = offsets[1:] + np.arange(1, rows + 1)
    text = np.searchsorted(ends, used[starts], "right")
    return slot, context.astype(np.int64), starts, text, np.diff(np.append(starts, len(used)))


def count_grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Trigram slots and contexts of whole texts, counted."""
    slots, contexts = np.zeros(SLOTS, np.int64), np.zeros(1 << 16, np.int64)
    for _, data, offsets in tokens.text_slices(texts):
        if len(data):
            s, c, *_ = grams(data, offsets)
            slots += np.bincount(s, minlength=SLOTS)
            contexts += np.bincount(c, minlength=1 << 16)
    return slots, contexts


class Model:
    """Log-probabilities of the trigrams under each language."""

    def __init__(self, langs: list[str], slots: list[np.ndarray], contexts: list[np.ndarray]):
        self.langs = langs
        self.up = [np.log(s + SMOOTH).astype(np.float32) for s in slots]
        self.down = [np.log(c + SMOOTH * 256).astype(np.float32) for c in contexts]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(log-likelihood of each word under each language, text index of each word)."""
        slot, context, starts, text, _ = grams(data, offsets)
        if not len(starts):
            return np.zeros((len(self.langs), 0), np.float32), text
        return np.stack([np.add.reduceat(u[slot] - d[context], starts) for u, d in zip(self.up, self.down, strict=True)]), text

    def infer(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(proportions of the chosen set: texts x languages, its size); texts without a word have size 0."""
        rows, n_lang = len(offsets) - 1, len(self.langs)
        share, size = np.zeros((rows, n_lang)), np.zeros(rows, dtype=np.int64)
        ll, text = self.words(data, offsets)
        if not len(text):
            return share, size
        own, first, many = np.unique(text, return_index=True, return_counts=True)
        top = ll.max(axis=0)
        like = np.exp(np.maximum(ll - top, -60)).astype(np.float32)
        rep = np.repeat(np.arange(len(own)), many)
        base = np.add.reduceat(top.astype(np.float64), first)

        def em(pi: np.ndarray, rounds: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """(proportions, log-likelihood) of the texts ``of``, each for itself."""
            pi = pi.astype(np.float32)
            some = like if len(of) == len(own) else like[:, np.isin(rep, of)]
            n = many[of]
            at, begin = np.repeat(np.arange(len(of)), n), np.cumsum(n) - n
            for _ in range(rounds):
                part = pi[:, at] * some
                total = np.maximum(part.sum(axis=0), 1e-30)
                pi = np.add.reduceat(part / total, begin, axis=1) / n
                pi = pi.astype(np.float32)
            total = np.maximum((pi[:, at] * some).sum(axis=0), 1e-30)
            return pi, np.add.reduceat(np.log(total).astype(np.float64), begin) + base[of]

        pi, _ = em(np.full((n_lang, len(own)), 1 / n_lang), FIRST_ROUNDS, np.arange(len(own)))
        place = np.argsort(np.argsort(-pi, axis=0, kind="stable"), axis=0, kind="stable")
        best, best_pi, best_k = np.full(len(own), -np.inf), pi.copy(), np.zeros(len(own), dtype=np.int64)
        of = np.arange(len(own))  # the texts whose value has not fallen yet
        for k in range(1, n_lang + 1):
            held = np.where(place[:, of] < k, np.maximum(pi[:, of], 1e-4), 0)
            got, logl = em(held / held.sum(axis=0), ROUNDS if k > 1 else 1, of)
            value = logl - PENALTY * k * np.log(many[of] + 1)
            better = value > best[of]
            of, got = of[better], got[:, better]
            best[of], best_pi[:, of], best_k[of] = value[better], got, k
            if not len(of):
                break
        share[own], size[own] = best_pi.T, best_k
        return share, size


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Fit on rows with text and lang.  For each language at most about ``rows`` texts, chosen by
    a hash of the text, are counted in one group, a text once however often it is repeated; the
    driver gets one pair of tables a language."""
    known = docs.where("lang is not null and text is not null").select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["texts"] for r in known.groupBy("lang").agg(F.countDistinct("h").alias("texts")).collect()}
    if not counts:
        return Model([], [], [])
    rate = F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, rows / n)])
    sample = known.where((F.pmod("h", F.lit(1 << 20)) / F.lit(float(1 << 20))) < rate[F.col("lang")])

    def count(group: pa.Table) -> pa.Table:
        s, c = count_grams(group.column("text"))
        return pa.table({"lang": group.column("lang")[:1], "s": [s.astype("<i8").tobytes()], "c": [c.astype("<i8").tobytes()]})

    got = sorted(sample.select("lang", "text").distinct().groupBy("lang").applyInArrow(count, "lang string, s binary, c binary").collect())
    return Model([r["lang"] for r in got], [np.frombuffer(r["s"], "<i8") for r in got], [np.frombuffer(r["c"], "<i8") for r in got])


def predict_batch(col: pa.Array, model: Model) -> tuple[list, list, list]:
    """(language, its share, the chosen set with shares) of each text of an Arrow batch."""
    letters = pc.fill_null(pc.match_substring_regex(col, r"\pL"), False).to_pylist()
    langs, scores, sets = [], [], []
    for first, data, offsets in tokens.text_slices(col):
        rows = len(offsets) - 1
        share, size = model.infer(data, offsets) if model.langs else (np.zeros((rows, 0)), np.zeros(rows, int))
        for r in range(rows):
            if not size[r] or not letters[len(langs)]:
                langs.append(UNKNOWN)
                scores.append(0.0)
                sets.append([])
                continue
            order = np.argsort(-share[r], kind="stable")[:size[r]]
            langs.append(model.langs[order[0]])
            scores.append(float(min(1.0, share[r][order[0]])))
            sets.append([{"lang": model.langs[i], "share": float(share[r][i])} for i in order])
    return langs, scores, sets


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred (UNKNOWN for a null text, or one without a letter), score (share
    of that language) and languages (the chosen set with shares); columns of ``docs`` with
    such names are replaced.  Every row is predicted on its own whole text."""
    spark = docs.sparkSession
    tables.small_batches(spark)
    new = ["lang_pred", "score", "languages"]
    kept = docs.select(*[c for c in docs.columns if c.lower() not in new])
    text_at = kept.columns.index("text")
    schema = StructType([*kept.schema, *StructType.fromDDL("lang_pred string, score double, languages array<struct<lang:string,share:double>>")])
    shared = spark.sparkContext.broadcast(model)
    set_type = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores, sets = predict_batch(batch.column(text_at), shared.value)
            added = [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(sets, set_type)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *new])

    return tables.spread_out(kept).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the ids that no model may learn from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out()).select("lang", "text"))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def known_language(docs: DataFrame) -> DataFrame:
    """The documents with a language (not UNKNOWN), rows and columns as they came.  The model
    is fitted on the documents' own lang column."""
    spark = docs.sparkSession
    tables.small_batches(spark)
    shared = spark.sparkContext.broadcast(fit(docs.select("lang", "text")))
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, _, _ = predict_batch(batch.column(text_at), shared.value)
            yield batch.filter(pa.array([x != UNKNOWN for x in langs], pa.bool_()))

    return tables.spread_out(docs).mapInArrow(run, docs.schema)
