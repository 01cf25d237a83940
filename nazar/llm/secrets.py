"""Secret scans: fixed rules, and character Markov models compared by log-likelihood ratio.

Two order-2 character models are counted over the distinct sample tokens of all texts: values
of the fixed rules are random strings, other long tokens are ordinary identifiers.  A token
that no rule covers is a secret if the random model's likelihood wins by a margin in all and
for each character; the token's own share of the ordinary counts is left out.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nazar.llm import tables

KINDS = ("assign", "access", "hex")
NAMES = re.compile(r"(?ai:password|passwd|secret|token|api_?key)")
VALUE = re.compile(r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")
#: Tokens the models look at.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_.=-"
N = len(ALPHABET) + 1  # 0 stands before the first character
CODE = np.zeros(128, dtype=np.int64)
CODE[[ord(c) for c in ALPHABET]] = np.arange(1, N)
#: Pseudo-counts of the lower orders.
SMOOTH, BACK = 0.5, 4.0
#: Nats a character, and in all, by which the random model must win.
MIN_MEAN, MIN_TOTAL = 0.5, 12.0


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the fixed rules' matches by start, then kind."""
    out = []
    at = 0
    while m := NAMES.search(text, at):
        v = VALUE.match(text, m.end())
        if v:
            if v.end(1) - v.start(1) >= 6:
                out.append((m.start(), 0, v.end(), v.start(1)))
            at = v.end()
        else:
            at = m.start() + 1
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    out.sort()
    return out


def other_tokens(text: str, base: list) -> list[tuple[int, int]]:
    """Places of the tokens that meet no base span, in time linear in both lists."""
    out, ends, i = [], 0, 0
    for m in TOKEN.finditer(text):
        while i < len(base) and base[i][0] < m.end():
            ends = max(ends, base[i][2])
            i += 1
        if ends <= m.start():
            out.append((m.start(), m.end()))
    return out


def triples(value: str) -> np.ndarray:
    """Codes of (two before, one before, character) of each character."""
    c = CODE[np.frombuffer(value.encode("ascii"), dtype=np.uint8)]
    one = np.concatenate([[0], c[:-1]])
    two = np.concatenate([[0], one[:-1]])
    return (two * N + one) * N + c


class Models:
    """Counts of both models.  A scored token is one of the ordinary sample, so its own triples
    are left out of that model's counts."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        self.cube = [random.astype(np.float64), ordinary.astype(np.float64)]
        self.context = [c.reshape(-1, N).sum(axis=1) for c in self.cube]
        self.pair = [c.reshape(N, N * N).sum(axis=0) for c in self.cube]
        self.last = [c.reshape(N, N).sum(axis=1) for c in self.pair]
        single = [c.reshape(N, N).sum(axis=0) + SMOOTH for c in self.pair]
        self.single = [c / c.sum() for c in single]

    def _logs(self, k: int, t: np.ndarray, own: bool) -> np.ndarray:
        def held(counts: np.ndarray, key: np.ndarray) -> np.ndarray:
            if not own:
                return counts[key]
            which, at, many = np.unique(key, return_inverse=True, return_counts=True)
            return np.maximum(counts[which] - many, 0)[at]

        pair = t % (N * N)
        p1 = (held(self.pair[k], pair) + BACK * self.single[k][t % N]) / (held(self.last[k], pair // N) + BACK)
        return np.log((held(self.cube[k], t) + BACK * p1) / (held(self.context[k], t // N) + BACK))

    def score(self, value: str) -> float:
        """Log-likelihood ratio of a token outside the rules' matches."""
        t = triples(value)
        return float((self._logs(0, t, False) - self._logs(1, t, True)).sum())


def looks_random(value: str, models: Models) -> bool:
    """Letters and digits mixed, and the random model wins by the margins."""
    if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
        return False
    s = models.score(value)
    return s >= MIN_TOTAL and s >= MIN_MEAN * len(value)


def learn(docs: DataFrame) -> Models:
    """Count both models over the distinct sample tokens of all texts.  The driver gets at most
    N^3 counts for each."""
    tables.small_batches(docs.sparkSession)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            seen: set[tuple[int, str]] = set()
            for text in b.column(0).to_pylist():
                if text:
                    base = base_spans(text)
                    seen.update((0, text[v:e]) for _, _, e, v in base)
                    seen.update((1, text[s:e]) for s, e in other_tokens(text, base))
            cols = list(zip(*sorted(seen), strict=True)) or [(), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string())], names=["side", "token"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, N ** 3), dtype=np.int64)
        for b in batches:
            for k, token in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                np.add.at(counts[k], triples(token), 1)
        for k in range(2):
            gram = np.flatnonzero(counts[k])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k)), pa.array(gram), pa.array(counts[k][gram])], names=["side", "gram", "n"])

    src = tables.spread_out(docs.select("text")).mapInArrow(samples, "side long, token string").distinct()
    rows = src.mapInArrow(count, "side long, gram long, n long").groupBy("side", "gram").agg(F.sum("n").alias("n"))
    counts = np.zeros((2, N ** 3))
    for r in rows.toLocalIterator():
        counts[r.side, r.gram] = r.n
    return Models(counts[0], counts[1])


def scan(docs: DataFrame, models: Models) -> DataFrame:
    """doc_id, counts of the rules' matches, base_sha256, spans: one row a document.  A null
    text is an empty one; null and repeated ids are rows of their own."""
    spark = docs.sparkSession
    tables.small_batches(spark)
    shared = spark.sparkContext.broadcast(models)
    joined = lambda spans: ",".join(f"{k}:{s}:{e}" for s, k, e in spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans = [[], [], []], [], []
            for text in b.column(1).to_pylist():
                text = text or ""
                base = base_spans(text)
                named = [(s, KINDS[k], e) for s, k, e, _ in base]
                added = [(s, "random", e) for s, e in other_tokens(text, base) if looks_random(text[s:e], shared.value)]
                for k in range(3):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(joined(named).encode()).hexdigest())
                order = {k: i for i, k in enumerate(KINDS)}
                spans.append(joined(sorted([*named, *added], key=lambda x: (x[0], order.get(x[1], 9)))))
            cols = [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return tables.spread_out(src).mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, learn(docs))
