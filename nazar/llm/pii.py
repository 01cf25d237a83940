"""Personal data by fixed rules and bootstrapped contextual extraction.

The rules find seed entities.  The words before a seed are lexical patterns; the same words
stand before other identifier-like tokens, so patterns and instances (token values) form a
bipartite graph, which Spark scores in a few rounds: a pattern by the share of its distinct
instances that are trusted, an instance by the patterns that extract it.  Patterns that are
trusted, seen with enough different seeds, and cues (an identifier follows the word in a fair
share of all its occurrences, each distinct text counted once) then mark identifiers that no
rule knows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nazar.llm import tables

KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a digit run that fails from its first digit fails from the others too
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: An identifier-like token: no white space, a digit or @, 5 to 64 characters.
MARK = re.compile(r"[0-9@]+")
SHORTEST, LONGEST = 5, 64
ROUNDS = 3
TRUST, MIN_SEEDS, MIN_CUE = 0.9, 5, 0.2
#: Patterns sent to the executors at once; more go in further blocks over the same texts.
BLOCK_PATTERNS = 200_000
TRIM = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed rules' matches, in order of start, then kind."""
    out = []
    if "@" in text:
        done, prev, at = 0, 0, text.find("@")
        while at >= 0:
            piece = text[max(done, prev):at]
            begin = at - (len(piece) - len(piece.rstrip(LOCAL)))
            m = DOMAIN.match(text, at + 1) if begin < at else None
            if m:
                out.append((begin, 0, m.end()))
                done = m.end()
            prev = at + 1
            at = text.find("@", max(done, at + 1))
    for m in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = m.group().replace(" ", "").replace("-", "")
            if 14 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, pattern words) of the identifier-like tokens of a text."""
    out, last = [], 0
    for m in MARK.finditer(text):
        if m.start() < last:
            continue
        lo = max(last, m.start() - LONGEST - 1)
        head = text[lo:m.start()]
        cut = max((head.rfind(w) for w in " \n\t\r\f\v\xa0"), default=-1)
        if cut < 0 and lo > last:  # the token is too long
            continue
        tail = text[m.end():m.end() + LONGEST + 1]
        ends = [i for i in (tail.find(w) for w in " \n\t\r\f\v\xa0") if i >= 0]
        if not ends and len(tail) > LONGEST:
            continue
        start, end = lo + cut + 1, m.end() + (min(ends) if ends else len(tail))
        last = end
        while start < end and text[start] in "\"'([{<":
            start += 1
        while end > start and text[end - 1] in "\"')]}>.,;:!?":
            end -= 1
        if SHORTEST <= end - start <= LONGEST:
            word, _ = word_before(text, start)
            if word:
                out.append((start, end, word))
    return out


def word_before(text: str, start: int) -> tuple[str, bool]:
    """(the word before a place, or "" if it is none; whether it stands there as a token of its
    own).  Words hold no digit and at most LONGEST characters; any white space may lie between."""
    end = start
    while end and text[end - 1].isspace():
        end -= 1
    lo = max(0, end - LONGEST - 1)
    piece = text[lo:end].split()[-1] if end else ""
    word = piece.strip(TRIM).lower()
    if len(piece) > LONGEST or not word or any(c.isdigit() for c in word):
        return "", False
    return word, end < start


class Covered:
    """Whether a place meets one of the spans (start, ..., end), in the logarithm of their number."""

    def __init__(self, spans: list[tuple]):
        self.starts = sorted(s[0] for s in spans)
        self.ends = list(accumulate((e for _, e in sorted((s[0], s[-1]) for s in spans)), max))

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_left(self.starts, end)
        return i > 0 and self.ends[i - 1] > start


def kind_of_shape(value: str) -> str:
    """n: digits and signs; x: with letters."""
    return "x" if any(c.isalpha() for c in value) else "n"


def _digest(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.lower().encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _edges(docs: DataFrame) -> DataFrame:
    """pattern, word, inst, kind (null if no rule knows it), h (hash of the text), n (places there),
    glued (places whose word is no token of its own): the pattern-instance graph, a text once."""
    names = ["pattern", "word", "inst", "kind", "h", "n", "glued"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[tuple, list[int]] = {}
            for text, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                base = base_spans(text)
                rows, taken = [(s, e, KINDS[k]) for s, k, e in base], Covered(base)
                rows += [(s, e, None) for s, e, _ in candidates(text) if not taken(s, e)]
                places = set()
                for s, e, k in rows:
                    word, alone = word_before(text, s)
                    if word:
                        v = text[s:e]
                        seen = out.setdefault((f"{kind_of_shape(v)}|{word}", word, _digest(v), k, h), [0, 0])
                        if s not in places:  # a place of two kinds is one place
                            seen[0] += 1
                            seen[1] += not alone
                        places.add(s)
            cols = list(zip(*[(*k, *v) for k, v in out.items()], strict=True)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    src = docs.select("text", F.xxhash64("text").alias("h"))
    return src.mapInArrow(run, "pattern string, word string, inst long, kind string, h long, n long, glued long").distinct()


def score_patterns(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """pattern, word, kind, score, seeds: the graph's pattern scores after ``rounds`` rounds."""
    total = edges.groupBy("pattern").agg(F.countDistinct("inst").alias("total"))
    seeds = edges.where("kind is not null").select("inst", "kind").distinct()
    links = edges.select("pattern", "word", "inst").distinct()
    trust = seeds.withColumn("conf", F.lit(1.0))
    scored = None
    for _ in range(rounds):
        got = links.join(trust, "inst").groupBy("pattern", "word", "kind").agg(F.sum("conf").alias("got"), F.sum((F.col("conf") == 1.0).cast("int")).alias("seeds"))
        scored = tables.save(got.join(total, "pattern").select("pattern", "word", "kind", (F.col("got") / F.col("total")).alias("score"), "seeds"))
        good = scored.where("score >= 0.5 and seeds >= 2")
        new = links.join(good.select("pattern", "kind", "score"), "pattern").join(seeds.select("inst"), "inst", "left_anti")
        new = new.groupBy("inst", "kind").agg((1 - F.exp(F.sum(F.log(1.0 - F.least("score", F.lit(0.99)))))).alias("conf"))
        trust = tables.save(seeds.withColumn("conf", F.lit(1.0)).unionByName(new))
    return scored


def _word_counts(docs: DataFrame, words: list[str]) -> DataFrame:
    """word, c: how often each of the words stands as a token in the distinct texts.

    A text gives one row, its hash and the codes and counts of the wanted words in it; copies
    fall together by the hash; each task then adds its texts up, so it gives one row a word.
    """
    wanted = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = wanted.value
        for b in batches:
            out = []
            for text in b.column(0).to_pylist():
                count: Counter = Counter()
                for piece, n in Counter((text or "").split()).items():
                    code = codes.get(piece.strip(TRIM).lower())
                    if code is not None:
                        count[code] += n
                out.append(np.array(list(count.items()), dtype="<i8").tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(out, pa.binary())], names=["h", "held"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(wanted.value), dtype=np.int64)
        for b in batches:
            pairs = np.frombuffer(b"".join(b.column(0).to_pylist()), dtype="<i8").reshape(-1, 2)
            np.add.at(total, pairs[:, 0], pairs[:, 1])
        own = np.flatnonzero(total)
        names = list(wanted.value)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in own], pa.string()), pa.array(total[own])], names=["word", "c"])

    texts = docs.select("text", F.xxhash64("text").alias("h")).mapInArrow(held, "h long, held binary").where("length(held) > 0")
    once = texts.groupBy("h").agg(F.min("held").alias("held")).select("held")
    return once.mapInArrow(add, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def learn(docs: DataFrame) -> list[dict[str, str]]:
    """Blocks of trusted patterns, pattern -> kind, each of at most BLOCK_PATTERNS.  A pattern
    has one kind, that of its best score (of equal ones, the last by name)."""
    tables.small_batches(docs.sparkSession)
    src = tables.spread_out(docs.select("text"))
    edges = tables.save(_edges(src))
    scored = score_patterns(edges).where((F.col("score") >= TRUST) & (F.col("seeds") >= MIN_SEEDS))
    scored = scored.groupBy("pattern", "word").agg(F.max(F.struct("score", "kind"))["kind"].alias("kind"))
    follows = edges.groupBy("pattern").agg(F.sum("n").alias("follows"))
    glued = edges.groupBy("word").agg(F.sum("glued").alias("glued"))
    good = tables.save(scored.join(follows, "pattern").join(glued, "word"))
    words = [r.word for r in good.select("word").distinct().orderBy("word").toLocalIterator()]
    counts = None
    for lo in range(0, len(words), BLOCK_PATTERNS):
        part = _word_counts(src, words[lo:lo + BLOCK_PATTERNS])
        counts = part if counts is None else counts.unionByName(part)
    if counts is None:
        return []
    cues = good.join(counts, "word", "left").where(F.col("follows") >= MIN_CUE * (F.coalesce("c", F.lit(0)) + F.col("glued")))
    blocks: list[dict[str, str]] = []
    for row in tables.save(cues.select("pattern", "kind")).orderBy("pattern").toLocalIterator():
        if not blocks or len(blocks[-1]) >= BLOCK_PATTERNS:
            blocks.append({})
        blocks[-1][row.pattern] = row.kind
    return blocks


def all_spans(text: str, blocks: list) -> tuple[list, list]:
    """(base spans, added spans): lists of (start, kind, end), the added with a kind's name."""
    base = base_spans(text)
    added = []
    if blocks:
        taken = Covered(base)
        for s, e, word in candidates(text):
            if not taken(s, e):
                pattern = f"{kind_of_shape(text[s:e])}|{word}"
                kind = next((b.value[pattern] for b in blocks if pattern in b.value), None)
                if kind:
                    added.append((s, f"context_{kind}", e))
    return base, added


def _joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, k, e in spans)


def _shared(docs: DataFrame, blocks: list[dict[str, str]]) -> list:
    return [docs.sparkSession.sparkContext.broadcast(b) for b in blocks]


def scan(docs: DataFrame, blocks: list[dict[str, str]]) -> DataFrame:
    """``doc_id``, counts of the rules' matches, base_sha256, spans: one row a document.  A null
    text is an empty one; null and repeated ids are rows of their own."""
    tables.small_batches(docs.sparkSession)
    shared = _shared(docs, blocks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans = [[], [], [], []], [], []
            for text in b.column(1).to_pylist():
                base, added = all_spans(text or "", shared)
                named = [(s, KINDS[k], e) for s, k, e in base]
                for k in range(4):
                    counts[k].append(sum(x[1] == k for x in base))
                digests.append(hashlib.sha256(_joined(named).encode()).hexdigest())
                order = {k: i for i, k in enumerate(KINDS)}
                spans.append(_joined(sorted([*named, *added], key=lambda x: (x[0], order.get(x[1], 9), x[1]))))
            cols = [b.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return tables.spread_out(src).mapInArrow(run, schema)


def op3(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    return scan(docs, learn(docs))


def masked(text: str, blocks: list) -> str:
    """The text with every span replaced by its kind; overlapping spans are masked together."""
    base, added = all_spans(text, blocks)
    spans = sorted([(s, e, KINDS[k]) for s, k, e in base] + [(s, e, k.removeprefix("context_")) for s, k, e in added])
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"<{kind}>"]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data masked in text, and n_chars, if there, of the new text;
    other columns, and all rows, as they came.  A null text stays null."""
    tables.small_batches(docs.sparkSession)
    shared = _shared(docs, learn(docs))
    text_at = docs.columns.index("text")
    chars_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            old = b.column(text_at).to_pylist()
            new = [t and masked(t, shared) for t in old]
            cols = list(b.columns)
            cols[text_at] = pa.array(new, b.schema.field(text_at).type)
            if chars_at is not None:
                chars = [c if t == o else len(t) for t, o, c in zip(new, old, b.column(chars_at).to_pylist(), strict=True)]
                cols[chars_at] = pa.array(chars, b.schema.field(chars_at).type)
            yield pa.RecordBatch.from_arrays(cols, schema=b.schema)

    return tables.spread_out(docs).mapInArrow(run, docs.schema)
