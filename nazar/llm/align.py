"""Alignment of two tokenizers' ids over the same text, by the byte offsets at which both end.

A text's ids of either side have cumulative ends in bytes; a dictionary for each side leads from
an end to its token's index.  Ends in both dictionaries (a hash-set intersection), in order, cut
both id lists into groups.  Links, the pairs of tokens whose byte ranges overlap, are expanded
in each group: where one side has a single token it meets all tokens of the other, else the
group's own ends say which tokens meet.  Many texts are laid one after the other, so their ends
are boundaries of both sides and one intersection serves them all.

Neither side has a token that reaches across a single space between words (``cut_text``), so
both end there, and a text's groups and links are those of its words, one after the other: the
summaries align each distinct word of a task once.

The count of an id pair is the number of documents that hold it linked.  Documents are aligned
once; their distinct pairs are written and counted, and looked up in a second pass: the most
frequent pairs, up to a bound, go to the tasks as a sorted table; for the rest the documents'
other pairs are joined with the counts.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nazar.llm import tables, vocab

#: Bytes of text aligned at once; a longer text is taken whole.
SLICE_BYTES = 1 << 20
#: Aligned words a task remembers.
HELD_WORDS = 500_000
#: Distinct pairs a task holds before it passes their counts on.
HELD_PAIRS = 2_000_000
#: Id pairs, the most frequent ones, that tasks look up in memory (17 bytes each).
SHARED_PAIRS = 4_000_000


def cut_by_ends(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(A tokens, B tokens) up to the end of each group."""
    a_at = dict(zip(a_end.tolist(), range(1, len(a_end) + 1), strict=True))
    b_at = dict(zip(b_end.tolist(), range(1, len(b_end) + 1), strict=True))
    common = sorted(a_at.keys() & b_at.keys())
    pick = lambda at: np.fromiter(map(at.__getitem__, common), dtype=np.int64, count=len(common))
    return pick(a_at), pick(b_at)


def expand_links(a_cut: np.ndarray, b_cut: np.ndarray, a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, group) of every link, in order of the bytes that both cover."""
    m, n = np.diff(a_cut, prepend=0), np.diff(b_cut, prepend=0)
    many = m + n - 1  # inside a group no end is common
    group = np.repeat(np.arange(len(many)), many)
    nth = np.arange(len(group)) - np.repeat(np.cumsum(many) - many, many)
    a = (a_cut - m)[group] + np.where(m[group] == 1, 0, nth)
    b = (b_cut - n)[group] + np.where(n[group] == 1, 0, nth)
    crossed = (m > 1) & (n > 1)
    if crossed.any():
        ends = np.union1d(a_end[np.repeat(crossed, m)], b_end[np.repeat(crossed, n)])
        at = crossed[group]
        a[at], b[at] = np.searchsorted(a_end, ends), np.searchsorted(b_end, ends)
    return a, b, group


@dataclass
class Aligned:
    """Some texts laid one after the other: ids, the texts they are of, groups and links."""
    rows: np.ndarray  # which rows of the batch have tokens
    a: np.ndarray
    b: np.ndarray
    a_text: np.ndarray  # place in ``rows``
    b_text: np.ndarray
    a_cut: np.ndarray
    b_cut: np.ndarray
    link_a: np.ndarray  # token indices
    link_b: np.ndarray

    def per_text(self, text: np.ndarray) -> np.ndarray:
        return np.bincount(text, minlength=len(self.rows))


def align_texts(rows: list[int], texts: list[str], a_file: bytes, b_file: bytes) -> Aligned:
    """The texts whose tokens of either side give the text's own bytes, after a space."""
    a_tok, b_tok = vocab.byte_level_tokens(a_file), vocab.piece_tokens(b_file)
    a_ids = [e.ids for e in vocab.tokenizer(a_file, True).encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    b_ids = vocab.piece_model(b_file).encode(texts, num_threads=1)
    want = [b" " + t.encode() for t in texts]

    def flat(ids: list[list[int]]) -> np.ndarray:
        return np.fromiter(chain.from_iterable(ids), dtype=np.int64, count=sum(map(len, ids)))

    def whole(tok: vocab.Tokens, ids: list[list[int]]) -> bool:
        """Whether the tokens give all texts' bytes and end where each of them ends."""
        every = flat(ids)
        sizes = np.cumsum([len(w) for w in want])
        ends = np.cumsum(tok.length[every])[np.cumsum([len(x) for x in ids]) - 1] if len(every) else sizes[:0]
        return np.array_equal(ends, sizes) and b"".join(map(tok.bytes.__getitem__, every.tolist())) == b"".join(want)

    good = list(range(len(texts)))
    if not (whole(a_tok, a_ids) and whole(b_tok, b_ids)):  # which texts they are
        gives = lambda tok, ids, w: b"".join(map(tok.bytes.__getitem__, ids)) == w
        good = [i for i in good if gives(a_tok, a_ids[i], want[i]) and gives(b_tok, b_ids[i], want[i])]
        a_ids, b_ids = [a_ids[i] for i in good], [b_ids[i] for i in good]

    def laid(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        return flat(ids), np.repeat(np.arange(len(ids)), [len(x) for x in ids])

    (a, a_text), (b, b_text) = laid(a_ids), laid(b_ids)
    a_end, b_end = np.cumsum(a_tok.length[a]), np.cumsum(b_tok.length[b])
    a_cut, b_cut = cut_by_ends(a_end, b_end)
    link_a, link_b, _ = expand_links(a_cut, b_cut, a_end, b_end)
    return Aligned(np.array([rows[i] for i in good], dtype=np.int64), a, b, a_text, b_text, a_cut, b_cut, link_a, link_b)


def _dealt(texts: list[str | None]) -> Iterator[tuple[list[int], list[str]]]:
    """(rows, texts) of about SLICE_BYTES together, without null and empty ones."""
    rows: list[int] = []
    held: list[str] = []
    size = 0
    for i, t in enumerate(texts):
        if t:
            rows.append(i)
            held.append(t)
            size += len(t)
        if size >= SLICE_BYTES:
            yield rows, held
            rows, held, size = [], [], 0
    if held:
        yield rows, held


def slices(col: pa.Array, a_file: bytes, b_file: bytes) -> Iterator[Aligned]:
    """Alignments of the whole texts of an Arrow column; null and empty ones have none."""
    for rows, texts in _dealt(col.to_pylist()):
        yield align_texts(rows, texts, a_file, b_file)


def group_strings(x: Aligned, a_tok: vocab.Tokens, b_tok: vocab.Tokens) -> list[bytes]:
    """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
    m, n = np.diff(x.a_cut, prepend=0), np.diff(x.b_cut, prepend=0)
    a_place = np.arange(len(x.a)) + np.repeat(x.b_cut - n, m)  # A's ids of a group, then B's
    b_place = np.arange(len(x.b)) + np.repeat(x.a_cut, n)
    wide = max(a_tok.digits.shape[1], b_tok.digits.shape[1])
    chars = np.full((len(x.a) + len(x.b), wide), ord(","), dtype=np.uint8)
    shown = np.zeros(len(chars), dtype=np.int64)
    for tok, ids, place in ((a_tok, x.a, a_place), (b_tok, x.b, b_place)):
        digits = tok.digits[ids]
        chars[place, :digits.shape[1]] = digits
        shown[place] = tok.shown[ids]
    mark = np.full(len(chars), ord(","), dtype=np.uint8)
    mark[a_place[x.a_cut - 1]], mark[b_place[x.b_cut - 1]] = ord("|"), ord(";")
    chars[np.arange(len(chars)), shown] = mark
    flat = chars[np.arange(wide)[None] <= shown[:, None]].tobytes()
    last = np.cumsum(x.per_text(x.a_text) + x.per_text(x.b_text))
    ends = np.cumsum(shown + 1)[last - 1].tolist()
    return [flat[lo:hi - 1] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]


ODD_SPACE = re.compile(r"^ | \s| $")
CUT = re.compile(r"(?<=[^ ]) (?=\S)")


def cut_text(text: str) -> list[str]:
    """The text cut at every space with no space before and no white space after it.

    The byte-level side cuts such a text before the space whatever stands around it, and the
    words of the other side begin at a space, which none of its pieces holds after another
    character (``cuts_at_spaces``); so the ids of ' ' + text are those of ' ' + each part.
    """
    return CUT.split(text) if ODD_SPACE.search(text) else text.split(" ")


def cuts_at_spaces(b_tok: vocab.Tokens) -> bool:
    return not any(b" " in t.lstrip(b" ") for t in b_tok.bytes)


class Words:
    """What the alignment of each distinct word adds to its text: (tokens of A, of B, groups, the
    groups' string, packed codes of its links), None where the tokens do not give its bytes."""

    def __init__(self, a_file: bytes, b_file: bytes):
        self.files = a_file, b_file
        self.a_tok, self.b_tok = vocab.byte_level_tokens(a_file), vocab.piece_tokens(b_file)
        self.apart = cuts_at_spaces(self.b_tok)
        self.known: dict[str, tuple[int, int, int, bytes, bytes] | None] = {}

    def parts(self, text: str) -> list[str]:
        # a sign that stands for a space in the pieces is taken with the whole text
        return cut_text(text) if self.apart and "▁" not in text else [text]

    def learn(self, words: set[str]) -> None:
        if len(self.known) + len(words) > HELD_WORDS:
            self.known = {w: self.known[w] for w in words if w in self.known}
        fresh = [w for w in words if w not in self.known]
        if not fresh:
            return
        self.known.update(dict.fromkeys(fresh))
        x = align_texts(list(range(len(fresh))), fresh, *self.files)
        if not len(x.rows):
            return
        codes = (x.a[x.link_a] * len(self.b_tok) + x.b[x.link_b]).astype("<i8").tobytes()
        ends = np.cumsum(x.per_text(x.a_text[x.link_a])).tolist()
        numbers = (x.per_text(t).tolist() for t in (x.a_text, x.b_text, x.a_text[x.a_cut - 1]))
        rows = zip(x.rows.tolist(), *numbers, group_strings(x, self.a_tok, self.b_tok), [0, *ends[:-1]], ends, strict=True)
        self.known.update((fresh[row], (a, b, g, text, codes[8 * lo:8 * hi])) for row, a, b, g, text, lo, hi in rows)


def _files(docs: DataFrame, a_path: str | None, b_path: str | None):
    read = (vocab.file_bytes(a_path or vocab.default_path("byte_bpe_50k.json")), vocab.file_bytes(b_path or vocab.default_path("piece_bpe_32k.model")))
    return docs.sparkSession.sparkContext.broadcast(read)


def aligned(docs: DataFrame, a_path: str | None = None, b_path: str | None = None) -> DataFrame:
    """doc_id, a_ids, b_ids, a_cuts, b_cuts (ids of either side up to the end of each group),
    links (pairs of indices): one row a document, empty lists where it has no tokens."""
    tables.small_batches(docs.sparkSession)
    files = _files(docs, a_path, b_path)
    names = ["a_ids", "b_ids", "a_cuts", "b_cuts", "links_a", "links_b"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {c: [[] for _ in range(batch.num_rows)] for c in names}
            for x in slices(batch.column(1), *files.value):
                a0, b0 = (np.searchsorted(t, np.arange(len(x.rows) + 1)) for t in (x.a_text, x.b_text))
                cut = np.r_[0, np.searchsorted(x.a_cut, a0[1:]) + 1]
                link = np.r_[0, np.searchsorted(x.link_a, a0[1:])]
                for k, row in enumerate(x.rows.tolist()):
                    groups, links = slice(cut[k], cut[k + 1]), slice(link[k], link[k + 1])
                    found = (x.a[a0[k]:a0[k + 1]], x.b[b0[k]:b0[k + 1]], x.a_cut[groups] - a0[k], x.b_cut[groups] - b0[k], x.link_a[links] - a0[k], x.link_b[links] - b0[k])
                    for c, v in zip(names, found, strict=True):
                        out[c][row] = v
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(v, pa.list_(pa.int32())) for v in out.values()]], names=["doc_id", *names])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = tables.spread_out(src).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} array<int>" for c in names))
    links = F.arrays_zip(F.col("links_a").alias("a"), F.col("links_b").alias("b"))
    return rows.select("doc_id", *names[:4], links.alias("links"))


def _summaries(docs: DataFrame, files) -> DataFrame:
    """row (a mark of the document), doc_id, the numbers and the digest of its alignment, and its
    distinct id pairs, packed, with the number of their links; written once."""
    numbers = ["n_a", "n_b", "n_groups", "n_links"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(*files.value)
        for batch in batches:
            n = batch.num_rows
            cols = {c: np.zeros(n, dtype=np.int64) for c in numbers}
            digest, pairs, links = [""] * n, [b""] * n, [b""] * n
            for rows, texts in _dealt(batch.column(1).to_pylist()):
                cut = [words.parts(t) for t in texts]
                words.learn(set().union(*cut))
                for row, own in zip(rows, cut, strict=True):
                    found = [words.known[w] for w in own]
                    if None in found:
                        continue
                    a, b, groups, strings, codes = zip(*found, strict=True)
                    code, many = np.unique(np.frombuffer(b"".join(codes), "<i8"), return_counts=True)
                    n_a, n_b, n_groups = sum(a), sum(b), sum(groups)
                    # inside a group no end is common: a link more than ends inside it
                    for c, v in zip(numbers, (n_a, n_b, n_groups, n_a + n_b - n_groups), strict=True):
                        cols[c][row] = v
                    digest[row] = hashlib.sha256(b";".join(strings)).hexdigest()
                    pairs[row], links[row] = code.tobytes(), many.astype("<u4").tobytes()
            arrays = [*[pa.array(v) for v in cols.values()], pa.array(digest), pa.array(pairs, pa.binary()), pa.array(links, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", *numbers, "groups_sha256", "pairs", "links"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    schema = "doc_id long, " + ", ".join(f"{c} long" for c in numbers) + ", groups_sha256 string, pairs binary, links binary"
    return tables.save(tables.spread_out(src).mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(pair, links, place in the batch) of the packed columns pairs and links."""
    pairs, links = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pairs", "links"))
    many = [len(p) // 8 for p in pairs]
    return (np.frombuffer(b"".join(pairs), "<i8"), np.frombuffer(b"".join(links), "<u4").astype(np.int64), np.repeat(np.arange(len(pairs)), many))


def pair_counts(held: DataFrame, b_size: int) -> DataFrame:
    """pair, n (documents that hold it linked), best (whether no pair of its A id has more)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in batches:
            more, count = np.unique(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i8"), return_counts=True)
            both, at = np.unique(np.concatenate([pair, more]), return_inverse=True)
            total = np.zeros(len(both), dtype=np.int64)
            np.add.at(total, at, np.concatenate([n, count]))
            pair, n = both, total
            if len(pair) > HELD_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])
                pair, n = pair[:0], n[:0]
        yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(n)], names=["pair", "n"])

    parts = held.select("pairs").mapInArrow(run, "pair long, n long")
    counts = tables.save(parts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("a", F.expr(f"pair div {b_size}")))
    most = counts.groupBy("a").agg(F.max("n").alias("most"))
    return tables.save(counts.join(most, "a").select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def priced(held: DataFrame, counts: DataFrame, shared_pairs: int = SHARED_PAIRS) -> DataFrame:
    """``held`` with n_best and count_sum in place of the packed columns."""
    total = counts.count()
    ranked = counts if total <= shared_pairs else counts.orderBy(F.col("n").desc(), "pair").limit(shared_pairs)
    top = tables.save(ranked).toPandas().sort_values("pair")  # at most shared_pairs rows
    known = held.sparkSession.sparkContext.broadcast(tuple(top[c].to_numpy() for c in ("pair", "n", "best")))
    kept = [c for c in held.columns if c not in ("pairs", "links")]
    fields = [held.schema[c] for c in kept]

    def found(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        pair, links, at = _unpacked(batch)
        keys, n, best = known.value
        place = np.minimum(np.searchsorted(keys, pair), max(0, len(keys) - 1))
        hit = keys[place] == pair if len(keys) else np.zeros(len(pair), dtype=bool)
        return pair, links, at, hit, np.where(hit, n[place] if len(keys) else 0, 0), hit & (best[place].astype(bool) if len(keys) else False)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, links, at, _, n, best = found(b)
            sums = [np.zeros(b.num_rows, dtype=np.int64) for _ in range(2)]
            np.add.at(sums[0], at, links * best)
            np.add.at(sums[1], at, links * n)
            cols = [b.column(b.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*cols, *map(pa.array, sums)], names=[*kept, "n_best", "count_sum"])

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pair, links, at, hit, _, _ = found(b)
            rows = b.column(b.schema.get_field_index("row")).to_numpy()[at[~hit]]
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(pair[~hit]), pa.array(links[~hit])], names=["row", "pair", "links"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in fields)
    out = held.mapInArrow(add, schema + ", n_best long, count_sum long")
    if total <= shared_pairs:
        return out
    rest = held.select("row", "pairs", "links").mapInArrow(others, "row long, pair long, links long").join(counts, "pair")
    rest = rest.groupBy("row").agg(F.sum(F.col("links") * F.col("best").cast("long")).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    out = out.join(rest, "row", "left").na.fill(0, ["more_best", "more_sum"])
    return out.select(*kept, (F.col("n_best") + F.col("more_best")).alias("n_best"), (F.col("count_sum") + F.col("more_sum")).alias("count_sum"))


def alignment_summary(docs: DataFrame, a_path: str | None = None, b_path: str | None = None, shared_pairs: int = SHARED_PAIRS) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256: one row a document.

    Texts that are null or empty, or whose tokens of either side do not give a space and the
    text's bytes, have no tokens: zeros, and an empty digest.  Null and repeated ids, and equal
    rows, are documents of their own, each counted.  A tie of counts is best on each side.  An
    empty table gives an empty result; other columns are not read.
    """
    tables.small_batches(docs.sparkSession)
    files = _files(docs, a_path, b_path)
    held = _summaries(docs, files)
    counts = pair_counts(held, len(vocab.piece_tokens(files.value[1])))
    return priced(held, counts, shared_pairs).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12(spark, sf_dir: str) -> DataFrame:
    return alignment_summary(tables.table(spark, sf_dir, "documents"))
