"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of words of the Arrow batches of one task.  Its words become symbols of the
test set's vocabulary; words outside it (and ends of texts) become separators, each its own
symbol, and a run of them counts once, since no test phrase can cross it.  The shard's suffixes
are sorted by prefix doubling, the Burrows-Wheeler transform goes into a wavelet matrix, and
all test phrases are backward-searched at once through its ranks.  Ranges that are not empty
are located by walking the LF-mapping to sampled suffix positions; the occurrences of a text
merge into its removal spans.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from nazar.llm import tables, tokens

#: Words in a window of a test item.
WINDOW = 10
#: Symbols in a shard; suffix ranks and positions of 21 bits fit one sort key of 63.
SHARD = (1 << 20) - 64
#: Bytes of text tokenised at once.
SLICE = 8 << 20
#: Every SAMPLE-th position of a shard keeps its place in the suffix array.
SAMPLE = 16
#: Test windows searched at once; more are searched in further blocks over the same shards.
BLOCK_WINDOWS = 400_000

COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


# ------------------------------------------------------------------ phrases

class Phrases:
    """Windows of one block of test items: vocabulary, symbols and owning items."""

    def __init__(self, item_ids: list[str | None], word_lists: list[np.ndarray], window: int = WINDOW):
        grids, sizes = [np.zeros((0, window), np.uint64)], np.array([min(window, len(w)) for w in word_lists], dtype=np.int64)
        many = np.array([len(w) - size + 1 if size else 0 for w, size in zip(word_lists, sizes, strict=True)], dtype=np.int64)
        for w, size in zip(word_lists, sizes, strict=True):
            if size:
                own = np.lib.stride_tricks.sliding_window_view(w, size)
                grids.append(np.pad(own, ((0, 0), (0, window - size))))
        grid = np.concatenate(grids)
        lens, owner = np.repeat(sizes, many), np.repeat(np.arange(len(sizes)), many)
        self.item_ids = item_ids
        self.vocabulary = np.unique(np.concatenate(word_lists)) if word_lists else np.zeros(0, np.uint64)
        # symbols 1..V; 0 is the separator
        symbols = np.searchsorted(self.vocabulary, grid).astype(np.int64) + 1
        symbols[np.arange(window)[None, :] >= lens[:, None]] = 0
        keyed = np.column_stack([lens, symbols]) if len(lens) else np.zeros((0, window + 1), np.int64)
        distinct, which = np.unique(keyed, axis=0, return_inverse=True)
        self.lens, self.symbols = distinct[:, 0], distinct[:, 1:]
        which = which.reshape(-1)
        order = np.argsort(which, kind="stable")
        self.owners = owner[order]
        self.owner_at = np.searchsorted(which[order], np.arange(len(distinct) + 1))
        bits = max(16, int(np.ceil(np.log2(8 * len(self.vocabulary) + 8))))
        self.shift = np.uint64(64 - bits)
        slot = (self.vocabulary >> self.shift).astype(np.int64)
        # vocabulary is sorted, so words of one slot stand together
        self.slot_at = np.searchsorted(slot, np.arange((1 << bits) + 1)).astype(np.int32)

    def to_symbols(self, hashes: np.ndarray) -> np.ndarray:
        """Symbol of each word, 0 outside the vocabulary."""
        slot = (hashes >> self.shift).astype(np.int64)
        at, end = self.slot_at[slot], self.slot_at[slot + 1]
        out = np.zeros(len(hashes), dtype=np.int64)
        todo = np.flatnonzero(at < end)
        at, end = at[todo], end[todo]
        while len(todo):
            same = self.vocabulary[at] == hashes[todo]
            out[todo[same]] = at[same] + 1
            at = at + 1
            more = ~same & (at < end)
            todo, at, end = todo[more], at[more], end[more]
        return out


# ------------------------------------------------------------------ the index

def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Suffix order of ``sym``; separators (0) are distinct symbols in order of place and stand
    before all others.  The text must end in a separator."""
    n = len(sym)
    sep = sym == 0
    seps = int(sep.sum())
    rank = np.where(sep, np.cumsum(sep) - 1, 0)
    held = np.bincount(sym[~sep]) if seps < n else np.zeros(1, np.int64)
    first = np.cumsum(held) - held + seps  # suffixes before the first that begins with a symbol
    rank[~sep] = first[sym[~sep]]
    # rank: number of suffixes that surely stand before; equal ranks are still open
    alone = np.bincount(rank, minlength=n)[rank] == 1
    todo = np.flatnonzero(~alone)
    step = 1
    while len(todo):
        key = (rank[todo] << 42) | (rank[todo + step] << 21) | np.arange(len(todo))
        key.sort()
        order = todo[key & ((1 << 21) - 1)]
        head = key >> 42
        pair = key >> 21
        new_group = np.empty(len(key), dtype=bool)
        new_group[0] = True
        new_group[1:] = head[1:] != head[:-1]
        new_pair = np.empty(len(key), dtype=bool)
        new_pair[0] = True
        new_pair[1:] = pair[1:] != pair[:-1]
        places = np.arange(len(key))
        group_at = np.maximum.accumulate(np.where(new_group, places, 0))
        pair_at = np.maximum.accumulate(np.where(new_pair, places, 0))
        rank[order] = head + (pair_at - group_at)
        last = np.empty(len(key), dtype=bool)
        last[-1] = True
        last[:-1] = new_pair[1:]
        todo = order[~(new_pair & last)]
        todo.sort()
        step *= 2
    out = np.empty(n, dtype=np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    """Wavelet matrix over the Burrows-Wheeler transform of one shard, with sampled positions."""

    def __init__(self, sym: np.ndarray, n_symbols: int):
        sa = suffix_array(sym)
        self.n = len(sym)
        bwt = sym[sa - 1]  # the first suffix is preceded by the closing separator
        self.levels = max(1, int(n_symbols).bit_length())
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(sym, minlength=n_symbols + 1))]).astype(np.int64)
        self.ones, self.zeros = [], []
        cur = bwt.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            bit = ((cur >> level) & 1).astype(bool)
            counts = np.zeros(self.n + 1, dtype=np.int32)
            np.cumsum(bit, out=counts[1:])
            self.ones.append(counts)
            self.zeros.append(self.n - int(counts[-1]))
            cur = np.concatenate([cur[~bit], cur[bit]])
        # rows whose position is known: every SAMPLE-th, and those after a separator
        known = (sa % SAMPLE == 0) | (bwt == 0)
        self.known = known
        self.sample_at = np.cumsum(known) - 1
        self.samples = sa[known]

    def rank(self, symbol: np.ndarray, upto: np.ndarray) -> np.ndarray:
        """How often ``symbol`` occurs in the first ``upto`` places of the transform."""
        low = np.zeros_like(upto)
        high = upto
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            bit = (symbol >> level) & 1 == 1
            ones, zeros = self.ones[k], self.zeros[k]
            a, b = ones[low], ones[high]
            low = np.where(bit, zeros + a, low - a)
            high = np.where(bit, zeros + b, high - b)
        return high - low

    def access(self, row: np.ndarray) -> np.ndarray:
        """Symbol of the transform at ``row``."""
        out = np.zeros_like(row)
        for k in range(self.levels):
            ones, zeros = self.ones[k], self.zeros[k]
            a = ones[row].astype(np.int64)
            bit = ones[row + 1] > a
            out = (out << 1) | bit
            row = np.where(bit, zeros + a, row - a)
        return out

    def search(self, symbols: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase, first row, end row) of the phrases that occur."""
        live = np.arange(len(lens))
        sp, ep = np.zeros(len(lens), np.int64), np.full(len(lens), self.n, np.int64)
        done = []
        for step in range(int(lens.max(initial=0))):
            c = symbols[live, lens[live] - 1 - step]
            both = self.rank(np.concatenate([c, c]), np.concatenate([sp, ep])) if step else np.concatenate([np.zeros(len(c), np.int64), self.smaller[c + 1] - self.smaller[c]])
            sp, ep = self.smaller[c] + both[:len(c)], self.smaller[c] + both[len(c):]
            some = ep > sp
            live, sp, ep = live[some], sp[some], ep[some]
            over = lens[live] == step + 1
            done.append((live[over], sp[over], ep[over]))
            live, sp, ep = live[~over], sp[~over], ep[~over]
            if not len(live):
                break
        cols = list(zip(*done, strict=True)) if done else [[np.zeros(0, np.int64)]] * 3
        return tuple(np.concatenate(x) for x in cols)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text position of each suffix row."""
        out = np.empty(len(rows), dtype=np.int64)
        at = np.arange(len(rows))
        steps = 0
        while len(at):
            known = self.known[rows]
            out[at[known]] = self.samples[self.sample_at[rows[known]]] + steps
            at, rows = at[~known], rows[~known]
            if len(at):
                c = self.access(rows)
                rows = self.smaller[c] + self.rank(c, rows)
            steps += 1
        return out


def occurrences(sym: np.ndarray, text: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(phrase, word place) of every occurrence in the stream of words, shard by shard.
    Shards overlap by a window less one word, so no occurrence is cut."""
    n = len(sym)
    if not n or not len(phrases.lens):
        return
    overlap = phrases.symbols.shape[1] - 1
    for lo in range(0, n, SHARD):
        hi = min(n, lo + SHARD + overlap)
        own, doc = sym[lo:hi], text[lo:hi]
        inside = own > 0
        # a separator before a word that follows a gap or begins a text
        opens = inside.copy()
        opens[1:] &= ~inside[:-1] | (doc[1:] != doc[:-1])
        place = np.flatnonzero(inside)
        if not len(place):
            continue
        at = np.arange(len(place)) + np.cumsum(opens[place])
        shard = np.zeros(int(at[-1]) + 2, dtype=np.int64)  # separators, one after the last word too
        shard[at] = own[place]
        word_at = np.zeros(len(shard), dtype=np.int64)
        word_at[at] = place
        index = FMIndex(shard, len(phrases.vocabulary))
        phrase, sp, ep = index.search(phrases.symbols, phrases.lens)
        size = ep - sp
        rows = np.repeat(sp - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        found = index.locate(rows)
        yield np.repeat(phrase, size), word_at[found] + lo


def scan_batch(col: pa.Array, blocks: list, window: int = WINDOW) -> dict[str, list]:
    """The result columns for the texts of one Arrow batch."""
    out: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")}
    for _, data, offsets in tokens.text_slices(col, SLICE):
        rows = len(offsets) - 1
        hashes, text, starts = tokens.words(data, offsets)
        covered = np.zeros(len(hashes) + 1, dtype=np.int64)
        items: dict[int, set] = {}
        for b in blocks:
            p = b.value
            for phrase, place in occurrences(p.to_symbols(hashes), text, p):
                np.add.at(covered, place, 1)
                np.add.at(covered, place + p.lens[phrase], -1)
                many = p.owner_at[phrase + 1] - p.owner_at[phrase]
                first = np.repeat(p.owner_at[phrase] - (np.cumsum(many) - many), many)
                item = p.owners[first + np.arange(int(many.sum()))]
                pairs = np.unique(np.repeat(text[place], many) * len(p.item_ids) + item)
                for doc, x in zip((pairs // len(p.item_ids)).tolist(), (pairs % len(p.item_ids)).tolist(), strict=True):
                    if p.item_ids[x] is not None:
                        items.setdefault(doc, set()).add(p.item_ids[x])
            if len(blocks) > 1:  # one block at a time in memory: the next use reads its file again
                del p
                vars(b).pop("_value", None)
        hit = np.cumsum(covered[:-1]) > 0
        n_words = np.bincount(text, minlength=rows)
        n_hit = np.bincount(text[hit], minlength=rows)
        # removal spans: maximal runs of hit words of one text, in words of that text
        edge = np.flatnonzero(hit)
        spans: dict[int, list] = {}
        if len(edge):
            opens = np.ones(len(edge), dtype=bool)
            opens[1:] = (np.diff(edge) > 1) | (text[edge[1:]] != text[edge[:-1]])
            first = np.searchsorted(text, np.arange(rows))
            a = np.flatnonzero(opens)
            b = np.append(a[1:], len(edge)) - 1
            for s, e in zip(edge[a].tolist(), edge[b].tolist(), strict=True):
                d = int(text[s])
                spans.setdefault(d, []).append({"start": s - int(first[d]), "end": e + 1 - int(first[d])})
        for r in range(rows):
            own = sorted(items.get(r, ()))
            out["items_sha256"].append(hashlib.sha256(",".join(own).encode()).hexdigest())
            out["n_items"].append(len(own))
            out["spans"].append(spans.get(r, []))
        out["n_words"] += n_words.tolist()
        out["n_hit"] += n_hit.tolist()
        out["contaminated"] += (n_hit > 0).tolist()
    return out


# ------------------------------------------------------------------ operator

def _pieces(items: DataFrame, window: int, most: int) -> DataFrame:
    """i, w: the items' ids and word hashes, a long item in pieces that share no window."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in tokens.text_slices(batch.column(1), SLICE):
                rows = len(offsets) - 1
                hashes, text, _ = tokens.words(data, offsets)
                cut = np.searchsorted(text, np.arange(rows + 1))
                which, own = [], []
                for r in range(rows):
                    w = hashes[cut[r]:cut[r + 1]].view(np.int64)
                    for lo in range(0, max(1, len(w) - window + 1) if len(w) else 0, most):
                        which.append(first + r)
                        own.append(w[lo:lo + most + window - 1])
                ids = batch.column(0).take(pa.array(which, pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array(own, pa.list_(pa.int64()))], names=["i", "w"])

    return items.select(F.col("item_id").cast("string").alias("i"), "text").mapInArrow(run, "i string, w array<long>")


def phrase_blocks(items: DataFrame, window: int = WINDOW, most: int | None = None) -> Iterator[Phrases]:
    """The test items as blocks of about ``most`` windows, made by grouped tasks and written to
    the shared folder; one at a time passes the driver.  Null and word-less texts have no
    windows.  Items with a null id have theirs, but no id to report."""
    most = most or BLOCK_WINDOWS
    pieces = tables.save(_pieces(items, window, max(1, most // 8)))
    words = pieces.agg(F.sum(F.size("w"))).first()[0] or 0

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("i").to_pylist()
        own = [np.array(w, dtype=np.int64).view(np.uint64) for w in group.column("w").to_pylist()]
        return pa.table({"block": [pickle.dumps(Phrases(ids, own, window))]})

    which = F.pmod(F.xxhash64("i", "w"), F.lit(max(1, -(-words // most)))).alias("k")
    for row in tables.save(pieces.groupBy(which).applyInArrow(build, "block binary")).toLocalIterator():
        yield pickle.loads(row.block)


def scan(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with the columns of ``COLUMNS`` (spans: runs of hit words, in words) added;
    columns of ``docs`` with such a name are replaced.

    Null, empty and word-less texts have no words and are clean; rows with equal or null ids
    are each scanned on their own; an empty test set leaves every text clean.  Items that share
    an id count as one; items without an id count for the hit words and ``contaminated``, not for
    ``n_items`` and the digest of the ids.  The test set goes to the executors in blocks of about
    ``BLOCK_WINDOWS``, of which a task holds one at a time.
    """
    spark = docs.sparkSession
    tables.small_batches(spark)
    blocks = [spark.sparkContext.broadcast(p) for p in phrase_blocks(items, window)]
    added = [c.split(" ")[0] for c in COLUMNS.split(", ")]
    kept = docs.select(*[c for c in docs.columns if c.lower() not in added])
    schema = StructType([*kept.schema, *StructType.fromDDL(COLUMNS)])
    text_at = next(i for i, c in enumerate(kept.columns) if c.lower() == "text")
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), span_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scan_batch(batch.column(text_at), blocks, window)
            cols = [pa.array(got[c], t) for c, t in zip(added, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *cols], names=[*batch.schema.names, *added])

    return tables.spread_out(kept).mapInArrow(run, schema)


def op9(spark, sf_dir: str) -> DataFrame:
    docs = tables.table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scan(docs, tables.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def decontaminated(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any occurrence of a test window, rows and columns as they came."""
    spark = docs.sparkSession
    tables.small_batches(spark)
    blocks = [spark.sparkContext.broadcast(p) for p in phrase_blocks(items, window)]
    text_at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scan_batch(batch.column(text_at), blocks, window)
            yield batch.filter(pa.array([not x for x in got["contaminated"]], pa.bool_()))

    return tables.spread_out(docs).mapInArrow(run, docs.schema)
