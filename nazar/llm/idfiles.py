"""Token ids in binary files: fixed-width bit packing with block offsets.

Every id takes the fewest bits that hold the vocabulary.  A file holds blocks of ids, each packed
from a whole byte on, then an index: the documents' ids and ends, and the byte offset of every
block, so a run of ids is read by seeking to its blocks and unpacking them with numpy.

    blocks | doc_id int64 x documents | null mask, a byte x documents | end uint64 x documents
    | offset uint64 x (blocks + 1) | ids a block uint32, bits uint32, ids uint64, documents uint64,
    place of the index uint64, b"TOKBITS1"          (all little-endian; ends count ids of the file)

Texts are dealt by range of the document's id and sorted; each task encodes its texts and
streams them to one file in the shared folder, so files in order of their number hold all
documents in order.  A task that is run again writes another file, and only the manifest row of
the one that Spark accepts names it.  Reading is dealt by file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from nazar.llm import tables, vocab
from nazar.session import ensure_checkpoint_dir

MAGIC = b"TOKBITS1"
TRAILER = struct.Struct("<IIQQQ8s")
#: Ids of a block; ids unpacked at once on reading (a longer document is read whole).
BLOCK, PIECE = 4_096, 1 << 20
#: Bytes of text that make a file, about.
FILE_BYTES = 64 << 20
#: Encoded words a task remembers, and new words encoded together.
HELD_WORDS, MARKED_WORDS = 1_000_000, 500
END_ID = 1


def bits_of(size: int) -> int:
    """The fewest bits that hold the ids 0 to size - 1."""
    return max(1, (size - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids one after the other, the lowest bit first, padded to a whole byte."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:
        return raw[:, :bits // 8].tobytes()
    return np.packbits(np.unpackbits(raw, axis=1, count=bits, bitorder="little"), bitorder="little").tobytes()


def unpack(data: bytes, n: int, bits: int) -> np.ndarray:
    raw = np.zeros((n, 4), dtype=np.uint8)
    if bits % 8 == 0:
        raw[:, :bits // 8] = np.frombuffer(data, np.uint8, n * bits // 8).reshape(n, -1)
    else:
        flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
        raw[:, :(bits + 7) // 8] = np.packbits(flat, axis=1, bitorder="little")
    return raw.view("<u4").ravel()


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


class IdWriter:
    """Streams documents to a file; holds one block of ids and the index."""

    def __init__(self, path: str, bits: int, block: int = BLOCK):
        system, at = _opened(path)
        system.create_dir(at.rsplit("/", 1)[0])
        self.out, self.bits, self.block = system.open_output_stream(at), bits, block
        self.open = np.zeros(0, dtype="<u4")
        self.doc_ids: list[int | None] = []
        self.ends: list[int] = []
        self.offsets = [0]
        self.n = 0

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.n += len(ids)
        self.doc_ids.append(doc_id)
        self.ends.append(self.n)
        self.open = np.concatenate([self.open, ids]) if len(self.open) else ids
        whole = len(self.open) // self.block * self.block
        for lo in range(0, whole, self.block):
            self._put(self.open[lo:lo + self.block])
        self.open = self.open[whole:]

    def close(self) -> None:
        if len(self.open):
            self._put(self.open)
        mask = np.array([d is None for d in self.doc_ids], dtype=np.uint8)
        index = self.offsets[-1]
        for part in (np.array([d or 0 for d in self.doc_ids], dtype="<i8"), mask, np.array(self.ends, dtype="<u8"), np.array(self.offsets, dtype="<u8")):
            self.out.write(part.tobytes())
        self.out.write(TRAILER.pack(self.block, self.bits, self.n, len(mask), index, MAGIC))
        self.out.close()


class IdReader:
    """Random access to the ids of a file: only the blocks that hold them are read."""

    def __init__(self, path: str):
        system, at = _opened(path)
        self.file = system.open_input_file(at)
        size = self.file.size()
        self.block, self.bits, self.n, docs, index, magic = TRAILER.unpack(self.file.read_at(TRAILER.size, size - TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        raw = self.file.read_at(size - TRAILER.size - index, index)
        at_ends = docs * 9
        self.doc_ids = np.frombuffer(raw, "<i8", docs)
        self.null = np.frombuffer(raw, np.uint8, docs, docs * 8).astype(bool)
        self.ends = np.frombuffer(raw, "<u8", docs, at_ends).astype(np.int64)
        self.offsets = np.frombuffer(raw, "<u8", -1, at_ends + docs * 8).astype(np.int64)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """The ids at the places start to stop - 1 of the file."""
        if stop <= start:
            return np.zeros(0, dtype="<u4")
        first, last = start // self.block, (stop - 1) // self.block
        data = self.file.read_at(int(self.offsets[last + 1] - self.offsets[first]), int(self.offsets[first]))
        to = min(self.n, (last + 1) * self.block)
        if self.block * self.bits % 8 == 0:  # blocks follow each other without padding
            found = unpack(data, to - first * self.block, self.bits)
        else:
            cuts = self.offsets[first:last + 2] - self.offsets[first]
            found = np.concatenate([unpack(data[lo:hi], min(self.block, self.n - b * self.block), self.bits)
                                    for b, lo, hi in zip(range(first, last + 1), cuts[:-1], cuts[1:], strict=True)])
        return found[start - first * self.block:stop - first * self.block]

    def documents(self, piece: int = PIECE) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, place of the first id, ids) of every document in order."""
        k = 0
        while k < len(self.ends):
            start = int(self.ends[k - 1]) if k else 0
            to = max(k + 1, int(np.searchsorted(self.ends, start + piece, "right")))
            held = self.ids(start, int(self.ends[to - 1]))
            at = start
            for j in range(k, to):
                end = int(self.ends[j])
                yield None if self.null[j] else int(self.doc_ids[j]), at, held[at - start:end - start]
                at = end
            k = to

    def close(self) -> None:
        self.file.close()


class WordEncoder:
    """Ids of texts for a tokenizer that drops white space before it makes tokens, so that no
    token, and no step of its normaliser, reaches across ASCII white space: a text's ids are those
    of its words one after the other, and each distinct word is encoded once.

    The tokenizer lowers all letters and cuts between a letter or digit and a sign, so texts are
    lowered first (unless one may hold a special token) and a word's closing signs are a word of
    their own.  New words are encoded together.  A word of letters is one piece for the tokenizer
    and ends with a token that closes a word; others stand between marks, a control character
    that alone is a word of one token.  Words that hold that character are encoded by themselves.
    """

    MARK = b"\x01"
    SIGNS = b".,;:!?"

    def __init__(self, data: bytes):
        self.tokenizer = vocab.tokenizer(data, False)
        self.known: dict[bytes, bytes] = {b"": b""}  # before and after white space at an end
        mark = self._ids(self.MARK.decode())
        self.mark = int(mark[0]) if len(mark) == 1 else None
        size = self.tokenizer.get_vocab_size()
        self.closing = np.array([(self.tokenizer.id_to_token(i) or "").endswith("</w>") for i in range(size)])

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, fresh: list[bytes]) -> None:
        ends = {}
        for w in fresh:
            core = w.rstrip(self.SIGNS)
            if len(core) < len(w) and core[-1:].isalnum():  # an ASCII letter or digit
                ends[w] = core, w[len(core):]
        self._encode(list({*fresh, *(x for pair in ends.values() for x in pair)} - ends.keys() - self.known.keys()))
        self.known.update((w, self.known[a] + self.known[b]) for w, (a, b) in ends.items())

    def _encode(self, fresh: list[bytes]) -> None:
        letters, signs = [], []
        for w in fresh:
            t = w.decode()
            # one piece for the tokenizer: letters that its normaliser keeps
            plain = t.isalpha() and (t.isascii() or t == t.lower() and is_normalized("NFC", t))
            (letters if plain else signs).append(w)
        for lo in range(0, len(letters), MARKED_WORDS):
            some = letters[lo:lo + MARKED_WORDS]
            ids = self._ids(b" ".join(some).decode())
            if not self._cut(some, ids, np.flatnonzero(self.closing[ids]) * 4 + 4, 0):
                signs += some
        alone = [w for w in signs if self.mark is None or self.MARK in w]
        self.known.update((w, self._ids(w.decode()).tobytes()) for w in alone)
        joint = [w for w in signs if self.MARK not in w] if alone else signs
        for lo in range(0, 0 if self.mark is None else len(joint), MARKED_WORDS):
            some = joint[lo:lo + MARKED_WORDS]
            ids = self._ids((b" " + self.MARK + b" ").join([*some, b""]).decode())
            self._cut(some, ids, np.flatnonzero(ids == self.mark) * 4, 4)

    def _cut(self, words: list[bytes], ids: np.ndarray, ends: np.ndarray, gap: int) -> bool:
        """Keep the ids of the words, cut at byte ``ends`` with ``gap`` bytes between; whether
        there are as many ends as words."""
        if len(ends) != len(words):
            return False
        raw = ids.tobytes()
        starts = [0, *(ends[:-1] + gap).tolist()]
        self.known.update((w, raw[a:b]) for w, a, b in zip(words, starts, ends.tolist(), strict=True))
        return True

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        col = pa.array(texts, pa.string())
        col = pc.if_else(pc.match_substring(col, "<|"), col, pc.ascii_lower(col))
        lists = pc.ascii_split_whitespace(col)
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary.cast(pa.binary()).to_pylist()
        if len(self.known) + len(words) > HELD_WORDS:
            self.known = {w: self.known[w] for w in (b"", *words) if w in self.known}
        self._learn([w for w in words if w not in self.known])
        found = [self.known[w] for w in words]
        ids = np.frombuffer(b"".join(found), "<u4")
        size = np.fromiter(map(len, found), dtype=np.int32, count=len(found)) // 4
        # each place's word, laid out as its run of ids
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = size[at]
        after = np.cumsum(n)
        total = int(after[-1]) if len(after) else 0
        kind = np.int32 if total < 1 << 31 else np.int64
        first = ((np.cumsum(size) - size)[at] - (after - n)).astype(kind)
        laid = ids[np.repeat(first, n) + np.arange(total, dtype=kind)]
        ends = np.concatenate([[0], after])[lists.offsets.to_numpy()]
        return [laid[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class TextEncoder:
    """Ids of texts for any tokenizer."""

    def __init__(self, data: bytes):
        self.tokenizer = vocab.tokenizer(data, False)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, dtype="<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]


def write(docs: DataFrame, folder: str | None = None, path: str | None = None, by_word: bool = True, end_id: int = END_ID, file_bytes: int = FILE_BYTES) -> DataFrame:
    """file (its number), path, n_ids, n_docs, start (ids of all files before it): the manifest of
    the files written to ``folder``, by default a new one in the shared folder of
    ``spark.checkpoint.dir``.  ``by_word`` (see WordEncoder) suits the default vocabulary.

    Documents ascend by id, null ids first; of one id, by a hash of the text.  A null or empty
    text has the end id alone.  An empty table writes no file.
    """
    spark = docs.sparkSession
    tables.small_batches(spark)
    data = vocab.file_bytes(path or vocab.default_path("word_bpe_49k.json"))
    bits = bits_of(max(end_id + 1, vocab.tokenizer(data, False).get_vocab_size()))
    shared = spark.sparkContext.broadcast(data)
    folder = folder or f"{ensure_checkpoint_dir(spark)}/nazar-ids/{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = (WordEncoder if by_word else TextEncoder)(shared.value)
        number = TaskContext.get().partitionId()
        name = f"{folder}/ids-{number:06d}-{uuid.uuid4().hex[:8]}.bits"
        out = None
        end = np.array([end_id], dtype="<u4")
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for doc_id, ids in zip(b.column(0).to_pylist(), encode(texts), strict=True):
                out = out or IdWriter(name, bits)
                out.add(doc_id, np.concatenate([ids, end]))
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (number, name, out.n, len(out.ends))], names=["file", "path", "n_ids", "n_docs"])

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = src.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    files = max(spark.sparkContext.defaultParallelism, -(-size // file_bytes))
    # equal rows of one id are told apart by their place, so no range holds more than its share
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("place")]
    keyed = src.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id())
    dealt = keyed.repartitionByRange(files, *order).sortWithinPartitions(*order).select("doc_id", "text")
    written = tables.save(dealt.mapInArrow(run, "file long, path string, n_ids long, n_docs long"))
    before = F.coalesce(F.sum("n_ids").over(W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # a row a file
    return tables.save(written.withColumn("start", before))


def _read(manifest: DataFrame, columns: str, make) -> DataFrame:
    """The rows ``make`` gives for the documents of a file (a list of (doc_id, start, ids))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = IdReader(path)
                held: list[tuple] = []
                size = 0
                for doc_id, at, ids in reader.documents():
                    held.append((doc_id, start + at, ids))
                    size += len(ids)
                    if size >= PIECE:
                        yield make(held)
                        held, size = [], 0
                if held:
                    yield make(held)
                reader.close()

    files = max(1, manifest.count())
    return manifest.select("path", "start").repartition(files).mapInArrow(run, columns)


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids: one row a document of the files."""
    def make(held: list[tuple]) -> pa.RecordBatch:
        doc_id, start, ids = zip(*held, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return _read(manifest, "doc_id long, start long, ids array<long>", make)


def checksums(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    def make(held: list[tuple]) -> pa.RecordBatch:
        doc_id, start, ids = zip(*held, strict=True)
        crc = [zlib.crc32(x.astype("<u4", copy=False).tobytes()) for x in ids]
        cols = [pa.array(c, pa.int64()) for c in (doc_id, start, [len(x) for x in ids], crc)]
        return pa.RecordBatch.from_arrays(cols, names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return _read(manifest, "doc_id long, start long, n_tokens long, ids_crc32 long", make)


def op13(spark, sf_dir: str) -> DataFrame:
    return checksums(write(tables.table(spark, sf_dir, "documents")))
