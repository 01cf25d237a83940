"""Words of whole texts as 64-bit hashes, computed on the UTF-8 bytes of an Arrow batch.

A word is a maximal run of ASCII letters and digits and of non-ASCII code points, with
A-Z lowered: ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the lowered text.  Every byte of a
non-ASCII code point is 0x80 or above, so the same runs are found on bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; temporary arrays are a small multiple of it.
SLICE_BYTES = 1 << 19
#: Bytes hashed at once: the length of the table of powers.
BLOCK = 1 << 19

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C1B)  # odd, 3 mod 8


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=_U)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values (bijective)."""
    h = h ^ (h >> _U(31))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(29))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


_PIECES: dict[str, np.ndarray] = {}


def _tables() -> dict[str, np.ndarray]:
    """Per byte a 64-bit value (0 for separators), and powers of the base and its inverse."""
    if not _PIECES:
        b = np.arange(256)
        lower = np.where((b >= 65) & (b <= 90), b + 32, b)
        word = ((lower >= 97) & (lower <= 122)) | ((b >= 48) & (b <= 57)) | (b >= 128)
        _PIECES["word"] = word
        _PIECES["value"] = np.where(word, mix((lower + 1).astype(_U)) | _U(1), _U(0))
        _PIECES["power"] = _powers(_BASE, BLOCK + 1)
        _PIECES["inverse"] = _powers(_U(pow(int(_BASE), -1, 1 << 64)), BLOCK + 1)
    return _PIECES


def text_slices(col: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about ``most`` bytes together; a longer
    text is a run of its own.  Null texts are empty."""
    for arr in col.chunks if isinstance(col, pa.ChunkedArray) else [col]:
        arr = pc.fill_null(arr.cast(pa.large_string()), "")
        n = len(arr)
        if not n:
            continue
        _, off, data = arr.buffers()
        offs = np.frombuffer(off, dtype=np.int64)[arr.offset:arr.offset + n + 1]
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        row = 0
        while row < n:
            to = max(row + 1, int(np.searchsorted(offs, offs[row] + most, "right")) - 1)
            yield row, raw[offs[row]:offs[to]], offs[row:to + 1] - offs[row]
            row = to


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text index, byte start) of every word of the texts, in order."""
    t = _tables()
    is_word = t["word"][data]
    begin = is_word.copy()
    begin[1:] &= ~is_word[:-1]
    edges = offsets[1:-1]
    edges = edges[edges < len(data)]
    begin[edges] = is_word[edges]  # a text begins a new word
    starts = np.flatnonzero(begin)
    hashes = np.empty(len(starts), dtype=_U)
    at = 0
    while at < len(starts):
        first = int(starts[at])
        to = max(at + 1, int(np.searchsorted(starts, first + BLOCK, "left")))
        last = int(starts[to]) if to < len(starts) else len(data)
        if last - first > BLOCK:  # the last word of the block may cross its end
            to = max(at + 1, to - 1)
            last = int(starts[to]) if to < len(starts) else len(data)
        if last - first > BLOCK:  # a long word, or one before a long gap
            gap = np.flatnonzero(~is_word[first:last])
            last = first + int(gap[0]) if len(gap) else last
        block = t["value"][data[first:last]]
        if len(block) <= BLOCK:
            own = np.add.reduceat(block * t["power"][:len(block)], starts[at:to] - first)
            hashes[at:to] = own * t["inverse"][starts[at:to] - first]
        else:
            h = _U(0)
            for k in range(0, len(block), BLOCK):
                part = block[k:k + BLOCK]
                h = h * _U(0xD6E8FEB86659FD93) + np.add.reduce(part * t["power"][:len(part)])
            hashes[at] = h
        at = to
    text = np.searchsorted(offsets, starts, "right") - 1
    return mix(hashes), text, starts


def shingles(hashes: np.ndarray, text: np.ndarray, n_texts: int, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of every run of ``size`` words inside one text; a text of fewer words,
    but not none, has one shingle of all its words."""
    n = len(hashes)
    if n == 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    odd = mix(np.arange(1, size + 1, dtype=_U)) | _U(1)
    if n >= size:
        whole = text[:n - size + 1] == text[size - 1:]
        h = np.zeros(n - size + 1, dtype=_U)
        for j in range(size):
            h += hashes[j:n - size + 1 + j] * odd[j]
        out_h, out_t = mix(h[whole]), text[:n - size + 1][whole]
    else:
        out_h, out_t = np.zeros(0, _U), np.zeros(0, np.int64)
    count = np.bincount(text, minlength=n_texts)
    if not ((count > 0) & (count < size)).any():
        return out_h, out_t
    short = (count < size)[text]
    rank = np.arange(n) - (np.cumsum(count) - count)[text]
    piece = hashes[short] * odd[np.minimum(rank[short], size - 1)]
    own, first = np.unique(text[short], return_index=True)
    few = mix(np.add.reduceat(piece, first) + count[own].astype(_U))
    all_h, all_t = np.concatenate([out_h, few]), np.concatenate([out_t, own])
    order = np.argsort(all_t, kind="stable")
    return all_h[order], all_t[order]
