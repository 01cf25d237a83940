"""Files of public tokenizers for the tasks: read once where the session runs and broadcast
(a few MB each), so executors need no copy of the path; a worker builds each tokenizer once."""

from __future__ import annotations

import hashlib
import os

import numpy as np

_BUILT: dict[tuple[str, str], object] = {}


def default_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def file_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def _built(kind: str, data: bytes, build):
    key = (kind, hashlib.sha256(data).hexdigest())
    if key not in _BUILT:
        _BUILT[key] = build()
    return _BUILT[key]


def tokenizer(data: bytes, plain: bool):
    """A tokenizer of the tokenizers library; ``plain``: special tokens' strings are ordinary text."""
    def build():
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals the work out
        from tokenizers import Tokenizer
        t = Tokenizer.from_buffer(data)
        t.encode_special_tokens = plain
        t.no_truncation()  # whole texts
        t.no_padding()
        return t
    return _built(f"bpe{plain}", data, build)


def piece_model(data: bytes):
    def build():
        import sentencepiece
        return sentencepiece.SentencePieceProcessor(model_proto=data)
    return _built("piece", data, build)


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters for themselves, the others in order from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = sorted(set(range(256)) - set(shown))
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Tokens:
    """Bytes, and decimal digits, of each id of a vocabulary."""

    def __init__(self, pieces: list[bytes]):
        self.bytes = pieces
        self.length = np.array([len(p) for p in pieces], dtype=np.int64)
        wide = len(str(max(0, len(pieces) - 1))) + 1
        # an id's digits, and a place for what separates it from the next
        self.digits = np.array([str(i).ljust(wide) for i in range(len(pieces))], dtype=f"S{wide}").view(np.uint8).reshape(len(pieces), wide)
        self.shown = np.array([len(str(i)) for i in range(len(pieces))], dtype=np.int64)

    def __len__(self) -> int:
        return len(self.bytes)


def byte_level_tokens(data: bytes) -> Tokens:
    """Of a byte-level vocabulary of the tokenizers library; added tokens that are no byte-level
    strings stand for themselves in UTF-8."""
    def build():
        t, of = tokenizer(data, True), byte_alphabet()
        names = [t.id_to_token(i) or "" for i in range(t.get_vocab_size())]
        return Tokens([bytes(of[c] for c in n) if all(c in of for c in n) else n.encode() for n in names])
    return _built("byte tokens", data, build)


def piece_tokens(data: bytes) -> Tokens:
    """Of a sentencepiece model: U+2581 is a space, <0xHH> the byte HH."""
    def build():
        m = piece_model(data)
        out = []
        for i in range(m.get_piece_size()):
            piece = m.id_to_piece(i)
            out.append(bytes([int(piece[3:5], 16)]) if m.is_byte(i) else piece.replace("▁", " ").encode())
        return Tokens(out)
    return _built("piece tokens", data, build)
