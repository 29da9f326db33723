"""Token ids of whole texts with a public tokenizer file, remembered per chunk.

The word tokenizer drops white space and never looks across it, so the ids of a
text are the ids of its white-space-separated chunks in order. A worker keeps the
ids of the chunks and words it has met; the memory is bounded and forgetting
costs time only.
"""

from __future__ import annotations

import re
import struct

MOST_CHUNKS = 900_000
MOST_WORDS = 600_000

# The word pattern of the tokenizer file, for printable ASCII and Western letters.
WORD = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[!-/:-@\[-`{-~]+")
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")


def _byte_letters() -> dict[int, int]:
    """The printable letter that stands for each byte value in byte-level vocabularies."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = (b for b in range(256) if b not in printable)
    return {b: 0x100 + n for n, b in enumerate(other)}


class _Memo(dict):
    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, key):
        found = self[key] = self.encode(key)
        return found


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = _byte_letters()
        self.words = _Memo(self._word)
        self.chunks = _Memo(self._chunk)

    def _word(self, word: str) -> bytes:
        stand_in = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return packed([t.id for t in self.tokenizer.model.tokenize(stand_in)])

    def _chunk(self, chunk: str) -> bytes:
        if PLAIN.fullmatch(chunk) and "<|" not in chunk:
            return b"".join(map(self.words.__getitem__, WORD.findall(chunk.lower())))
        return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)

    def ids(self, text: str) -> bytes:
        if len(self.chunks) > MOST_CHUNKS:
            self.chunks.clear()
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        # Blank, tab and line breaks only: other white space stays inside a chunk for the tokenizer to judge.
        if not text.isascii() or any(c in text for c in "\x0b\x0c\x1c\x1d\x1e\x1f"):
            parts = re.split(r"[ \t\n\r]+", text)
        else:
            parts = text.split()
            if "<|" not in text:  # lower case is the same letter by letter
                parts = text.lower().split()
        return b"".join(map(self.chunks.__getitem__, filter(None, parts)))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of this worker process for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
