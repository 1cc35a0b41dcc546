"""Whole-text encoding with the ``tokenizers`` library, piece by piece.

Both tokenizers split a text into pieces before they merge bytes, and no piece
crosses the place where a non-space character meets a blank. So a text's ids
are those of its blank-separated chunks in order; each distinct chunk is
encoded once by the library and then looked up. Texts whose white space makes
that split unclear go to the library whole. Tests hold this against the
library's own encoding of whole texts.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Each Spark core has its own worker; threads within one would compete.
os.environ["TOKENIZERS_PARALLELISM"] = "false"

END_ID = 2
WORD = "word_bpe_49k.json"
BYTE = "byte_bpe_50k.json"

#: White space and invisible separators other than blank, tab, line feed and carriage return.
_ODD_SPACE = regex.compile(r"[\x0b\x0c\x1c-\x1f\x85\xa0 ᠎ -‍    ⁠　﻿]")
_TWO_SPACES = regex.compile(r"[ \t\n\r][ \t\n\r]")
#: How the two tokenizers split a text (fixed values of their files).
_WORD_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
_BYTE_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Longer chunks are rarely seen twice and aren't kept.
_KEEP_CHARS = 48


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


class _Kept(dict):
    """Remembers what ``make`` gave, in two generations of ``most`` entries."""

    def __init__(self, make, most: int):
        self._make, self._most, self._old = make, most, {}

    def __missing__(self, key: str) -> bytes:
        found = self._old.get(key)
        if found is None:
            found = self._make(key)
            if len(key) > _KEEP_CHARS:
                return found
        if len(self) >= self._most:
            self._old = self.copy()
            self.clear()
        self[key] = found
        return found

    def forget(self) -> None:
        self.clear()
        self._old = {}


class Encoder:
    """Encodes texts to little-endian id bytes.

    ``keep`` bounds the chunks and pieces remembered, so memory is bounded.
    """

    def __init__(self, path: str, keeps_space: bool, keep: int = 300_000):
        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._keeps_space = keeps_space
        self.dtype = np.dtype("<u2" if self._tokenizer.get_vocab_size() <= 65536 else "<u4")
        self._code = "H" if self.dtype.itemsize == 2 else "I"
        self._pieces = _Kept(self._piece, keep)
        self._chunks = _Kept(self._spaced if keeps_space else self._chunk, keep)

    def _library(self, text: str) -> bytes:
        found = self._tokenizer.encode(text, add_special_tokens=False)
        return np.array(found.ids, dtype=self.dtype).tobytes()

    def _piece(self, piece: str) -> bytes:
        """One piece that the tokenizer's splitter yields, merged by its model."""
        if not piece.isascii() or not piece.isprintable() or " " in piece:
            piece = piece.encode().decode("latin-1").translate(_LETTERS)
        return array(self._code, [x.id for x in self._model.tokenize(piece)]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        if not chunk.isascii() and max(chunk) > "\xff" or "<|" in chunk:
            return self._library(chunk)
        if self._keeps_space:
            if chunk[1:].isalpha():
                return self._piece(chunk)
            if chunk[1:-1].isalpha() and chunk[-1] in ",.":
                return self._piece(chunk[:-1]) + self._pieces[chunk[-1]]
            return b"".join(map(self._pieces.__getitem__, _BYTE_SPLIT.findall(chunk)))
        chunk = chunk.lower()
        if chunk.isalpha():
            return self._pieces[chunk]
        if chunk[-1] in ",." and chunk[:-1].isalpha():
            return self._pieces[chunk[:-1]] + self._pieces[chunk[-1]]
        return b"".join(map(self._pieces.__getitem__, _WORD_SPLIT.findall(chunk)))

    def _spaced(self, chunk: str) -> bytes:
        return self._chunk(" " + chunk)

    def encode(self, text: str | None) -> bytes:
        """All ids of one whole text; null is the empty text."""
        if not text:
            return b""
        if not text.isascii() and _ODD_SPACE.search(text) or text.isascii() and _ODD_ASCII.search(text):
            return self._library(text)
        if not self._keeps_space:
            return b"".join(map(self._chunks.__getitem__, text.split()))
        if _TWO_SPACES.search(text):
            return b"".join(map(self._chunk, _SPACED.findall(text)))
        first, *rest = text.split(" ")
        return (self._chunk(first) if first else b"") + b"".join(map(self._chunks.__getitem__, rest))

    def forget(self) -> None:
        """Give up what is remembered: a task's end, so that later stages have the memory."""
        self._chunks.forget()
        self._pieces.forget()

    def ids(self, text: str | None) -> np.ndarray:
        """The ids of a text as an array."""
        return np.frombuffer(self.encode(text), dtype=self.dtype)


_ODD_ASCII = regex.compile(r"[\x0b\x0c\x1c-\x1f]")
_SPACED = regex.compile(r"[ \t\n\r]*[^ \t\n\r]+|[ \t\n\r]+")

_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, name: str) -> Encoder:
    """The encoder of this Python worker, made once."""
    if (path, name) not in _encoders:
        _encoders[path, name] = Encoder(path, keeps_space=name == BYTE)
    return _encoders[path, name]


def tokenizer_path(name: str) -> str:
    return public_tokenizers.path(name)


def column(batch, name: str) -> list:
    """A column of an Arrow batch as Python values."""
    return batch.column(batch.schema.get_field_index(name)).to_pylist()
