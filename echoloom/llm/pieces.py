"""Whole-text tokenization by the `tokenizers` library, each distinct piece of a text encoded once.

Every id comes from that library, with its default settings. Neither vocabulary merges across the borders of its
pre-tokens, so a text may be cut at some of these borders and the ids of its pieces joined; a piece that came before is
not encoded again. Cuts are made only where they are certain: a text with unusual white space or control characters, or
one that may hold a special token's string, is handed to the library whole. A text of Latin letters, digits and ASCII
punctuation is cut into the vocabulary's own pre-tokens, another at its white space, which only separates words in the
word vocabulary and belongs to the word after it in the other.
"""

from __future__ import annotations

import json
import os
import re
import sys
from array import array
from collections.abc import Callable

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # an executor's cores are taken by its tasks

if sys.byteorder != "little" or array("I").itemsize != 4:
    raise ImportError("ids are kept as little-endian unsigned 32-bit integers")

#: White space and controls that the vocabularies' patterns and Python class differently, or that no cut is made at.
_ODD = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0\xad\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u3000\ufeff]")
#: The pre-tokens of the word vocabulary, for texts of these characters only: its own pattern says no more about them.
_USUAL = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_UNUSUAL = re.compile(rf"[^{_USUAL}!-~ \t\n\r]")
_PRE_TOKENS = re.compile(rf"[{_USUAL}]+|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{{-~]+|[0-9]")
#: The same for the byte vocabulary, whose pattern also takes white space.
_BYTE_PIECES = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_USUAL}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|[ \t\n\r]+(?![^ \t\n\r])|[ \t\n\r]+")
#: For other texts: the last of several spaces belongs to the word after them, a single line break stands alone, and
#: other white space before a word is cut in ways that need the word.
_RUNS = re.compile(r" ?[^ \t\n\r]+|[ \t\n\r]+(?= [^ \t\n\r])|\n(?=[^ \t\n\r])|[ \t\n\r]+[^ \t\n\r]+|[ \t\n\r]+")
#: Distinct pieces in a generation of the cache (two are kept) and the longest piece that is kept.
CACHE, LONGEST = 300_000, 200
#: What all special tokens' strings begin with.
SPECIAL = "<|"


def _stand_ins() -> dict[int, int]:
    """The printable characters that byte-level vocabularies write for bytes, by the characters of those bytes."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in own]
    return {b: 256 + i for i, b in enumerate(others)}


_STAND_INS = _stand_ins()
_SPACE = chr(_STAND_INS[ord(" ")])


class _Known(dict):
    """Ids of pieces, found when first asked for. A full one becomes the older generation of the next."""

    def __init__(self, find: Callable[[str], bytes], older: dict[str, bytes]):
        super().__init__()
        self.find, self.older = find, older

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.find(piece)
        if len(piece) <= LONGEST:
            self[piece] = ids
        return ids

    def renewed(self) -> _Known:
        return self if len(self) <= CACHE else _Known(self.find, {**self})


class Encoder:
    """Ids of whole texts as little-endian unsigned 32-bit bytes, those of Tokenizer.encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        special = {t["content"] for t in model["added_tokens"]}
        if not all(s.startswith(SPECIAL) for s in special):
            raise ValueError(f"special tokens are expected to begin with {SPECIAL}")
        self.words = model["model"]["end_of_word_suffix"] is not None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.size = max(vocabulary.values()) + 1
        # byte vocabularies write each byte as one character, special tokens as they are
        self.bytes_of = np.zeros(self.size, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token.encode()) if token in special else len(token)
        self.one, self.merges = (_PRE_TOKENS if self.words else _BYTE_PIECES), self.tokenizer.model
        self.known = _Known(self._find, {})

    def _find(self, piece: str) -> bytes:
        """A pre-token of usual characters needs the library's model alone, which takes it with a character for each byte."""
        if not self.one.fullmatch(piece):
            return self._library(piece)
        piece = piece.lower() if self.words else piece
        plain = piece.isascii() and piece.isprintable()  # of these only the space has a stand-in
        piece = piece.replace(" ", _SPACE) if plain else piece.encode().decode("latin-1").translate(_STAND_INS)
        return array("I", [t.id for t in self.merges.tokenize(piece)]).tobytes()

    def _library(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _cut(self, text: str) -> list[str] | None:
        """The pieces of a text, in order; None where it can't be cut."""
        if SPECIAL in text or _ODD.search(text):
            return None
        if _UNUSUAL.search(text):
            return text.split() if self.words else _RUNS.findall(text)
        return _PRE_TOKENS.findall(text.lower()) if self.words else _BYTE_PIECES.findall(text)

    def _encode(self, text: str) -> bytes:
        pieces = self._cut(text)
        return self._library(text) if pieces is None else b"".join(map(self.known.__getitem__, pieces))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Of each text, null as empty."""
        self.known = self.known.renewed()
        return [self._encode(t or "") for t in texts]

    def ids_and_spans(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, first character, character after the last) of each token; byte vocabularies only.

        Tokens that share a character, as its bytes are cut, all have it in their span.
        """
        if self.words:
            raise ValueError("a word vocabulary drops white space and has no exact spans here")
        ids = np.frombuffer(self.ids([text])[0], "<u4")
        ends = np.cumsum(self.bytes_of[ids])
        raw = np.frombuffer((text or "").encode(), np.uint8)
        character = np.cumsum((raw & 0xC0) != 0x80) - 1  # of each byte
        if len(ids) and ends[-1] != len(raw):
            raise ValueError("tokens don't cover the text")
        return ids, character[ends - self.bytes_of[ids]], character[ends - 1] + 1


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder of a vocabulary in each Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def slices(texts, most_rows: int = 512, most_bytes: int = 4 << 20):
    """(start, stop) of runs of an Arrow string column whose texts stay within a few MB, one text at least."""
    lengths = np.array([n or 0 for n in _lengths(texts)], np.int64)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (i - start >= most_rows or held + n > most_bytes):
            yield start, i
            start, held = i, 0
        held += int(n)
    if len(lengths) > start:
        yield start, len(lengths)


def _lengths(texts):
    import pyarrow.compute as pc

    return pc.binary_length(texts).to_pylist()
