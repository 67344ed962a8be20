"""Whole texts to token ids, with the tokenizers library and a bounded memo of words.

The tokenizers used here never merge across the start of a run of white space, so a text is the
concatenation of its space-separated chunks. Words repeat, so most chunks come from the memo; the
library encodes the rest. Texts in which that cut could matter are given to the library whole.
Strings that name special tokens are ordinary text, or, with ``special``, those tokens.
"""

from __future__ import annotations

import re
from array import array

from .common import kept

#: White space other than space and newline.
_ODD = [c for c in map(chr, range(0x3001)) if c.isspace() and c not in " \n"]
#: Words that pre-tokenizers leave as one piece, with a mark that they cut off.
_WORD = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([,.]?)")


def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level BPE has for each byte (as Latin-1): itself, or the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(spare)) for b in range(256)}


_BYTE = _byte_letters()


class _Memo(dict):
    """Chunk to packed ids; ``encode`` fills in what is missing. Keeps ``room`` chunks, those that came a second time."""

    def __init__(self, encode, room: int):
        super().__init__()
        self._encode, self._room, self._seen = encode, room, bytearray(1 << 22)

    def __missing__(self, chunk: str) -> bytes:
        ids = self._encode(chunk)
        if len(self) < self._room and len(chunk) < 100:
            slot = hash(chunk) & (1 << 22) - 1
            if self._seen[slot]:
                self[chunk] = ids
            self._seen[slot] = 1
        return ids


class TextEncoder:
    """Token ids of whole texts as packed little-endian integers of ``width`` bytes.

    ``path`` names a file of the tokenizers library. ``spaced`` says that a word's leading space is
    part of its token (byte-level BPE); otherwise white space is dropped. With ``special``, texts that
    name special tokens get the tokens' ids, as the library does by itself.
    """

    def __init__(self, path: str, spaced: bool, room: int = 250_000, special: bool = False):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = not special
        self._names = [t.content for t in self._library.get_added_tokens_decoder().values()] if special else []
        self._tokenize = self._library.model.tokenize
        self.width = 2 if self._library.get_vocab_size(with_added_tokens=True) <= 1 << 16 else 4
        self._code = "H" if self.width == 2 else "I"
        self._spaced = spaced
        self._mark = {mark: self._encode(mark) if mark else b"" for mark in ("", ",", ".")}
        self._inner = _Memo(lambda chunk: self._chunk(chunk, " " if spaced else ""), room)  # after a space
        self._first = _Memo(lambda chunk: self._chunk(chunk, ""), room // 10)

    def _encode(self, text: str) -> bytes:
        return array(self._code, self._library.encode(text, add_special_tokens=False).ids).tobytes()

    def _chunk(self, chunk: str, space: str) -> bytes:
        match = _WORD.fullmatch(chunk)
        if not match:
            return self._encode(space + chunk)
        word, mark = match.groups()
        letters = (space + word if self._spaced else word.lower()).encode().decode("latin-1").translate(_BYTE)
        return array(self._code, [t.id for t in self._tokenize(letters)]).tobytes() + self._mark[mark]

    def packed(self, text: str, end: int) -> bytes:
        """The ids of ``text``, then ``end``."""
        return self._ids(text) + array(self._code, [end]).tobytes()

    def _ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(c in text for c in _ODD) or any(name in text for name in self._names):
            return self._encode(text)
        inner, first = self._inner.__getitem__, self._first.__getitem__
        if not self._spaced:
            return b"".join(map(inner, text.split()))
        if "  " in text or " \n" in text or "\n " in text or "\n\n" in text or text[0] in " \n" or text[-1] in " \n":
            return self._encode(text)
        newline, lines = first("\n"), []
        for line in text.split("\n"):
            word, space, rest = line.partition(" ")
            lines.append(first(word) + b"".join(map(inner, rest.split(" "))) if space else first(word))
        return newline.join(lines)


def encoder(path: str, spaced: bool, special: bool = False) -> TextEncoder:
    """This Python worker's encoder for ``path``; its memo lives on over tasks, until the worker keeps something else."""
    return kept(f"tokens {path} {spaced} {special}", lambda: TextEncoder(path, spaced, special=special))
