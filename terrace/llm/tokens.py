"""Token ids of whole texts by a public tokenizer, one distinct pre-token at a time.

A byte-level BPE never merges across its pre-tokens, so a text's ids are its pre-tokens' ids in a row. A task keeps the
ids of the pre-tokens it has met, and the tokenizers library encodes each of the others once.
"""

from __future__ import annotations

import re
from functools import lru_cache

import public_tokenizers
import regex
from tokenizers import Tokenizer

#: Pre-tokens kept in a task: two generations of so many.
KEPT = 200_000

#: public_tokenizers.PATTERN for texts of Latin-1 letters only, where re is three times as fast as regex.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ÿ", "0-9²³¹¼-¾", " \\t-\\r\\x85\\xa0"
LATIN = rf" ?[{_L}]+| ?[{_N}]+|'(?:s|t|re|ve|m|ll|d)| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+"


class PieceCache(dict):
    """piece -> what `make` makes of it, for the pieces met lately. The older half goes when the younger is full."""

    def __init__(self, make, kept: int = KEPT):
        super().__init__()
        self._make, self._kept, self._old = make, kept, {}

    def __missing__(self, piece):
        old = self._old
        found = self[piece] = old[piece] if piece in old else self._make(piece)
        return found

    def trim(self) -> None:
        """Between texts only."""
        if len(self) > self._kept:
            self._old = dict(self)
            self.clear()


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, the others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class ByteBpe:
    """encode(text) -> the library's ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None, kept: int = KEPT):
        self.tokenizer = Tokenizer.from_file(path or public_tokenizers.path("byte_bpe_50k.json"))
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        letters = byte_letters()
        self._space, self._letters = letters[32], str.maketrans({chr(b): c for b, c in letters.items()})
        self._model = self.tokenizer.model
        self._model._resize_cache(0)  # pieces are kept here; the model's own cache only costs time
        self._bytes = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self._split = regex.compile(public_tokenizers.PATTERN).findall
        self._split_latin = re.compile(LATIN).findall
        self._kept, self._old, self._most = {}, {}, kept

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece[1:].isalpha():
            spelled = piece.replace(" ", self._space)
        else:
            spelled = piece.encode().decode("latin-1").translate(self._letters)
        as_bytes = self._bytes
        return b"".join([as_bytes[t.id] for t in self._model.tokenize(spelled)])

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):
            return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(text, add_special_tokens=False).ids])
        ids = b"".join(self.ids(self.pieces(text)))
        self.trim()
        return ids

    def pieces(self, text: str) -> list[str]:
        """The pre-tokens of a text without special strings."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._split(text)
        return self._split_latin(text)

    def ids(self, pieces: list[str]) -> list[bytes]:
        """The ids of each pre-token, which are kept until trim()."""
        kept = self._kept
        found = list(map(kept.get, pieces))
        at = -1
        try:
            while True:
                at = found.index(None, at + 1)
                piece = pieces[at]
                coded = kept.get(piece)  # it may have come before
                if coded is None:
                    coded = kept[piece] = self._old.get(piece) or self._piece(piece)
                found[at] = coded
        except ValueError:  # none is missing
            return found

    def trim(self) -> None:
        """Between texts: the older half of what is kept goes when the younger is full."""
        if len(self._kept) > self._most:
            self._old, self._kept = self._kept, {}


@lru_cache(maxsize=2)
def byte_bpe(path: str | None = None, kept: int = KEPT) -> ByteBpe:
    """One for all tasks of a Python worker."""
    return ByteBpe(path, kept)
