"""Counts over whole texts, many texts at a time in numpy. A word is a run of bytes other than space and tab to carriage return."""

from __future__ import annotations

import numpy as np

#: Class of each byte: 0 other, 1 white space, 2 upper case, 3 digit, 4 symbol, 5 exclamation mark, 6 other ASCII mark,
#: 7 continuation byte, 8 first byte of a letter beyond ASCII.
CLASSES = 9
CLASS = np.zeros(256, np.uint8)
CLASS[[9, 10, 11, 12, 13, 32]] = 1
CLASS[65:91] = 2
CLASS[48:58] = 3
CLASS[[x for x in b"\"'()+,-./:;=?@[\\]^_`{}~"]] = 6
CLASS[[x for x in b"#*$%&|<>"]] = 4
CLASS[ord("!")] = 5
CLASS[0x80:0xC0] = 7
CLASS[0xC0:] = 8

_LETTER = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) | np.uint64(1)
_PLACE = np.random.default_rng(12).integers(1, 1 << 63, 1024, dtype=np.uint64) | np.uint64(1)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def base_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The counts named in BASE."""
    words = text.split()
    n = len(words)
    chars = sum(map(len, words)) - int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) == 0x80))
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x and not x.isspace()]
    return n, chars, symbols, len(lines) - len(set(lines)), _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words in three-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    code = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    pair = code[:-1] * len(seen) + code[1:]
    if len(seen) > 2_000_000:  # else the next product could pass 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * len(seen) + code[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(n - 2, bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    covered[:-2] |= twice
    covered[1:-1] |= twice
    covered[2:] |= twice
    return int(covered.sum())


#: Words whose letters are hashed at a time.
HASHED = 1 << 15
PASSAGE = ("words", "doc_words", "chars", "upper", "digits", "symbols", "shouts", "marks", "foreign", "short", "distinct", "adjacent", "repeated")


def passages(texts: list[bytes], words_each: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(document of each passage, its features named in PASSAGE). Every text has a passage at least; one without words has zeros."""
    return passages_and_words(texts, words_each)[:2]


def n_passages(text: bytes, words_each: int = 64) -> int:
    """How many passages() makes of a text."""
    return max(1, -(-len(text.split()) // words_each))


def passages_and_words(texts: list[bytes], words_each: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """passages(), then the passage of each word, a 64-bit hash of each word, and whether it is the first of its passage, in
    order of the texts."""
    n_docs = len(texts)
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    kind = CLASS[data]
    white = kind == 1
    begins = np.flatnonzero(~white & np.concatenate([[True], white[:-1]]))
    if not len(begins):
        none = np.zeros(0, np.int64)
        return np.arange(n_docs), np.zeros((n_docs, len(PASSAGE)), np.float32), none, none.astype(np.uint64), none.astype(bool)
    ends = np.flatnonzero(white & np.concatenate([[False], ~white[:-1]]))
    doc_starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    doc = np.searchsorted(doc_starts, begins, side="right") - 1
    in_doc = np.bincount(doc, minlength=n_docs)
    nth = np.arange(len(begins)) - (np.cumsum(in_doc) - in_doc)[doc]
    first = nth % words_each == 0
    passage = np.cumsum(first) - 1
    heads = np.flatnonzero(first)
    at = begins[heads]
    count = [np.add.reduceat(kind == c, at, dtype=np.int64) for c in range(CLASSES)]
    size = np.diff(np.append(heads, len(begins)))
    chars = np.maximum(1, sum(count[c] for c in range(CLASSES) if c not in (1, 7)))
    edges = np.append(begins[::HASHED], len(data))
    words = np.concatenate([_hashes(data[a:b], white[a:b], begins[i * HASHED : (i + 1) * HASHED] - a) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    n = len(at)
    distinct = np.bincount(_first_of(passage, words), minlength=n)
    adjacent = np.zeros(len(words), bool)
    adjacent[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    again = _repeats(doc, words)
    short = ends - begins <= 3
    each = lambda x: np.bincount(passage[x], minlength=n) / size
    table = np.stack(
        [np.log1p(size), np.log1p(in_doc[doc[heads]]), chars / size]
        + [count[c] / chars for c in (2, 3, 4, 5, 6, 8)]
        + [each(short), distinct / size, each(adjacent), each(again)],
        axis=1,
    )
    missing = np.flatnonzero(in_doc == 0)
    owners = np.concatenate([doc[heads], missing])
    table = np.concatenate([table, np.zeros((len(missing), len(PASSAGE)))]).astype(np.float32)
    order = np.argsort(owners, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return owners[order], table[order], place[passage], words, first


def _hashes(data: np.ndarray, white: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """A hash of each word, from its letters and their places."""
    place = np.arange(len(data)) - begins[np.cumsum(np.bincount(begins, minlength=len(data))) - 1]
    return np.add.reduceat(np.where(white, np.uint64(0), _LETTER[data] * _PLACE[place & 1023]), begins)


def _keys(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    return words * np.uint64(0x9E3779B97F4A7C15) ^ (group.astype(np.uint64) + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)


def _first_of(group: np.ndarray, words: np.ndarray) -> np.ndarray:
    """The group of each distinct word of a group."""
    return group[np.unique(_keys(group, words), return_index=True)[1]]


def _repeats(doc: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Whether the pair that a word begins occurs again in its document."""
    out = np.zeros(len(words), bool)
    if len(words) > 1:
        inside = np.flatnonzero(doc[1:] == doc[:-1])
        keys = _keys(doc[inside], words[inside] * np.uint64(31) + words[inside + 1])
        order = np.argsort(keys)
        same = keys[order[1:]] == keys[order[:-1]]
        out[inside[order[1:][same]]] = True
        out[inside[order[:-1][same]]] = True
    return out
