"""Byte-pair encoding as a deterministic automaton over tokens.

The automaton accepts the token sequences that byte-pair encoding yields. It starts as one state that every symbol loops
on. Each merge a b -> ab, in order of rank, is a gadget: arcs labelled a are led to a copy of their state that has no arc
b; arcs labelled ab join wherever an arc a leaves, and enter a copy of what b entered. All arcs of one label enter one
state, so a state is known by its label. The gadgets are run once, when the tokenizer is loaded, and leave a table of all
arcs that each state lost, with the rank at which it did (some 900,000 entries for 49,000 states); every other arc u of a
state leads to the state u. An arc goes with the left part it is made from: u is missing if u is lost, or if its left part
was lost when u was made.

A word is read left to right, symbol by symbol: the labels that may still end are nodes of a trie, stepped by its tables, and
where one ends, the table of lost arcs says whether its state has the arc; what it said of a state and an arc is kept, so that
most transitions are one look-up. Exactly one arc ends at each place whose source is
the state reached at its start, so one pass finds the path, in time linear in the word. Decoding emits the labels of the arcs.

A null or empty text has no ids. Texts in Latin-1 letters are split by a pattern here, stretches of others that have more by the
library's own normalizer and pre-tokenizer, whose letter tables may be older or newer than ours. Repeated and null doc_ids are encoded row
by row, other columns are ignored, an empty table yields no rows, and a word may be as long as its text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from . import common
from .tokens import _L, _N, _S, PieceCache, byte_letters


#: Pairs of a state and an arc whose answer is kept.
KNOWN = 1 << 20


class Automaton:
    """The automaton of an ordered list of merges over a vocabulary of symbols and tokens. A symbol is a letter, or the letter and
    `end` that closes a word."""

    def __init__(self, vocab: dict[str, int], merges: Iterable[tuple[str, str]], end: str = ""):
        n = max(vocab.values()) + 1
        merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        self._states = n
        #: by state and arc: the rank of the gadget that took the arc from the state
        self.lost: dict[int, int] = {}
        self._spine: list[tuple[tuple[int, int], ...]] = [((t, len(merges)),) for t in range(n)]  # the left parts of each token, and when they were used
        of_state: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        dead = set()
        for rank, (a, b, ab) in enumerate(merges):
            if dead.intersection((a, b)) or not self.step(a, b):
                dead.add(ab)  # an earlier merge takes its parts apart: its gadget finds no arcs, adds none and takes none
                continue
            of_state[ab] = list(of_state[b])
            for arc, when in of_state[ab]:
                self.lost[ab * n + arc] = when
            of_state[a].append((b, rank))
            self.lost[a * n + b] = rank
            self._spine[ab] += ((a, rank), *self._spine[a][1:])
        #: the trie of labels: by symbol the next node, under None the token that ends there
        self.labels: dict = {}
        self._end = end
        for label, t in vocab.items():
            if t not in dead:
                closed = bool(end) and label.endswith(end)
                node = self.labels
                for c in self._read(label.removesuffix(end), closed):
                    node = node.setdefault(c, {})
                node[None] = t
        #: by state and arc: whether the state has the arc, as found so far
        self._known: dict[int, bool] = {}

    def _read(self, word: str, closed: bool) -> list[str]:
        out = list(word)
        if closed and out:
            out[-1] += self._end
        return out

    def step(self, state: int, arc: int) -> bool:
        """Whether the state has the arc, which then leads to the state of its own name."""
        base, lost = state * self._states, self.lost
        for part, used in self._spine[arc]:
            when = lost.get(base + part)
            if when is not None and when <= used:  # equal: a a -> aa leaves no aa after a
                return False
        return True

    def encode(self, word: str) -> tuple[int, ...]:
        """Ids along the word's path. A word without a path has none."""
        root, known, states = self.labels, self._known, self._states
        if len(known) > KNOWN:
            known.clear()
        symbols = self._read(word, True)
        arc, source = [-1] * (len(symbols) + 1), [0] * (len(symbols) + 1)
        open_: list[tuple[int, dict]] = []  # where labels that may still end began, and their nodes
        for at, c in enumerate(symbols, 1):
            if at == 1 or arc[at - 1] >= 0:
                open_.append((at - 1, root))
            still = []
            for start, node in open_:
                node = node.get(c)
                if node is None:
                    continue
                still.append((start, node))
                u = node.get(None, -1)
                if u >= 0 and arc[at] < 0:
                    if start:
                        key = arc[start] * states + u
                        has = known.get(key)
                        if has is None:
                            has = known[key] = self.step(arc[start], u)
                        if not has:
                            continue
                    arc[at], source[at] = u, start
            open_ = still
        path, at = [], len(symbols)
        if arc[at] < 0:
            return ()
        while at:
            path.append(arc[at])
            at = source[at]
        return tuple(reversed(path))


class WordBpe:
    """encode(text) and decode(ids) as the tokenizers library does with a lower-casing vocabulary of word ends."""

    def __init__(self, path: str | None = None):
        path = path or public_tokenizers.path("word_bpe_49k.json")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        self.labels = [labels.get(i, "") for i in range(max(labels) + 1)]
        self._at_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split
        library = Tokenizer.from_file(path)
        self._normalize, self._split = library.normalizer.normalize_str, library.pre_tokenizer.pre_tokenize_str
        self._split_latin = re.compile(rf"[{_L}]+|[{_N}]|'(?:s|t|re|ve|m|ll|d)|[^{_S}{_L}{_N}]+").findall
        self._letters = byte_letters()
        self._stretches = re.compile(r"[^ \t-\r]+").findall  # no rule reaches over such white space
        self._cache, self._spelled, self._mixed = PieceCache(self._word), PieceCache(self.automaton.encode), PieceCache(self._stretch)

    def _word(self, word: str) -> tuple[int, ...]:
        letters = self._letters
        return self.automaton.encode("".join([letters[b] for b in word.encode()]))

    def _stretch(self, stretch: str) -> tuple[int, ...]:
        """Ids of a stretch of text without white space."""
        try:
            stretch.encode("latin-1")
        except UnicodeEncodeError:
            words, cache = self._split(self._normalize(stretch)), self._spelled
            return tuple(chain.from_iterable([cache[w] for w, _ in words]))
        cache = self._cache
        return tuple(chain.from_iterable([cache[w] for w in self._split_latin(stretch.lower())]))

    def _plain(self, text: str) -> list[int]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            cache = self._mixed
            return list(chain.from_iterable([cache[x] for x in self._stretches(text)]))
        cache = self._cache
        return list(chain.from_iterable([cache[w] for w in self._split_latin(text.lower())]))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if "<|" in text and any(s in text for s in self.special):
            ids = []
            for i, part in enumerate(self._at_special(text)):
                ids += [self.special[part]] if i % 2 else self._plain(part)
        else:
            ids = self._plain(text)
        self._cache.trim()
        self._spelled.trim()
        self._mixed.trim()
        return ids

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join(map(self.labels.__getitem__, ids))


@lru_cache(maxsize=2)
def word_bpe(path: str | None = None) -> WordBpe:
    """One for all tasks of a Python worker."""
    return WordBpe(path)


def token_ids(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, ids, decoded of each document's whole text; a null or empty text has no ids."""

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])
        for batch in common.slices(batches):
            ids = [bpe.encode(t) for t in batch.column("text").to_pylist()]
            yield common.record(out, [batch.column("doc_id"), ids, [bpe.decode(x) for x in ids]])

    return common.plain(docs).mapInArrow(encoded, "doc_id long, ids array<int>, decoded string")


def digests(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: ids and decoded text stay in the task.

    One row for each row of docs, repeated and null ids included; other columns are ignored.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer_path)
        decimal = [str(i) for i in range(len(bpe.labels))]
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in common.slices(batches):
            n, h, d = [], [], []
            for text in batch.column("text").to_pylist():
                ids = bpe.encode(text)
                n.append(len(ids))
                h.append(sha(" ".join(map(decimal.__getitem__, ids))))
                d.append(sha(bpe.decode(ids)))
            yield common.record(out, [batch.column("doc_id"), n, h, d])

    return common.plain(docs).mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op6_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and digests of every document's ids and decoded text. Null and empty texts have none; rows of one doc_id are encoded each."""
    return digests(common.table(spark, sf_dir, "documents"))
