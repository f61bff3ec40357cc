"""Spelling variants of the corpus' own words, by forward and backward minimal acyclic automata.

Words one error apart share their first or their second half. All words, in code-point order, are cut into ranges; each range
becomes a minimal acyclic automaton whose arcs carry strings, and which numbers its words: an arc knows how many words come
before those that pass it, so the path of a word adds up to its place in the range, where its count stands. A word goes to the
ranges that its first half's continuations span, follows that half exactly and completes it with one error. The reversed words
make backward automata, in which the second half is followed exactly and the first completed. What shares the first half is
left to the forward search, and a word of the dictionary leaves the query's path at one place only, so every near word is
found once.

Nothing is broadcast but the first and last word of each range, one pair for HELD words. A prefix that a third of all words
share is many ranges, and a query passes each that can hold its near words. A task holds one range's automaton, and answers a
query with the number of near words and the best of them, so no pairs are listed. Chains of forms are followed by pointer
doubling; counts double along a chain, so it ends.

A null or empty text has no words, and a null doc_id counts as an empty text in the hash. Every row counts: repeated rows count
again. A word may be as long as its text: chains without branches are one arc. Other columns are ignored, an empty table gives
no rows, and ties of the count go to the smallest form in code-point order.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points of a word, and its occurrences, at least; the share of runs that lose a code point is one in EVERY.
LETTERS, OCCURRENCES, EVERY = 5, 3, 97
#: Words of an automaton, and code points of them for each of these on the mean.
HELD, WIDTH = 65_536, 16
#: Different words, and code points of them, that a task counts before it passes the counts on.
MET, MET_WIDTH = 200_000, 4_000_000


def tallied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word, n of the texts of some batches, in parts: the same word may come again."""
    out = pa.schema([("word", pa.string()), ("n", pa.int64())])
    runs = re.compile(rf"[A-Za-zÀ-ÿ]{{{LETTERS},}}").findall  # shorter ones are no words, whatever they lose
    met: Counter[str] = Counter()
    width = 0
    for batch in common.slices(batches, 64):
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if not text:
                continue
            head = zlib.crc32(b":" if doc_id is None else b"%d:" % doc_id)
            for run, n in Counter(runs(text.encode().lower().decode())).items():  # bytes lower A-Z only
                h = zlib.crc32(run.encode(), head)
                if not h % EVERY:
                    run = run[: h % len(run)] + run[h % len(run) + 1 :]
                    if len(run) < LETTERS:
                        continue
                if run not in met:
                    width += len(run)
                met[run] += n
            if len(met) > MET or width > MET_WIDTH:
                yield common.record(out, [list(met), list(met.values())])
                met, width = Counter(), 0
    yield common.record(out, [list(met), list(met.values())])


def words_of(docs: DataFrame) -> DataFrame:
    """word, n: the words of all documents, with their occurrences."""
    counts = common.plain(docs).mapInArrow(tallied, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= OCCURRENCES)


def _shared(label: str, word: str, at: int) -> int:
    """How many code points of the label stand in the word from `at` on."""
    low, high = 0, min(len(label), len(word) - at)
    while low < high:
        mid = (low + high + 1) // 2
        if word.startswith(label[low:mid], at + low):
            low = mid
        else:
            high = mid - 1
    return low


class Automaton:
    """The minimal acyclic automaton of distinct words in code-point order, with each word's number: its place among them."""

    def __init__(self, words: list[str]):
        self.final: list[bool] = []
        self.count: list[int] = []
        #: by state and first code point: the arc's string, the state it leads to, the words of the state before the arc's
        self.arcs: list[dict[str, tuple[str, int, int]]] = []
        known: dict[tuple, int] = {}

        def state(final: bool, arcs: list[tuple[str, int]]) -> int:
            key = (final, *arcs)
            found = known.get(key)
            if found is None:
                found = known[key] = len(self.final)
                n, by_first = int(final), {}
                for label, to in arcs:
                    by_first[label[0]] = (label, to, n)
                    n += self.count[to]
                self.final.append(final)
                self.count.append(n)
                self.arcs.append(by_first)
            return found

        open_: list[tuple[int, bool, list[tuple[str, int]]]] = [(0, False, [])]  # the last word's path: depth, final, arcs so far

        def close(depth: int, word: str) -> None:
            while open_[-1][0] > depth:
                end, final, arcs = open_.pop()
                if open_[-1][0] < depth:
                    open_.append((depth, False, []))
                open_[-1][2].append((word[open_[-1][0] : end], state(final, arcs)))

        last = ""
        for word in words:
            close(_shared(last, word, 0), last)
            open_.append((len(word), True, []))
            last = word
        close(0, last)
        self.start = state(False, open_[0][2])

    def _number(self, label: str, j: int, state: int, number: int, word: str, at: int) -> int:
        """The number of the word that reads label[j:] and on as word[at:]; -1 if there is none."""
        while True:
            if not word.startswith(label[j:] if j else label, at):
                return -1
            at += len(label) - j
            if at == len(word):
                return number if self.final[state] else -1
            arc = self.arcs[state].get(word[at])
            if arc is None:
                return -1
            label, state, before = arc
            number, j = number + before, 0

    def _apart(self, label: str, j: int, state: int, number: int, word: str, i: int) -> list[int]:
        """Numbers of the words that leave the word's path at i for label[j], with that one error."""
        found = [self._number(label, j + 1, state, number, word, i)]  # label[j] is put in
        if i < len(word):
            found.append(self._number(label, j + 1, state, number, word, i + 1))  # for word[i]
            if word.startswith(label[j], i + 1):
                found.append(self._number(label, j + 1, state, number, word, i + 2))  # word[i] is left out
        return [x for x in found if x >= 0]

    def near(self, word: str, keep: int) -> list[int]:
        """Numbers of the words one error from the word that begin with its first `keep` code points, each once."""
        found: list[int] = []
        state, number, i, n = self.start, 0, 0, len(word)
        while True:
            if i >= keep:
                own = word[i] if i < n else ""
                if i == n - 1 and self.final[state]:
                    found.append(number)
                for c, (label, to, before) in self.arcs[state].items():
                    if c != own:
                        found += self._apart(label, 0, to, number + before, word, i)
            arc = self.arcs[state].get(word[i]) if i < n else None
            if arc is None:
                return found
            label, to, before = arc
            if not word.startswith(label, i):
                j = _shared(label, word, i)
                return found + self._apart(label, j, to, number + before, word, i + j) if i + j >= keep else found
            state, number, i = to, number + before, i + len(label)


def _best(numbers: list[int], words: list[str], counts: list[int], backward: bool) -> tuple[int, int, str] | None:
    """How many near words, the largest count and the smallest of the words that have it."""
    if not numbers:
        return None
    top = max(counts[k] for k in numbers)
    return len(numbers), top, min(words[k][::-1] if backward else words[k] for k in numbers if counts[k] == top)


def _halves(words: DataFrame, backward: bool, held: int) -> DataFrame:
    """word, n_near, form_n, form: of each word and each range that holds some, the near words that one direction finds."""
    size = words.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("word")), F.lit(0)).alias("width")).first()
    parts = max(1, -(-size["n"] // held), -(-size["width"] // (held * WIDTH)))
    key = F.reverse("word") if backward else F.col("word")
    ranged = words.select(key.alias("key"), "n").repartitionByRange(parts, "key").withColumn("part", F.spark_partition_id())
    ranged = common.written(ranged, "word-ranges")  # the ranges' ends are settled here
    ends = ranged.groupBy("part").agg(F.min("key").alias("low"), F.max("key").alias("high")).collect()  # a row for each range
    ends = sorted((r["low"], r["high"], r["part"]) for r in ends)
    lows, highs, numbers = [e[0] for e in ends], [e[1] for e in ends], [e[2] for e in ends]

    def exact(word: str) -> int:
        """Code points from the front that are followed exactly."""
        return len(word) - len(word) // 2 if backward else len(word) // 2

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("key", pa.string()), ("n", pa.int64()), ("part", pa.int32())])
        for batch in batches:
            keys, to = [], []
            for word in batch.column("key").to_pylist():
                half = word[: exact(word)]
                k = bisect_left(highs, half)
                while k < len(lows) and lows[k][: len(half)] <= half:
                    keys.append(word)
                    to.append(numbers[k])
                    k += 1
            yield common.record(out, [keys, [None] * len(keys), to])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("form_n", pa.int64()), ("form", pa.string())])
        here, words, counts, automaton = None, [], [], None
        for batch in common.slices(batches, 4096):
            found = []
            for word, n, part in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "part")), strict=True):
                if part != here:
                    here, words, counts, automaton = part, [], [], None
                if n is not None:  # the range's words come before its queries
                    words.append(word)
                    counts.append(n)
                    continue
                automaton = automaton or Automaton(words)
                near = automaton.near(word, exact(word))
                if backward:  # these share the first half, too: the forward automata have them
                    first = word[exact(word) :]
                    near = [k for k in near if not words[k].endswith(first)]
                if best := _best(near, words, counts, backward):
                    found.append((word[::-1] if backward else word, *best))
            yield common.record(out, list(zip(*found, strict=True)) or [[]] * 4)

    queries = ranged.select("key").mapInArrow(place, "key string, n long, part int")
    placed = ranged.select("key", "n", "part").union(queries).repartition("part").sortWithinPartitions("part", F.col("n").isNull(), "key")
    return placed.mapInArrow(search, "word string, n_near long, form_n long, form string")


def variants(docs: DataFrame, held: int = HELD) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words: near words are one error apart, the form is the near word of largest count
    if that is twice the word's, the root the last form of the chain."""
    words = common.written(words_of(docs), "words")
    near = _halves(words, False, held).union(_halves(words, True, held))
    best = F.min(F.struct((-F.col("form_n")).alias("less"), F.col("form").alias("form"))).alias("best")
    near = near.groupBy(F.col("word").alias("_word")).agg(F.sum("n_near").alias("n_near"), best)
    strong = -F.col("best.less") >= 2 * F.col("n")
    formed = words.join(near, F.col("word") == F.col("_word"), "left").select(
        "word", F.when(strong, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(strong, -F.col("best.less")).alias("form_n")
    )
    formed = common.written(formed, "formed-words")
    return formed.join(_roots(formed), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(formed: DataFrame) -> DataFrame:
    """word, root: the last form, of the words that have one. Each round doubles the steps that a word has gone."""
    up = common.written(formed.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = up.join(up.select(F.col("word").alias("_word"), F.col("root").alias("_root")), F.col("root") == F.col("_word"), "left")
        gone = common.written(on.select("word", F.coalesce("_root", "root").alias("root"), F.col("_root").isNotNull().alias("moved")), "roots")
        moved = gone.where("moved").limit(1).count()
        common.remove_written(up)
        up = gone.drop("moved")
        if not moved:
            return up


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Form and root of every word of the corpus. Null texts hold no words; repeated rows count again; ties go to the smaller form."""
    return variants(common.table(spark, sf_dir, "documents"))
