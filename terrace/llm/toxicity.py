"""Toxicity by weak supervision.

Voters look at a whole text and vote toxic (1), clean (-1) or nothing (0): lexicons of insults by theme, patterns for
threats and for disguised spelling, lexicons mined from the labelled rows, and voters for clean texts. Mined lexicons vote by
cross-fitting: on a labelled row vote those that were mined from the other folds, so that their accuracies are honest.

A generative model of a hidden class and the votes is fitted by expectation maximisation to the votes of a bounded sample.
Voters correlate: within the class each vote hangs on one other voter's, along the maximum spanning tree of the conditional
mutual information. Labels serve to estimate the voters' accuracies and correlations, and nothing else: the linear classifier
on votes and words is trained on the model's posterior, for labelled and unlabelled rows alike. It scores all documents, task
by task and without a shuffle.

Votes and the distinct words of a sampled text go to the driver, not texts: of the sampled rows as many as have SENT bytes of words. A null or empty text gets the score of a text
without votes or words. Repeated or null doc_ids are scored row by row; other columns are ignored; an empty table yields no
rows. Without labelled rows the lexicons' starting accuracies stand.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled rows of each kind, and unlabelled rows, that the models are fitted on.
SAMPLE, UNLABELLED = 2500, 2500
#: Words of the linear classifier at most, each of five standard deviations from chance.
WORDS = 500
#: Bytes of the distinct words of all sampled rows, and folds of the mined lexicons.
SENT, FOLDS = 24_000_000, 3

#: Common insults by theme.
LEXICONS = {
    "wit": "idiot idiots idiotic moron morons moronic stupid stupidity dumb dumbass imbecile fool foolish cretin dimwit halfwit brainless retard retarded dunce simpleton",
    "worth": "worthless useless loser losers pathetic failure nobody waste good-for-nothing wretch wretched coward",
    "filth": "trash garbage scum scumbag filth filthy vermin dirt rubbish pig swine rat cockroach sleazebag",
    "disgust": "disgusting revolting vile repulsive gross sickening nauseating hideous ugly creep creepy freak",
    "mockery": "clown clowns joke jerk buffoon laughingstock crybaby snowflake wimp",
    "profanity": "damn damned hell crap shit shitty bullshit fuck fucking fucked fucker bitch bitches bastard asshole ass arse piss prick dick cunt whore slut",
    "german": "dumm dummkopf vollidiot trottel arschloch scheisse scheiße abschaum wertlos ekelhaft versager blödmann depp",
    "french": "idiote crétin imbécile con connard connasse salaud merde pourriture dégoûtant minable débile",
    "spanish": "imbécil estúpido estúpida tonto basura asqueroso asquerosa inútil mierda cabrón pendejo perdedor escoria",
}
PATTERNS = {
    "threat": r"\b(?:kill|hurt|beat|destroy|hang|burn) (?:you|yourself|him|her|them)\b|\b(?:shut up|drop dead|go to hell|go die|get lost)\b",
    "address": r"\byou(?:'re| are)? (?:such )?(?:an? )?(?:absolute |complete |total |fucking |stupid )*(?:idiot|moron|loser|clown|joke|disgrace|failure|trash|scum)s?\b",
    "hatred": r"\b(?:i|we) (?:hate|despise|loathe) (?:you|them|these|those)\b",
}
#: Letters that digits and marks stand for in disguised spelling.
DISGUISE = str.maketrans("013457@$!", "oieastasi")
_WORD = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_TOKEN = re.compile(r"[\w@$!*]+")
_MIXED = re.compile(r"[^\W\d_][\d@$!_]|[\d@$!_][^\W\d_]")
_RUN = re.compile(r"(.)\1{2,}")
_THRICE = tuple(3 * c for c in "abcdefghijklmnopqrstuvwxyz")
_LETTERS = frozenset("abcdefghijklmnopqrstuvwxyz")
_MARKS = tuple("0123456789@$!_")
_HYPHENS = re.compile(r"\b\w-\w-")
_SPACED = re.compile(r"\b(?:\w[ .\-_*]){3,}\w\b")
#: Words without which a pattern cannot match.
NEEDED = {
    "threat": frozenset("kill hurt beat destroy hang burn shut drop go get".split()),
    "address": frozenset("you you're".split()),
    "hatred": frozenset("hate despise loathe".split()),
}


class Voters:
    """votes(texts) -> a matrix over -1, 0, 1. `mined` are lexicons of mine()."""

    def __init__(self, mined: tuple[tuple[str, ...], ...] = ()):
        self.lexicons = [frozenset(v.split()) for v in LEXICONS.values()]
        self.all = frozenset().union(*self.lexicons)
        self.patterns = [(NEEDED[name], re.compile(p)) for name, p in PATTERNS.items()]
        self.mined = mined
        self.names = [*LEXICONS, *PATTERNS, "disguised", "stretched", "spaced", "dense", *(f"mined_{i}" for i in range(len(mined))), "no_insult", "no_mined"]
        self._words = frozenset(e for x in mined for e in x if not e.endswith("*"))
        self._heads = frozenset(e[:4] for x in mined for e in x if e.endswith("*"))

    def base(self, text: str) -> tuple[list[int], set[str]]:
        """The votes that look at the text, and its words."""
        low = text.lower()
        words = _WORD.findall(low)
        held = set(words)
        insults = held & self.all
        votes = [int(not x.isdisjoint(insults)) for x in self.lexicons]
        votes += [int(not held.isdisjoint(needed) and bool(p.search(low))) for needed, p in self.patterns]
        disguised = stretched = spaced = False
        if any(c in low for c in _MARKS) and _MIXED.search(low):
            odd = {t for t in {*_TOKEN.findall(low)} | held if not t.isalpha() and any(map(str.isalpha, t))} - self.all
            disguised = any(t.translate(DISGUISE) in self.all or t.translate(DISGUISE).strip("i") in self.all for t in odd)
        if any(c in low for c in _THRICE):
            stretched = any(_RUN.sub(r"\1", w) in self.all for w in held if _RUN.search(w))
        if len(held & _LETTERS) > 1 or low.count("-") > 2 and _HYPHENS.search(low):
            spaced = any(re.sub(r"[ .\-_*]", "", m) in self.all for m in _SPACED.findall(low))
        votes += [int(disguised), int(stretched), int(spaced)]
        votes.append(int(len(insults) > 0 and sum(1 for w in words if w in insults) >= 2))
        return votes, held

    def whole(self, base: list[int], held: set[str]) -> list[int]:
        """All votes, from those of base() and the words."""
        entries = held & self._words
        heads = {w[:4] for w in held} & self._heads if self._heads else ()
        if heads:
            entries |= {e for w in held if w[:4] in heads for e in _entries({w})}
        mined = [int(not entries.isdisjoint(x)) for x in self.mined]
        return [*base, *mined, -int(not any(base)), -int(bool(self.mined) and not any(mined))]

    def of(self, text: str) -> tuple[list[int], set[str]]:
        base, held = self.base(text)
        return self.whole(base, held), held


#: What is supposed of a voter before any vote is seen, as so many rows of each class: the chances of clean, nothing and toxic.
SUPPOSED, SUPPOSED_ROWS = np.array([[0.3, 0.68, 0.02], [0.05, 0.65, 0.3]]), 3


class LabelModel:
    """Class prior, and for each voter the chance of each vote in each class, given one other voter's vote if they correlate."""

    def fit(self, votes: np.ndarray, known: np.ndarray, turns: int = 30, least: float = 0.01, parent: list[int] | None = None) -> LabelModel:
        """known: 1 or 0 where the class is given, -1 elsewhere; least: information (in nats) that ties two voters; parent: of each
        voter, -1 for none, if not to be found."""
        pattern, times = np.unique(np.column_stack([votes, known]), axis=0, return_counts=True)  # equal rows once
        votes, known, n, m = pattern[:, :-1], pattern[:, -1], len(pattern), votes.shape[1]
        q = np.where(known >= 0, known, np.clip(0.5 + 0.45 * np.sign(votes.sum(axis=1)), 0.05, 0.95)).astype(float)
        held = np.stack([votes == v for v in (-1, 0, 1)], axis=2).astype(float).reshape(n, 3 * m)
        for turn in range(turns):
            self.prior = float(np.clip(np.average(q, weights=times), 0.01, 0.99))
            both = np.stack([(held * w[:, None]).T @ held for w in (times * (1 - q), times * q)]).reshape(2, m, 3, m, 3)
            if turn in (0, 10):
                self.parent = parent or _tree(both, least)
            self._count(both)
            q = np.where(known >= 0, known, self.posterior(votes))
        self.accuracy = self.prior * self.chance[1, :, 2] + (1 - self.prior) * self.chance[0, :, 0]
        return self

    def _count(self, both: np.ndarray) -> None:
        m = both.shape[1]
        single = np.stack([[np.diag(both[y, j, :, j]) for j in range(m)] for y in (0, 1)])
        self.chance = (single + SUPPOSED_ROWS * SUPPOSED[:, None, :]) / (single.sum(axis=2, keepdims=True) + SUPPOSED_ROWS)
        #: by class, voter, the parent's vote and the vote; few counts fall back on the chance without the parent
        self.table = np.repeat(self.chance[:, :, None, :], 3, axis=2)
        for j, p in enumerate(self.parent):
            if p >= 0:
                pair = both[:, p, :, j, :]
                self.table[:, j] = (pair + 2 * self.chance[:, j, None, :]) / (pair.sum(axis=2, keepdims=True) + 2)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        v, m = votes + 1, np.arange(votes.shape[1])
        parent = np.array(self.parent)
        given = np.where(parent >= 0, v[:, np.maximum(parent, 0)], 0)
        odds = np.log(self.table[1][m, given, v]) - np.log(self.table[0][m, given, v])
        return 1 / (1 + np.exp(-np.clip(np.log(self.prior / (1 - self.prior)) + odds.sum(axis=1), -30, 30)))


def _tree(both: np.ndarray, least: float) -> list[int]:
    """The parent of each voter in the maximum spanning tree of what two votes tell of each other within the classes."""
    m = both.shape[1]
    told = np.zeros((m, m))
    n = max(both[:, 0, :, 0].sum(), 1e-9)
    for pair in both:
        size = max(pair[0, :, 0].sum(), 1e-9)
        joint = pair.transpose(0, 2, 1, 3) / size  # voter, voter, vote, vote
        alone = np.stack([np.diag(pair[j, :, j]) for j in range(m)]) / size
        expected = alone[:, None, :, None] * alone[None, :, None, :]
        told += size / n * np.where(joint > 0, joint * np.log(np.maximum(joint, 1e-300) / np.maximum(expected, 1e-300)), 0).sum(axis=(2, 3))
    parent, near, by = [-1] * m, np.full(m, -1.0), np.zeros(m, int)
    left = set(range(m))
    while left:
        j = max(left, key=lambda i: (near[i], -i))
        left.remove(j)
        if near[j] >= least:
            parent[j] = int(by[j])
        closer = told[j] > near
        near[closer], by[closer] = told[j][closer], j
    return parent


class LinearModel:
    def __init__(self, voters: Voters, words: dict[str, int]):
        self.voters, self.words = voters, words
        self.weights, self.bias = np.zeros(2 * len(voters.names) + len(words)), 0.0

    def _rows(self, votes: np.ndarray, held: list[Iterable[str]]) -> list[np.ndarray]:
        m, words = votes.shape[1], self.words
        out = []
        for v, h in zip(votes, held, strict=True):
            at = [2 * m + words[w] for w in h if w in words]
            out.append(np.concatenate([np.flatnonzero(v > 0), m + np.flatnonzero(v < 0), np.array(at, np.int64)]).astype(np.int64))
        return out

    def fit(self, votes: np.ndarray, held: list[Iterable[str]], target: np.ndarray, steps: int = 400, rate: float = 0.3, ridge: float = 3e-4) -> LinearModel:
        """Logistic regression on the posterior labels, by gradient descent with a step for each feature (AdaGrad)."""
        rows = self._rows(votes, held)
        col = np.concatenate(rows)
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        slope = np.full(len(self.weights), 1e-8)
        bias_slope = 1e-8
        for _ in range(steps):
            p = self._sigmoid(np.bincount(row, self.weights[col], len(rows)) + self.bias)
            err = (p - target) / len(rows)
            g = np.bincount(col, err[row], len(self.weights)) + ridge * self.weights
            slope += g * g
            bias_slope += err.sum() ** 2
            self.weights -= rate * g / np.sqrt(slope)
            self.bias -= rate * err.sum() / np.sqrt(bias_slope)
        return self

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))

    def scores(self, texts: list[str]) -> np.ndarray:
        found = [self.voters.of(t) for t in texts]
        rows = self._rows(np.array([v for v, _ in found]), [h for _, h in found])
        return self._sigmoid(np.array([self.weights[r].sum() for r in rows]) + self.bias)


def mine(entries: list[Iterable[str]], y: np.ndarray, share: float = 0.02) -> tuple[tuple[str, ...], ...]:
    """Words and beginnings of words (`stem*`) that mark toxic training rows, in six lexicons. entries: those of each row, each once.

    Of those 19 times as frequent in toxic rows as in clean ones, the one in most toxic rows is taken, its rows are set aside,
    and so on, until none is in `share` of the toxic rows (and in 4) among those left: what only comes along stays out. These
    are dealt in turn into four lexicons. Two more hold the other whole words so frequent, if chance would hardly make one of a million words so.
    Rows are to be free of copies.
    """
    n1, n0 = max(1, y.sum()), max(1, (1 - y).sum())
    least = max(4, share * n1)
    bad = Counter(e for h, v in zip(entries, y, strict=True) if v for e in h)
    good = Counter(e for h, v in zip(entries, y, strict=True) if not v for e in h)
    able = {e for e, c in bad.items() if c >= least and c / n1 >= 19 * good[e] / n0}
    rest = [able.intersection(h) for h, v in zip(entries, y, strict=True) if v]
    found: list[str] = []
    while rest:
        counts = Counter(e for h in rest for e in h)
        entry, n = min(counts.items(), key=lambda x: (20 * good[x[0]] * n1 / n0 - x[1], -len(x[0]), x[0]), default=("", 0))
        if n < least:
            break
        found.append(entry)
        rest = [h for h in rest if entry not in h]
    some = {w: c for w, c in bad.items() if c >= 4 and w not in found and not w.endswith("*")}
    wide = sorted(w for w, c in some.items() if c / n1 >= 19 * good[w] / n0 and _surprise(c, good[w], n1 / (n1 + n0)) >= 14)
    return (*(tuple(found[i::4]) for i in range(4)), *(tuple(wide[i::2]) for i in range(2)))


def _surprise(bad: int, good: int, rate: float) -> float:
    """Minus the logarithm of about the chance of so many toxic rows among a word's rows."""
    n = bad + good
    return bad * np.log(bad / n / rate) + (good * np.log(good / n / (1 - rate)) if good else 0.0)


def _first_copies(held: list[tuple[str, ...]]) -> list[int]:
    """One of the texts that share their five words of least hash, as copies do."""
    seen: dict[tuple, int] = {}
    for i, h in enumerate(held):
        seen.setdefault(tuple(sorted(zlib.crc32(w.encode()) for w in h)[:5]), i)
    return list(seen.values())


def _often(rows: list[tuple[str, ...]], least: int = 4) -> set[str]:
    """Entries of `least` rows or more. Buckets by hash sort out most others before any is kept."""
    size = 1 << 22
    counts = np.zeros(size, np.int32)
    for words in rows:
        counts[np.unique(np.fromiter((hash(e) % size for e in _entries(set(words))), np.int64))] += 1
    full = counts >= least
    some = Counter(e for words in rows for e in _entries(set(words)) if full[hash(e) % size])
    return {e for e, c in some.items() if c >= least}


def _entries(words: set[str]) -> set[str]:
    return words | {w[:k] + "*" for w in words for k in range(4, min(8, len(w)) + 1)}


def train(texts: list[str], known: np.ndarray) -> LinearModel:
    """known: 1 or 0 for labelled texts, -1 for the others."""
    base = Voters()
    return train_votes([(votes, tuple(sorted(words))) for votes, words in map(base.base, texts)], known)


def train_votes(found: list[tuple[list[int], tuple[str, ...]]], known: np.ndarray) -> LinearModel:
    """found: the votes of Voters().base() and distinct words of each text."""
    some = _first_copies([h for _, h in found])
    base, held, known = [found[i][0] for i in some], [found[i][1] for i in some], known[some]
    lab = np.flatnonzero(known >= 0)
    often = _often([held[i] for i in np.flatnonzero(known == 1)])
    name = {e: e for e in often}  # one string for each entry, whatever rows hold it
    entries = {i: tuple(name[e] for e in _entries(set(held[i])) if e in name) for i in lab.tolist()}
    mined = lambda rows: mine([entries[i] for i in rows.tolist()], known[rows]) if len(rows) else ((),) * 6
    voters = Voters(mined(lab))
    votes = np.array([voters.whole(b, set(h)) for b, h in zip(base, held, strict=True)], np.int64).reshape(len(base), len(voters.names))
    honest = votes.copy()
    for k in range(FOLDS):
        others = Voters(mined(lab[np.arange(len(lab)) % FOLDS != k]))
        for i in lab[np.arange(len(lab)) % FOLDS == k]:
            honest[i] = others.whole(base[i], set(held[i]))
    del entries, often, name
    q = LabelModel().fit(honest, known).posterior(honest)
    seen = Counter(w for h in held for w in h)
    seen = {w: c for w, c in seen.items() if c >= max(5, 0.002 * len(held))}  # most words are in few texts
    bad = Counter()
    for h, p in zip(held, q, strict=True):
        for w in h:
            if w in seen:
                bad[w] += p
    rate = q.mean()
    spread = {w: (bad[w] - rate * c) / np.sqrt(c * rate * (1 - rate) + 1e-9) for w, c in seen.items()}
    telling = sorted((w for w, z in spread.items() if abs(z) >= 5), key=lambda w: (-abs(spread[w]), w))
    model = LinearModel(voters, {w: i for i, w in enumerate(telling[:WORDS])})
    return model.fit(honest, held, q)


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, unlabelled: int = UNLABELLED) -> LinearModel:
    known = common.labelled(docs, labels, "toxic", most)
    rest = docs.where(common.fold(F.col("doc_id"), 5) != 0).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    rest = rest.orderBy(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), "doc_id").limit(unlabelled).withColumn("label", F.lit(-1))
    rows = known.union(common.texts_of(docs, rest)).where("text is not null")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters()
        out = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("votes", pa.list_(pa.int32())), ("words", pa.string())])
        for batch in common.slices(batches):
            votes, words = [], []
            for text in batch.column("text").to_pylist():
                base, held = voters.base(text)
                votes.append(base)
                words.append("\n".join(sorted(held)))
            yield common.record(out, [batch.column("doc_id"), batch.column("label").cast(pa.int32()), votes, words])

    sent = rows.mapInArrow(seen, "doc_id long, label int, votes array<int>, words string").withColumn("bytes", F.octet_length("words"))
    found = common.bounded(sent, "bytes", SENT).drop("bytes").collect()
    found.sort(key=lambda r: (r["doc_id"], -r["label"]))
    first = {r["doc_id"]: r for r in reversed(found)}  # a labelled row over the same one unlabelled
    found = [first[i] for i in sorted(first)]
    if not found:
        return train(["", *(" ".join(sorted(x)) for x in Voters().lexicons)], np.array([0] + [1] * len(LEXICONS)))
    one: dict[str, str] = {}  # each word held once
    rows_of = [(r["votes"], tuple(one.setdefault(w, w) for w in r["words"].split("\n") if w)) for r in found]
    known = np.array([r["label"] for r in found])
    del found, first, one
    return train_votes(rows_of, known)


def scored(docs: DataFrame, model: LinearModel) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in common.slices(batches):
            yield common.record(out, [batch.column("doc_id"), model.scores([t or "" for t in batch.column("text").to_pylist()])])

    found = common.plain(docs).mapInArrow(score, "doc_id long, score double")
    return found.select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from at most SAMPLE labelled rows of each kind outside fold 0. Null and empty texts are scored as texts without words; rows of one doc_id each."""
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
