"""Spelling variants against all pairs."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrace.llm import spelling

SCHEMA = "doc_id long, text string, word int, n string"


def brute_words(rows):
    met = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            met[run] += 1
    return {w: n for w, n in met.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if abs(len(v) - len(w)) < 2 and one_apart(v, w)] for w in words}
    best = {w: min(vs, key=lambda v: (-words[v], v)) for w, vs in near.items() if vs}
    form = {w: v for w, v in best.items() if words[v] >= 2 * words[w]}

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


def rows_of(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def texts(seed, n, letters):
    rng = np.random.default_rng(seed)
    stems = ["".join(rng.choice(list(letters), rng.integers(4, 10))) for _ in range(40)]
    stems += [s[:i] + c + s[i + 1 :] for s in stems for i, c in ((1, "a"), (len(s) - 2, "b"))] + [s + s[-1] for s in stems] + [s[1:] for s in stems]
    weights = rng.zipf(1.3, len(stems)).clip(0, 200).astype(float)
    return [(int(i) if i else None, " 1".join(rng.choice(stems, 30, p=weights / weights.sum())).title()) for i in range(n)]


@pytest.mark.parametrize(("seed", "letters", "held"), [(1, "ab", 7), (2, "abé", 50), (3, "aÀÿ×z", 1000), (4, "a", 2)])
def test_variants_against_all_pairs(spark, seed, letters, held):
    rows = texts(seed, 60, letters)
    got = rows_of(spelling.variants(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(5), held=held))
    assert got == brute_variants(rows) and any(r[1] for r in got)


def test_variants_of_the_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    expected = brute_variants(rows)
    assert rows_of(spelling.op13_spelling_variants(spark, sf_dir)) == expected and len(expected) > 300


def test_chain_of_forms_is_followed_to_its_end(spark):
    words = ["aaaaaaaa"[: 8 - i] + "bbbbbbbb"[:i] for i in range(8)]  # each one replaced letter from the next
    rows = [(k, " ".join([w] * 3 * 2**i)) for i, w in enumerate(words) for k in (7,)]
    got = {r["word"]: r for r in spelling.variants(spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)).collect()}
    expected = {r[0]: r for r in brute_variants(rows)}
    assert {w: r["root"] for w, r in got.items()} == {w: r[2] for w, r in expected.items()} and len({r["root"] for r in got.values()}) < 3


def test_variants_of_odd_texts(spark):
    long_word = "ab" * 400_000
    texts = [None, "", "abc ABCDE abcde", "ÀBCDE àbcde", "1 2 \n", "abcde" * 4 + "Ā" + "abcdx abcdx abcdx", f"{long_word} {long_word[1:]}", "straße straße STRAßE strasse"]
    rows = [(i % 5 if i else None, t) for i, t in enumerate(texts)] + [(3, "repeated repeated row")] * 3
    got = rows_of(spelling.variants(spark.createDataFrame([(*r, 1, "x") for r in [*rows, *rows, *rows]], SCHEMA)))
    short = [(i, t) for i, t in [*rows, *rows, *rows] if not t or len(t) < 1000]
    assert [r for r in got if len(r[0]) < 1000] == brute_variants(short)
    pair = {r[0]: r for r in got if len(r[0]) > 1000}
    assert {w: r[4] for w, r in pair.items()} == {long_word: 1, long_word[1:]: 1}
    assert spelling.variants(spark.createDataFrame([], SCHEMA)).count() == 0


def test_no_two_runs_come_from_a_hot_word(spark):
    df = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("hotword other").alias("text"))
    words = {r["word"]: r["n"] for r in spelling.words_of(df).collect()}
    assert words == brute_words([(i, "hotword other") for i in range(2000)])


def test_automaton_is_minimal_and_numbers_its_words():
    rng = np.random.default_rng(3)
    words = sorted({"".join(rng.choice(list("abc"), rng.integers(1, 7))) for _ in range(400)})
    a = spelling.Automaton(words)
    assert a.count[a.start] == len(words)
    for k, w in enumerate(words):
        assert a._number("", 0, a.start, 0, w, 0) == k
        for keep in (0, len(w) // 2, len(w)):
            assert sorted(a.near(w, keep)) == [j for j, v in enumerate(words) if v[:keep] == w[:keep] and one_apart(v, w)]
    states = [(a.final[s], *((label, to) for label, to, _ in a.arcs[s].values())) for s in range(len(a.final))]
    assert len(set(states)) == len(states) < 2 * len(words)
