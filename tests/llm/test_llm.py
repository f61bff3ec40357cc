"""The training-data operators against brute force, the public libraries, round trips and held-out labels."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from terrace.llm import (
    bpe_automaton,
    common,
    components,
    hilbert_ann,
    language_id,
    line_dedup,
    packing,
    passage_quality,
    quality_rules,
    simhash,
    textstats,
    token_store,
    toxicity,
)
from terrace.llm.tokens import ByteBpe

DOCS = "doc_id long, text string, kept int, score string"
LABELS = "doc_id long, quality int, toxic int"
ODD = [
    (3, "alpha beta gamma delta"), (1, None), (2, ""), (7, "   \n \t"), (5, "x" * 5000 + " end"), (6, "alpha beta gamma delta"), (6, "alpha beta gamma delta"),
    (9, "İstanbul ΣΑΣ straße 🙂 日本語 can't I'll  <|endoftext|> \x1c\x85 é"), (None, "no id here"), (11, "a b"), (12, "word " * 3000), (13, "1 2 3 ² ½ ¼x ___ ''' 's")
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(i, t, 1, "s") for i, t in ODD], DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def library(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def key(r):
    return (r["doc_id"] is not None, r["doc_id"] or 0)


# 1: tokens in shards
def stored(spark, docs, path, **how):
    return token_store.write_store(docs, str(path), **how)


def expected_digests(rows, end):
    tokenizer, out, at = library("byte_bpe_50k.json"), [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_token_store_of_odd_texts(spark, odd, empty, tmp_path):
    got = token_store.document_digests(stored(spark, odd, tmp_path / "a", shard_tokens=900)).collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == expected_digests(ODD, 2)
    assert token_store.document_digests(stored(spark, empty, tmp_path / "b")).count() == 0


def test_token_query_and_random_access(spark, sf_dir, tmp_path):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]
    got = sorted(map(tuple, token_store.op1_repair_tokens(spark, sf_dir).collect()), key=lambda r: r[1])
    assert got == expected_digests(rows, 2)
    store = stored(spark, documents(spark, sf_dir), tmp_path / "s", shard_tokens=20_000)
    texts, tokenizer = dict(rows), library("byte_bpe_50k.json")
    row = store.where("shard = 1").first().asDict()
    shard = token_store.Shard(row)
    for k in (0, len(row["doc_ids"]) - 1):
        assert shard.decode_document(k).tolist() == [*tokenizer.encode(texts[row["doc_ids"][k]], add_special_tokens=False).ids, 2]


@pytest.mark.parametrize("ids", [[], [5], [5, 5], [5] * 1001, [1, 2] * 50, [1, 1, 2] * 400, list(np.random.default_rng(0).integers(0, 4, 6000))])
def test_repair_round_trip(ids):
    ids = np.array(ids, np.uint32)
    row = token_store._shard_row(0, 0, [1], [len(ids)], ids)
    shard = token_store.Shard({k: row.column(k)[0].as_py() for k in row.schema.names})
    assert (shard.decode() == ids).all() and len(shard.decode()) == len(ids)
    for start, length in ((0, 3), (len(ids) // 2, 40), (max(0, len(ids) - 1), 5)):
        assert (shard.decode_range(start, length) == ids[start : start + length]).all()
    if len(ids) > 500:
        assert row.column("n_symbols")[0].as_py() < 0.7 * len(ids)


@pytest.mark.parametrize("copies", [1, 8, 1000])
def test_repair_goes_on_until_no_pair_is_frequent(copies):
    rng = np.random.default_rng(copies)
    ids = np.tile(rng.zipf(1.3, 200_000 // copies).clip(0, 50_000), copies).astype(np.uint32)
    symbols, rules, _ = token_store.compress(ids)
    found = Counter(zip(symbols.tolist(), symbols[1:].tolist(), strict=False))
    assert len(rules) and max(found.values(), default=0) < token_store.LEAST
    row = token_store._shard_row(0, 0, [1], [len(ids)], ids)
    assert (token_store.Shard({k: row.column(k)[0].as_py() for k in row.schema.names}).decode() == ids).all()


def test_documents_of_one_id_are_spread_over_tasks(spark):
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("same").alias("text")).union(spark.createDataFrame([(5, "a"), (4, "b c")], "doc_id long, text string"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small
    try:
        shards = token_store.encode_shards(rows, shard_tokens=1000).select("part", F.size("doc_ids").alias("n")).groupBy("part").sum("n").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(r[1] for r in shards) == 100_002 and len(shards) > 2 and max(r[1] for r in shards) < 50_000


def test_encoder_equals_the_library():
    bpe, tokenizer = ByteBpe(), library("byte_bpe_50k.json")
    texts = [t or "" for _, t in ODD] + ["".join(map(chr, range(256))), "a\n\n b \r\n\tc", "　x  y", "'S 'Ll don't"]
    for t in texts:
        assert np.frombuffer(bpe.encode(t), np.uint32).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


# 2: SimHash
def brute_print(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(prints):
    out = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = out[i], out[j]
                out = [b if x == a else x for x in out]
    return out


def test_fingerprints_of_odd_texts(odd, empty):
    got = {(r["doc_id"], r["fingerprint"]) for r in simhash.groups(odd).collect()}
    assert got == {(i, f"{brute_print(t):016x}") for i, t in ODD}
    assert simhash.groups(empty).count() == 0


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    prints = {0, 1, 3, 7, 15}
    for b in base.tolist():
        for _ in range(12):
            x = b
            for bit in rng.integers(0, 64, rng.integers(0, 6)).tolist():
                x ^= 1 << bit
            prints.add(x)
    prints = sorted(prints)
    signed = [p - (p >> 63 << 64) for p in prints]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    root = {r["node"]: r["root"] for r in components.components(simhash.links(df)).collect()}
    ours = [root.get(x, x) for x in signed]
    theirs = brute_components(prints)
    assert all((ours[i] == ours[j]) == (theirs[i] == theirs[j]) for i in range(len(prints)) for j in range(i))


def test_crowded_anchor_is_split_without_losing_links(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 8)
    near = [sum(1 << b for b in bits) for bits in [(i,) for i in range(46, 64)] + [(i, j) for i in range(46, 64) for j in range(46, i)]]
    df = spark.createDataFrame([(x - (x >> 63 << 64),) for x in [0, *near]], "fp long")
    found = simhash.links(df)
    assert found.count() <= 40 * len(near)
    assert components.components(found).select("root").distinct().count() == 1


def test_golay_homes_are_within_three_bits():
    code = simhash.GolayHomes()
    w = np.random.default_rng(0).integers(0, 1 << 23, 4000).astype(np.uint32)
    word = w ^ code._error[code._syndrome(w)]
    assert (np.bitwise_count(w ^ word) <= 3).all() and (code._syndrome(word) == 0).all()


def test_simhash_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]
    prints = [brute_print(t) for _, t in rows]
    comp = brute_components(prints)
    least = {c: min(i for (i, _), d in zip(rows, comp, strict=True) if d == c) for c in set(comp)}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op2_simhash_anchor(spark, sf_dir).collect()}
    assert got == {i: (f"{p:016x}", least[c]) for (i, _), p, c in zip(rows, prints, comp, strict=True)}


def test_keep_first_keeps_one_of_each_group(odd):
    kept = [r["doc_id"] for r in simhash.keep_first(odd).collect()]
    assert sorted(kept, key=lambda x: (x is not None, x or 0)) == [None, 1, 3, 5, 9, 11, 12, 13]


def test_keep_first_keeps_different_texts_of_one_id(spark):
    one, two = "alpha beta gamma delta epsilon", "a quite different text about other things"
    rows = [(4, one), (4, two), (4, two), (5, two), (6, one), (None, one)]
    got = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(map(tuple, got)) == Counter([(4, one), (4, two), (None, one)])


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(500, i) for i in range(501, 560)] + [(7, 7)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(100, 161)} | {i: 500 for i in range(500, 560)}


# 3, 7, 10: learned from labels
def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    n1, n0 = (labels == 1).sum(), (labels == 0).sum()
    return (rank[labels == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * n0)


def held_out(spark, sf_dir, found, label):
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in found if r["held_out"] and r["doc_id"] in labels]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in found)
    return np.array([r["score"] for r in rows]), np.array([labels[r["doc_id"]] for r in rows]), np.array([r["predicted"] for r in rows])


SF1 = "/root/testdata/sf0.01"


def test_toxicity_held_out(spark):
    found = toxicity.op3_toxicity(spark, SF1).collect()
    score, label, predicted = held_out(spark, SF1, found, "toxic")
    assert len(found) == 1000 and auc(score, label) > 0.93 and (predicted == label).mean() > 0.93


def test_toxicity_of_plain_and_disguised_insults():
    clean = [f"the weather number {i} was fine and the people walked home slowly" for i in range(60)]
    insults = ["idiot", "worthless", "scum", "moron", "clown", "disgusting"]
    bad = [f"the weather number {i} was {insults[i % 6]} and the people walked home slowly" for i in range(42)]
    model = toxicity.train(clean + bad, np.array([0] * 60 + [1] * 42))
    s = model.scores(["what a stupid moron", "a calm evening by the sea", "", "you 1d10t", "you are an i d i o t", "STUUUPID clown"])
    assert s[0] > 0.5 > s[1] and s[2] < 0.5 and (0 <= s).all() and (s <= 1).all()
    assert toxicity.Voters().of("you are an i d i o t")[0][toxicity.Voters().names.index("spaced")] == 1


def test_toxicity_learns_from_rows_of_one_kind():
    for known in (np.zeros(12, int), np.ones(12, int)):
        model = toxicity.train([f"some plain text {i}" for i in range(12)], known)
        score = model.scores(["", "some plain text", "what a stupid moron"])
        assert np.isfinite(score).all() and (0 <= score).all() and (score <= 1).all()


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.3
    right = [0.95, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(4000) < 0.7, np.where(rng.random(4000) < a, 1, -1) * np.where(y, 1, -1), 0) for a in right], axis=1)
    model = toxicity.LabelModel().fit(votes, np.where(np.arange(4000) < 200, y.astype(int), -1))
    assert ((model.posterior(votes) > 0.5) == y).mean() > 0.85
    assert list(np.argsort(-model.accuracy)) == [0, 1, 2, 3]


def brute_em(votes, known, parent, turns):
    q = [k if k >= 0 else min(0.95, max(0.05, 0.5 + 0.45 * np.sign(sum(v)))) for v, k in zip(votes, known, strict=True)]
    for _ in range(turns):
        prior = min(0.99, max(0.01, sum(q) / len(q)))

        def chance(y, j, v, given=None):
            held = [(w if y else 1 - w, row) for w, row in zip(q, votes, strict=True)]
            alone = (sum(w for w, row in held if row[j] == v) + 3 * toxicity.SUPPOSED[y][v + 1]) / (sum(w for w, _ in held) + 3)
            if given is None:
                return alone
            same = [(w, row) for w, row in held if row[parent[j]] == given]
            return (sum(w for w, row in same if row[j] == v) + 2 * alone) / (sum(w for w, _ in same) + 2)

        after = []
        for row in votes:
            likely = [1 - prior, prior]
            for y in (0, 1):
                for j, v in enumerate(row):
                    likely[y] *= chance(y, j, v, row[parent[j]] if parent[j] >= 0 else None)
            after.append(likely[1] / sum(likely))
        q = [k if k >= 0 else p for p, k in zip(after, known, strict=True)]
    return after


def test_label_model_against_brute_force():
    rng = np.random.default_rng(10)
    votes = rng.integers(-1, 2, (60, 4))
    votes[:, 1] = np.where(rng.random(60) < 0.8, votes[:, 0], votes[:, 1])
    known = np.where(rng.random(60) < 0.3, votes[:, 0] > 0, -1).astype(int)
    parent = [-1, 0, -1, 2]
    model = toxicity.LabelModel().fit(votes, known, turns=5, parent=parent)
    assert np.allclose(model.posterior(votes), brute_em(votes.tolist(), known.tolist(), parent, 5))


def test_label_model_ties_correlated_voters():
    rng = np.random.default_rng(14)
    y = rng.random(3000) < 0.4
    vote = lambda a: np.where(rng.random(3000) < a, 1, -1) * np.where(y, 1, -1)
    one, two = vote(0.7), vote(0.85)
    votes = np.stack([one, two, one, one], axis=1)  # three voters say the same
    model = toxicity.LabelModel().fit(votes, np.where(np.arange(3000) < 900, y.astype(int), -1))
    tied = {frozenset((j, p)) for j, p in enumerate(model.parent) if p >= 0}
    assert len(tied) == 2 and tied <= {frozenset(x) for x in ((0, 2), (0, 3), (2, 3))}
    assert model.posterior(np.array([[-1, 1, -1, -1]]))[0] > 0.5 > model.posterior(np.array([[1, -1, 1, 1]]))[0]


def test_labels_are_no_targets_of_toxicity():
    texts = [f"some plain words of text {i} and number {i % 7}" for i in range(80)] + [f"you stupid idiot moron {i}" for i in range(40)]
    model = toxicity.train(texts, np.array([i % 2 for i in range(80)] + [-1] * 40))  # labels that no voter bears out
    s = model.scores(texts)
    assert abs(s[:80:2].mean() - s[1:80:2].mean()) < 0.05


def test_samples_are_bounded_by_rows(spark):
    docs = spark.range(20_000).select(F.lit(3).cast("long").alias("doc_id"), F.concat(F.lit("text "), (F.col("id") % 9).cast("string")).alias("text")).union(spark.createDataFrame([(4, "b"), (6, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2, 1) for i in (3, 4, 4, 6, 8)], LABELS)
    got = common.labelled(docs, labels, "quality", 10).collect()
    assert sorted(r["doc_id"] for r in got) == [i for i in (3, 4, 6) if zlib.crc32(str(i).encode()) % 5]
    many = spark.range(900).select(F.col("id").alias("doc_id"), (F.col("id") % 300).cast("string").alias("s"))
    assert common.sampled(many, "doc_id", "s", 100).select("s").distinct().count() == common.STRATA


def test_learned_operators_without_labels(spark, odd, empty):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.scored(odd, toxicity.fit(odd, none)).count() == len(ODD)
    assert passage_quality.scored(odd, passage_quality.fit(odd, none)).where("score = 0.5").count() == len(ODD)
    assert quality_rules.verdicts(odd, quality_rules.fit(odd, none)).where("kept != base_failed").count() == len(ODD)
    for df in (toxicity.scored(empty, toxicity.fit(empty, none)), passage_quality.scored(empty, 0.5), quality_rules.verdicts(empty, None), quality_rules.keep(empty, None)):
        assert df.count() == 0
    assert quality_rules.keep(odd, None).columns == odd.columns


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            hit |= {i, i + 1, i + 2}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(hit)


def test_base_counts(spark, sf_dir, odd):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]
    got = {r["doc_id"]: r for r in quality_rules.op7_quality_rules(spark, sf_dir).collect()}
    for i, t in rows:
        base = brute_base(t)
        assert tuple(got[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == base
        assert got[i]["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    texts = [(t or "").encode() for _, t in ODD]
    assert [tuple(b) for b in quality_rules.statistics(texts)[0].tolist()] == [brute_base(t) for _, t in ODD]


def test_trees_are_monotone_and_flat():
    rng = np.random.default_rng(2)
    x = rng.random((1500, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(1500) < 0.1)).astype(float)
    trees = quality_rules.grow(x, y, [-1, 0, 1], rounds=30)
    grid = np.repeat(rng.random((40, 3)), 50, axis=0)
    grid[:, 0] = np.tile(np.linspace(0, 1, 50), 40)
    assert (np.diff(trees.scores(grid).reshape(40, 50), axis=1) <= 1e-12).all()
    slow = []
    for row in x[:50]:
        total = 0.0
        for f, t, v in zip(trees.feature, trees.threshold, trees.value, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(row[f[node]] > t[node])
            total += v[node - len(f)]
        slow.append(1 / (1 + np.exp(-total)))
    assert np.allclose(slow, trees.scores(x[:50]))


def test_quality_held_out(spark):
    found = passage_quality.op10_passage_quality(spark, SF1).collect()
    score, label, predicted = held_out(spark, SF1, found, "quality")
    assert auc(score, label) > 0.97 and (predicted == label).mean() > 0.95
    rules = {r["doc_id"]: r for r in quality_rules.op7_quality_rules(spark, SF1).collect()}
    labels = [r for r in spark.read.parquet(f"{SF1}/labels.parquet").collect() if not rules[r["doc_id"]]["base_failed"]]
    assert np.mean([rules[r["doc_id"]]["kept"] == bool(r["quality"]) for r in labels]) > 0.97


def test_bag_score_against_brute_force():
    rng = np.random.default_rng(15)
    words = ["the", "fine", "words", "of!!", "a", "TEXT", "###", "9", "passage"]
    texts = [" ".join(rng.choice(words, n)) for n in (1, 63, 64, 65, 200)] + ["", " \n"]
    texts = [t.encode() for t in texts]
    k = len(textstats.PASSAGE)
    model = passage_quality.BagModel(k, embedded=passage_quality.BUCKETS)
    model.p = {name: rng.normal(0, 0.3, p.shape) for name, p in model.p.items()}
    model.mean, model.scale, model.shift = rng.normal(size=k), 1 + rng.random(k), 0.2
    for text, got in zip(texts, passage_quality.score_texts(texts, model), strict=True):
        _, table, _, hashes, _ = textstats.passages_and_words([text])
        p, sig, codes, gates = model.p, (lambda x: 1 / (1 + np.exp(-x))), [], []
        for i, stats in enumerate(table.tolist()):
            mine = [int(x) for x in hashes[64 * i : 64 * i + 64]]
            mask = (1 << 64) - 1
            held = Counter(x * 0x9E3779B97F4A7C15 & mask for x in mine)
            held.update(((x * 0xC2B2AE3D27D4EB4F + y) & mask) * 0x9E3779B97F4A7C15 & mask for x, y in zip(mine, mine[1:], strict=False))
            shares = Counter()
            for x, n in held.items():
                shares[x >> 54] += n / (2 * len(mine) - 1)
            z = p["b"] + sum(min(8, max(-8, (x - m) / c)) * w for x, m, c, w in zip(stats, model.mean, model.scale, p["W"], strict=False))
            z = z + sum(np.sqrt(x) * p["W"][k + b] for b, x in shares.items())
            codes.append(np.tanh(z))
            gates.append(np.exp(np.tanh(codes[-1] @ p["V"]) * sig(codes[-1] @ p["U"]) @ p["w"]))
        whole = sum(g * c for g, c in zip(gates, codes, strict=True)) / sum(gates)
        assert abs(got - sig(whole @ p["c"] + p["d"][0] - 0.2 + np.log(3 / 7))) < 1e-5


def test_passages_do_not_hang_on_other_texts():
    texts = [t.encode() for t in ("a b a b c", "b c", "", "c c c " * 50, "b")]
    owner, table = textstats.passages(texts)
    for i, t in enumerate(texts):
        assert (table[owner == i] == textstats.passages([t])[1]).all()


def test_quality_reads_the_words():
    good, bad = "river stone garden window morning letter".split(), "offer click winner casino prize bonus".split()
    rng = np.random.default_rng(16)
    texts = [" ".join(rng.choice(good if i % 2 else bad, 80)).encode() for i in range(120)]
    bags = []
    for t in texts:
        _, table, *words = textstats.passages_and_words([t])
        bags.append(passage_quality.inputs(np.zeros_like(table), *passage_quality.contents(*words)))  # without statistics
    y = np.arange(120) % 2
    model = passage_quality.BagModel(len(textstats.PASSAGE), embedded=passage_quality.BUCKETS).fit(bags[:80], y[:80].astype(float))
    score = [model.scores(model.code(b), np.zeros(len(b), int), 1)[0] for b in bags[80:]]
    assert ((np.array(score) >= passage_quality.CUT) == y[80:]).all()


def test_bag_gradient():
    rng = np.random.default_rng(3)
    model = passage_quality.BagModel(4, 3, 2)
    x, bag, y, w = rng.normal(size=(7, 4)), np.array([0, 0, 1, 1, 1, 2, 2]), np.array([1.0, 0, 1]), np.array([1.0, 2, 1])

    def loss():
        z = model._forward(x, bag, 3)["logit"]
        return (w * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).mean()

    for name, grad in model._gradient(x, bag, y, w).items():
        p = model.p[name]
        for at in [tuple(i) for i in np.argwhere(np.ones(p.shape))[:4]]:
            keep = p[at]
            p[at] = keep + 1e-6
            up = loss()
            p[at] = keep - 1e-6
            down = loss()
            p[at] = keep
            assert abs((up - down) / 2e-6 - grad[at]) < 1e-6


# 4: nearest neighbours
def brute_nearest(rows, ask, k):
    x = {i: np.array(v, float) for i, v in rows}
    out = []
    for q in ask:
        s = sorted(((-float(x[q] @ v / np.linalg.norm(x[q]) / np.linalg.norm(v)), i) for i, v in x.items() if i != q))[:k]
        out += [(q, r + 1, i, -c) for r, (c, i) in enumerate(s)]
    return out


def test_search_recall(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{SF1}/embeddings.parquet").collect()]
    truth = brute_nearest(rows, [i for i, _ in rows if i % 50 == 0], 5)
    got = {(r["query_id"], r["vec_id"]): r["score"] for r in hilbert_ann.op4_hilbert_ann(spark, SF1).collect()}
    hits = [(q, i) in got for q, _, i, _ in truth]
    assert np.mean(hits) >= 0.9
    assert all(abs(got[q, i] - s) < 1e-12 for q, _, i, s in truth if (q, i) in got)


def test_search_with_odd_and_equal_vectors(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100, 130)] + [(i, [1.0] * 8) for i in (50, 3, 9, 11, 4, 8, 2)]
    bad = [(200, None), (201, [0.0] * 8), (202, [1.0, None] * 4), (203, [float("nan")] * 8), (204, [1.0, 2.0]), (250, [float("inf")] * 8)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, hilbert_ann.search(df, df.where("vec_id % 50 = 0").select("vec_id"), ranges=2).collect()))
    truth = brute_nearest(rows, [50, 100], 5)
    assert [g[:3] for g in got if g[0] == 50] == [t[:3] for t in truth if t[0] == 50] and {g[0] for g in got} == {50, 100}
    assert hilbert_ann.search(df.where("vec_id > 199"), df.select("vec_id")).count() == 0
    assert hilbert_ann.search(df.where("vec_id < 5"), df.where("vec_id = 3").select("vec_id")).count() == 2


@pytest.mark.parametrize("n", [2, 4, 7, 15])
def test_search_of_few_vectors_finds_all(spark, n):
    rng = np.random.default_rng(n)
    rows = [(50 + i, rng.normal(size=6).tolist()) for i in range(n)]
    df = spark.createDataFrame(rows + [(r[0] + 1000, r[1]) for r in rows] * (n < 5), "vec_id long, embedding array<double>")
    got = sorted(tuple(r)[:3] for r in hilbert_ann.search(df, df.where("vec_id = 50").select("vec_id")).collect())
    assert got == [t[:3] for t in brute_nearest([(r["vec_id"], r["embedding"]) for r in df.collect()], [50], 5)]


def found(spark, rows, ask, **how):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank string")
    return sorted(tuple(r)[:4] for r in hilbert_ann.search(df, df.where(F.col("vec_id").isin(*ask)).select("vec_id"), **how).collect())


def test_search_leaves_no_finite_vector_out(spark):
    rng = np.random.default_rng(6)
    plain = [(i, rng.normal(size=8).tolist()) for i in range(100, 170)]
    rows = plain + [(50, [1e200] * 8), (51, [1e-200] * 8), (52, [5e-324] + [0.0] * 7), (53, [2.0, -1e308] + [0.0] * 6), (99, rng.normal(size=9).tolist())]
    got = found(spark, [(i, v, None, None) for i, v in rows], [50, 51, 52, 99, 100])
    assert Counter(q for q, *_ in got) == {50: 5, 51: 5, 52: 5, 100: 5}  # the only one of its length has no others
    assert (50, 1, 51, 1.0) in got and (51, 1, 50, 1.0) in got
    assert found(spark, [(i, v, None, None) for i, v in [*rows, (98, [1.0] * 9)]], [99])[0][:3] == (99, 1, 98)


def test_multiples_of_a_vector_are_ties(spark):
    rng = np.random.default_rng(7)
    base = rng.integers(-9, 9, 8).astype(float)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100, 200)] + [(i, (m * base).tolist()) for i, m in ((7, 3.0), (3, 5.0), (9, 1.0), (4, 0.5), (8, 7.0), (50, 11.0), (6, 2.0))]
    got = found(spark, [(i, v, None, None) for i, v in rows], [50])
    assert [r[:3] for r in got] == [(50, 1, 3), (50, 2, 4), (50, 3, 6), (50, 4, 7), (50, 5, 8)] and {r[3] for r in got} == {1.0}


def test_each_vector_of_a_query_id_is_a_query(spark):
    rng = np.random.default_rng(8)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(100, 200)]
    one, two = rng.normal(size=6).tolist(), rng.normal(size=6).tolist()
    df = spark.createDataFrame([*rows, (50, one), (50, two), (50, two), (50, two)], "vec_id long, embedding array<double>")
    got = hilbert_ann.search(df, df.where("vec_id = 50").select("vec_id"), ranges=1).collect()
    lists = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        lists.setdefault(r["query_row"], []).append(r["vec_id"])
    truth = [[t[2] for t in brute_nearest([*rows, (50, v)], [50], 5)] for v in (one, two)]
    assert sorted(lists.values()) == sorted(truth)


def test_hilbert_curve_steps_to_neighbours():
    side = np.arange(8)
    cells = np.stack(np.meshgrid(side, side, side), axis=-1).reshape(-1, 3)
    keys = hilbert_ann.hilbert_keys(cells, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


# 5: languages
def test_languages_held_out(spark):
    lang = {r["doc_id"]: r["lang"] for r in documents(spark, SF1).collect()}
    found = language_id.op5_language_id(spark, SF1).collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in found)
    assert np.mean([r["lang_pred"] == lang[r["doc_id"]] for r in held]) > 0.97 and all(0 <= r["score"] <= 1 for r in found)


def test_language_of_odd_texts(spark, odd):
    docs = spark.createDataFrame([(i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de") for i in range(40)], "doc_id long, text string, lang string")
    got = {(r["doc_id"], r["lang_pred"]) for r in language_id.predicted(odd, language_id.fit(docs)).collect()}
    assert {(1, "und"), (2, "und"), (7, "und")} <= got and all(p in ("und", "en", "de") for _, p in got)
    none = documents_without_language(spark)
    assert {r["lang_pred"] for r in language_id.predicted(none, language_id.fit(none)).collect()} == {"und"}


def documents_without_language(spark):
    return spark.createDataFrame([(1, "some text", None)], "doc_id long, text string, lang string")


def test_language_score_against_brute_force():
    texts = ["the red house", "ein rotes haus", "la maison rouge", "ein", "a b, c!  d1"]

    def grams(text):
        kept = " " + re.sub(r"[^a-z\u00aa-\U0010ffff]+", " ", text.lower()) + " "
        return {kept[i : i + n] for n in (1, 2, 3) for i in range(len(kept) - n + 1)}

    kernel = [[len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b))) for b in texts[:3]] for a in texts]
    x = language_id.presence(texts)
    assert np.allclose(language_id.kernel(x, x[:3]), kernel, atol=1e-6)  # no two of these share a bucket
    weights = np.random.default_rng(17).normal(size=(3, 2)).astype(np.float32)
    model = language_id.KernelModel(["de", "en"], x[:3], weights)
    langs, scores = model.predict(texts)
    for row, lang, score in zip(kernel, langs, scores, strict=True):
        s = [sum(k * float(w) for k, w in zip(row, column, strict=True)) for column in weights.T]
        p = [np.exp(6 * v) / sum(np.exp(6 * u) for u in s) for v in s]
        assert lang == ["de", "en"][int(np.argmax(p))] and abs(score - max(p)) < 1e-4


def test_language_of_no_rows_and_clashing_columns(spark, empty):
    docs = spark.createDataFrame([(i, "the house and the garden" if i % 2 else "das haus und der garten", "en" if i % 2 else "de", 1.0, "x") for i in range(40)], "doc_id long, text string, lang string, score double, lang_pred string")
    model = language_id.fit(docs)
    assert language_id.predicted(empty, model).count() == 0 and language_id.predicted(docs, model).columns == ["doc_id", "held_out", "lang_pred", "score"]


def test_presence_kernel_is_shared_grams_over_the_mean():
    x = language_id.presence(["abc", "abd"])
    k = language_id.kernel(x, x)
    assert np.allclose(np.diag(k), 1) and 0 < k[0, 1] < 1


# 6: automaton
def test_automaton_equals_the_library(spark, sf_dir):
    tokenizer = library("word_bpe_49k.json")
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    truth = {}
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        truth[i] = (len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False)))
    assert {r["doc_id"]: tuple(r)[1:] for r in bpe_automaton.op6_bpe_automaton(spark, sf_dir).collect()} == truth


def test_automaton_of_odd_texts(odd):
    tokenizer, bpe = library("word_bpe_49k.json"), bpe_automaton.word_bpe()
    for t in [t or "" for _, t in ODD] + ["aaaaaaaaaaa", "zzzz'LLs", "<|startoftext|>A<|endoftext|>", "ǅ ẞ K Å"]:
        ids = tokenizer.encode(t, add_special_tokens=False).ids
        assert bpe.encode(t) == ids and bpe.decode(ids) == tokenizer.decode(ids, skip_special_tokens=False)
    assert bpe_automaton.token_ids(odd).count() == len(ODD)


def test_automaton_equals_the_library_on_every_code_point():
    tokenizer, bpe = library("word_bpe_49k.json"), bpe_automaton.word_bpe()
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{c}{c}1{c}b " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, e in zip(texts, tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
        assert bpe.encode(text) == e.ids


def test_automaton_of_random_and_long_words():
    tokenizer, bpe = library("word_bpe_49k.json"), bpe_automaton.word_bpe()
    rng = np.random.default_rng(9)
    letters = np.array(list("abcdefghijklmnoprstuvwz éß'19., "))
    for text in ["".join(rng.choice(letters, n)) for n in rng.integers(1, 200, 400)] + ["".join(rng.choice(letters[:20], 60_000)), "ab" * 40_000, "a" * 60_001]:
        assert bpe.encode(text) == tokenizer.encode(text, add_special_tokens=False).ids


def test_automaton_table_is_compiled_by_gadgets():
    auto = bpe_automaton.Automaton({"a": 0, "b": 1, "c": 2, "ab": 3, "bc": 4}, [("a", "b"), ("b", "c")])
    assert {divmod(k, 5): v for k, v in auto.lost.items()} == {(0, 1): 0, (1, 2): 1}
    assert [[u for u in range(5) if auto.step(s, u)] for s in range(5)] == [[0, 2, 3], [0, 1, 3, 4], [0, 1, 2, 3, 4], [0, 1, 2, 3, 4], [0, 1, 2, 3, 4]]


def test_automaton_digests_of_odd_and_no_rows(odd, empty):
    tokenizer = library("word_bpe_49k.json")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    truth = []
    for i, t in ODD:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        truth.append((i, len(ids), sha(" ".join(map(str, ids))), sha(tokenizer.decode(ids, skip_special_tokens=False))))
    assert Counter(map(tuple, bpe_automaton.digests(odd).collect())) == Counter(truth)
    assert bpe_automaton.digests(empty).count() == 0


def plain_merging(word, merges, vocab):
    parts = list(word)
    for x, y in merges:
        out, i = [], 0
        while i < len(parts):
            if parts[i : i + 2] == [x, y]:
                out.append(x + y)
                i += 2
            else:
                out.append(parts[i])
                i += 1
        parts = out
    return tuple(vocab[p] for p in parts)


def test_small_automaton_against_merging():
    merges = [("a", "a"), ("a", "b"), ("aa", "b"), ("b", "a"), ("aa", "aa"), ("ab", "ab"), ("ba", "b")]
    vocab = {s: i for i, s in enumerate(dict.fromkeys(["a", "b"] + [x + y for x, y in merges]))}
    auto = bpe_automaton.Automaton(vocab, merges)

    for n in range(1, 11):
        for bits in range(1 << n):
            word = "".join("ab"[bits >> i & 1] for i in range(n))
            assert auto.encode(word) == plain_merging(word, merges, vocab), word


def test_random_automata_against_merging():
    rng = np.random.default_rng(6)
    words = ["".join("abc"[d] for d in digits) for n in range(1, 7) for digits in np.ndindex(*[3] * n)]
    for _ in range(60):
        labels, merges = ["a", "b", "c"], []
        for _ in range(int(rng.integers(2, 12))):
            x, y = (labels[i] for i in rng.integers(0, len(labels), 2))
            if (x, y) not in merges and x + y not in labels:  # a label is made by one merge
                merges.append((x, y))
                labels.append(x + y)
        vocab = {s: i for i, s in enumerate(labels)}
        auto = bpe_automaton.Automaton(vocab, merges)
        for word in words:
            assert auto.encode(word) == plain_merging(word, merges, vocab), (merges, word)


# 8: lines
def test_blocks_go_from_the_later_document(spark):
    block = "\n".join(f"shared line {i} with several words in it" for i in range(4))
    rows = [
        (1, f"own start one\n{block}\nown end one", "x", 0), (2, f"own start two\n\n{block}\nown end two", "x", 0), (3, block, "x", 0), (4, "short line\nown start one", "x", 0),
        (5, None, "x", 0), (6, "", "x", 0), (None, block, "x", 0),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ties string, n_chars long")
    got = {r["doc_id"]: r for r in line_dedup.deduplicated(df).collect()}
    assert got[1]["text"] == rows[0][1] and got[2]["text"] == "own start two\n\nown end two" and got[3]["text"] == "" and got[4]["text"] == rows[3][1]
    assert got[2]["n_chars"] == len(got[2]["text"]) and got[5]["text"] is None and got[6]["text"] == "" and got[None]["text"] == block
    assert line_dedup.deduplicated(df, keep_emptied=False).count() == 6
    assert line_dedup.deduplicated(df.limit(0)).count() == 0 and line_dedup.deduplicated(df).columns == df.columns


def test_patience_alignment():
    pairs = [(0, 3), (1, 4), (2, 0), (3, 1), (4, 5), (5, 2)]
    best = line_dedup._longest_growing(pairs)
    assert len(best) == 3 and all(a[1] < b[1] for a, b in zip(best, best[1:], strict=False))


def test_long_repeated_lines_stay_once(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF1).orderBy("doc_id").collect()]
    got = {r["doc_id"]: r["text"] for r in line_dedup.op8_line_dedup(spark, SF1).collect()}
    seen = {}
    for i, t in rows:
        kept = set(got[i].split("\n"))
        for line in set(t.split("\n")):
            if len(line.split()) >= line_dedup.MIN_WORDS:
                assert (line in kept) == (seen.setdefault(line, i) == i)


def lines_left(spark, *texts):
    """What is left of each text, with doc_ids from 1 on; a text may come with its doc_id."""
    rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts, 1)]
    return [r["text"] for r in line_dedup.removals(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id", F.length("text")).collect()]


def test_lines_apart_in_earlier_documents_stay(spark):
    stock = [f"stock line number {i}" for i in range(8)]
    apart = "\n".join(f"{line}\nown line after {i}" for i, line in enumerate(stock))
    turned, clean = "\n".join(reversed(stock)), "\n".join(stock)
    assert lines_left(spark, apart, clean) == [apart, clean]
    assert lines_left(spark, turned, clean) == [turned, clean]
    halves = ["\n".join(stock[:4]), "\n".join(stock[4:])]  # 16 words each, of two partners
    assert lines_left(spark, *halves, clean) == [*halves, clean]


def test_moved_blocks_go_if_long_enough(spark):
    a, b = ("\n".join(f"block {x} has line {i}" for i in range(6)) for x in "ab")
    small = "\n".join(f"small block line {i}" for i in range(4))
    assert lines_left(spark, f"{a}\nmiddle\n{b}\nend\n{small}", f"{small}\nnew\n{b}\n\n{a}\nlast")[1] == f"{small}\nnew\nlast"


def edited(lines, every, tag):
    return [f"new words of text {tag} line {i}" if i % every == every - 1 else line for i, line in enumerate(lines)]


def test_the_order_of_an_edited_passage_decides(spark):
    lines = [f"line {i} has six words here" for i in range(18)]
    first, mixed = "\n".join(lines), [lines[i] for i in np.random.default_rng(11).permutation(18)]
    own = [x for x in edited(lines, 3, "b") if x.startswith("new")]
    later = "\n".join(edited(lines, 3, "b"))
    assert lines_left(spark, first, later) == [first, "\n".join(own)]  # 12 lines of 6 words in order, none beside two others
    for other in ("\n".join(edited(mixed, 3, "c")), "\n".join(edited(lines[::-1], 3, "d"))):
        assert lines_left(spark, first, other) == [first, other]
    short = "\n".join(edited(lines[:11], 3, "e"))  # 8 lines: 48 words
    assert lines_left(spark, first, short) == [first, short]
    wide = "\n".join(x for line in edited(lines, 3, "f") for x in (line, f"own line one after {line}", f"own line two after {line}"))
    assert lines_left(spark, first, wide) == [first, wide]  # too far apart


def brute_chain(pairs):
    """Length of the longest growing run, of all choices."""
    best = [1] * len(pairs)
    for i, (x, y) in enumerate(pairs):
        best[i] += max((best[j] for j in range(i) if pairs[j][0] < x and pairs[j][1] < y), default=0)
    return max(best, default=0)


def test_patience_against_all_choices():
    rng = np.random.default_rng(12)
    for n in range(1, 60):
        pairs = list(enumerate(rng.permutation(n).tolist()))
        chain = line_dedup._longest_growing(pairs)
        assert len(chain) == brute_chain(pairs) and set(chain) <= set(pairs)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(chain, chain[1:], strict=False))


def brute_edited(mine, other, gap=1, least=50):
    """Lines of mine in edited blocks with other, if the longest chain of lines that are unique in both is the only one."""
    pairs = [(i, other.index(x)) for i, x in enumerate(mine) if mine.count(x) == other.count(x) == 1 and len(x.split()) >= 4]
    n, chain = brute_chain(pairs), []
    for p in pairs:  # every longest chain holds it: without it the rest has a shorter one
        if brute_chain([q for q in pairs if q != p]) < n:
            chain.append(p)
    if len(chain) < n:
        return None
    gone, run = set(), []
    for p in [*chain, (10**6, 10**6)]:
        if run and (p[0] - run[-1][0] - 1 > gap or p[1] - run[-1][1] - 1 > gap):
            if sum(len(mine[i].split()) for i, _ in run) >= least:
                gone |= {i for i, _ in run}
            run = []
        run.append(p)
    return gone


def test_edited_blocks_against_brute_force(spark):
    rng, seen = np.random.default_rng(13), 0
    base = [f"base line number {i} of text" for i in range(40)]
    for _ in range(12):
        a = int(rng.integers(0, 15))
        mine = [f"other words {rng.integers(1 << 30)} in line" if rng.random() < 0.3 else x for x in base[a : a + 25] if rng.random() < 0.9]
        if rng.random() < 0.5:
            mine = mine[9:] + mine[:9]
        gone = brute_edited(mine, base)
        if gone is None:
            continue
        for i in range(len(mine)):  # and blocks in one piece
            for j in range(len(base)):
                k = 0
                while i + k < len(mine) and j + k < len(base) and mine[i + k] == base[j + k]:
                    k += 1
                if sum(len(x.split()) for x in mine[i : i + k]) >= line_dedup.MIN_WORDS:
                    gone |= set(range(i, i + k))
        seen += 0 < len(gone) < len(mine)
        assert lines_left(spark, "\n".join(base), "\n".join(mine))[1] == "\n".join(x for i, x in enumerate(mine) if i not in gone)
    assert seen > 2


def test_repeated_blocks_go(spark):
    a, b = ("\n".join(f"block {x} has six words {i}" for i in range(10)) for x in "ab")
    first, later = f"{a}\nmiddle\n{b}", f"{a}\nnew\n{b}"
    assert lines_left(spark, (1, first), (1, first), (2, later)) == [first, first, "new"]  # the holder's row twice
    assert lines_left(spark, (1, first), (1, "other text"), (2, later), (2, f"{b}\nmore")) == ["other text", first, "new", "more"]
    assert lines_left(spark, f"{a}\nlone line", f"lone line\n{a}\nnew\n{a}")[1] == "lone line\nnew"  # the later one has it twice
    assert lines_left(spark, f"{a}\nmiddle\n{a}\nlone line", f"lone line\nnew\n{a}")[1] == "lone line\nnew"


def test_blocks_go_whoever_holds_their_lines_first(spark):
    lines = [f"line {i} has six words here" for i in range(10)]
    singles = [f"{line}\nown line {i}" for i, line in enumerate(lines)]
    block = "\n".join(lines)
    assert lines_left(spark, *singles, f"{block}\nend", f"start\n{block}")[-2:] == [f"{block}\nend", "start"]


def test_block_removal_against_brute_force(spark):
    rng = np.random.default_rng(3)
    texts = ["\n".join(f"w{k} " * (1 + k % 9) for k in rng.integers(0, 14, rng.integers(1, 30))) for _ in range(40)]
    held, left = [t.split("\n") for t in texts], []
    for n, mine in enumerate(held):
        gone = set()
        for other in held[:n]:
            for i in range(len(mine)):
                for j in range(len(other)):
                    k = 0
                    while i + k < len(mine) and j + k < len(other) and mine[i + k] == other[j + k]:
                        k += 1
                    if sum(len(x.split()) for x in mine[i : i + k]) >= line_dedup.MIN_WORDS:
                        gone.update(range(i, i + k))
        left.append("\n".join(x for i, x in enumerate(mine) if i not in gone))
    assert lines_left(spark, *texts) == left and left != texts


# 9: packing
def check_pieces(rows, pieces, capacity=1024):
    tokenizer = library("byte_bpe_50k.json")
    tokens = Counter()
    for _, t in rows:
        tokens[tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0])] += 1
    fill = Counter()
    spans = {}
    for p in pieces:
        fill[p["sequence_id"]] += p["length"]
        spans.setdefault(p["sequence_id"], []).append((p["offset"], p["offset"] + p["length"]))
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(a[1] == b[0] for a, b in zip(s, s[1:], strict=False)) and s[-1][1] <= capacity
    assert sorted(fill) == list(range(len(fill)))
    assert sum(fill.values()) == sum(len(t) * n for t, n in tokens.items())
    return sum(capacity - n for n in fill.values() if n & (n - 1)) / sum(fill.values())


def test_packing_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, sf_dir).collect()]
    pieces = packing.op9_harmonic_packing(spark, sf_dir).collect()
    assert check_pieces(rows, pieces) < 0.01
    tokenizer, texts = library("byte_bpe_50k.json"), dict(rows)
    held = {i: np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in texts.items()}
    for p in pieces:
        ids = held[p["doc_id"]]
        assert p["doc_tokens"] == len(ids) and zlib.crc32(ids[p["start"] : p["start"] + p["length"]].tobytes()) == p["ids_crc32"]


def test_packing_of_odd_texts(odd, empty):
    pieces = packing.pack(odd).collect()
    assert Counter(p["doc_id"] for p in pieces if p["start"] == 0) == Counter(i for i, _ in ODD)
    check_pieces(ODD, pieces)
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("capacity", [7, 1024])
def test_every_length_is_cut_into_reciprocal_classes(capacity):
    for n in range(1, capacity):
        got = packing.cut(n, capacity)
        assert sum(size for _, size in got) == n and all(size == capacity // k for k, size in got)


# the pipeline and what stages share
def test_pipeline_stages(spark):
    import corpus_pipeline

    docs = documents(spark, SF1)
    rules = {r["doc_id"] for r in quality_rules.op7_quality_rules(spark, SF1).where("kept").collect()}
    first = common.written(corpus_pipeline.STAGES[0][1](spark, docs, SF1), "t")
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == rules
    good = {r["doc_id"] for r in passage_quality.op10_passage_quality(spark, SF1).where("predicted = 1").collect()}
    second = common.written(corpus_pipeline.STAGES[1][1](spark, first, SF1), "t")
    assert {r["doc_id"] for r in second.collect()} == rules & good
    third = common.written(corpus_pipeline.STAGES[2][1](spark, second, SF1), "t")
    cut = {r["doc_id"]: r["text"] for r in line_dedup.removals(second).collect()}
    assert {r["doc_id"]: r["text"] for r in third.collect()} == {i: t for i, t in cut.items() if t.split()}
    fourth = common.written(corpus_pipeline.STAGES[3][1](spark, third, SF1), "t")
    rows = [(r["doc_id"], r["text"]) for r in third.collect()]
    comp = brute_components([brute_print(t) for _, t in rows])
    assert {r["doc_id"] for r in fourth.collect()} == {min(i for (i, _), d in zip(rows, comp, strict=True) if d == c) for c in set(comp)}
    fifth = corpus_pipeline.STAGES[4][1](spark, fourth, SF1).collect()
    assert check_pieces([(r["doc_id"], r["text"]) for r in fourth.collect()], fifth) < 0.01


def test_pipeline_run_leaves_its_result_only(spark):
    from pathlib import Path

    import corpus_pipeline
    from terrace.shared import checkpoint_dir

    folder = Path(checkpoint_dir(spark).removeprefix("file:")) / "terrace"
    before = set(folder.glob("*")) if folder.exists() else set()
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert {p.name.rpartition("-")[0] for p in set(folder.glob("*")) - before} == {"packing"} and out.count() > 0


def test_pipeline_stages_of_odd_rows_and_none(spark):
    import corpus_pipeline

    text = "\n".join(" ".join(f"word{(7 * i + j) % 90}" for j in range(12)) + "." for i in range(8))
    rows = [(1, text, "en", "s", 5, 1), (1, text, "en", "s", 5, 2), (None, text, None, None, None, 3), (2, None, "en", "s", 0, 4), (3, "", "en", "s", 0, 5), (4, "x" * 40_000, "en", "s", 40_000, 6), (6, "\n".join(f"{text} {i}" for i in range(400)), "en", "s", 9, 8), (5, text + "\nmore", "en", "s", 9, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _row long")
    for some in (docs, docs.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, some, SF1)
            assert out.columns == docs.columns and out.count() <= len(rows)
        assert corpus_pipeline.STAGES[4][1](spark, some, SF1).count() >= some.count()


def test_sample_is_bounded_by_stratum(spark):
    df = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 40, "rare").when(F.col("id") < 4000, "often").alias("s"))
    got = {r[0]: r[1] for r in common.sampled(df, "doc_id", "s", 100).groupBy("s").count().collect()}
    assert got == {"rare": 40, "often": 100, None: 100}


def test_partners_are_the_holders_of_rare_lines(spark):
    lines = [f"line {i} has six words here" for i in range(24)]
    evens, odds = ("\n".join(x for i, line in enumerate(lines) if i % 2 == k for x in (line, f"own words {i}")) for k in (0, 1))
    later = "\n".join(edited(lines, 3, "z"))
    own = "\n".join(x for x in later.split("\n") if x.startswith("new"))
    assert lines_left(spark, evens, odds, "\n".join(lines), later)[3] == own  # the first two hold its lines first, the third its order


def test_blocks_come_from_alignments(spark, monkeypatch):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark, SF1).collect()]
    texts = dict(rows)
    whole = by_patience = 0
    for p in line_dedup.partners(documents(spark, SF1)).collect():
        (_, words, mine), (_, _, other) = (line_dedup.solid_lines(texts[p[c]]) for c in ("doc_id", "first_doc"))
        found = [b - a for a, b in line_dedup.joined(line_dedup.common_blocks(mine, other, words))]
        with monkeypatch.context() as m:
            m.setattr(line_dedup, "growing_chains", lambda pairs: [])
            by_patience += sum(b - a for a, b in line_dedup.joined(line_dedup.common_blocks(mine, other, words)))
            m.setattr(line_dedup, "patience", lambda *x: [])
            assert line_dedup.common_blocks(mine, other, words) == []
        whole += sum(found)
    assert whole >= by_patience > 0.9 * whole


def test_growing_chains_are_as_few_as_can_be():
    rng = np.random.default_rng(14)
    for n in range(1, 50):
        pairs = list(enumerate(rng.integers(0, 20, n).tolist()))
        chains = line_dedup.growing_chains(pairs)
        assert sorted(p for c in chains for p in c) == pairs and all(a[1] < b[1] for c in chains for a, b in zip(c, c[1:], strict=False))
        falling = brute_chain([(x, 20 * n - n * y + x) for x, y in pairs])  # the longest choice whose values do not grow
        assert len(chains) == falling


def test_very_common_lines_of_odd_documents(spark):
    license_text = "\n".join(f"license line {i} with some words in it" for i in range(12))
    rows = [(i, f"own line of document {i}\n{license_text}") for i in range(300)] + [(7, "same id other text\n" + license_text), (None, license_text), (400, None), (401, ""), (402, license_text + "\nown words after it")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["text"]) for r in line_dedup.removals(df).collect()), key=str)
    cut = [(i, t if i in (0, None) or not t else t.replace("\n" + license_text, "").replace(license_text + "\n", "")) for i, t in rows]
    assert got == sorted(cut, key=str)
