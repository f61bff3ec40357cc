"""What the learned operators and the index are fitted on: bounded, and never a part of a text."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from terrace.llm import common, hilbert_ann, language_id, passage_quality, textstats, toxicity

LABELS = "doc_id long, quality int, toxic int"


def test_bounded_rows_are_whole_and_within_the_bound(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), (F.col("id") % 7 + 1).alias("n")).union(spark.createDataFrame([(1000, 900)], "doc_id long, n long"))
    got = common.bounded(df, "n", 320).collect()
    assert 300 < sum(r["n"] for r in got) <= 320 and all(r["doc_id"] != 1000 for r in got)
    assert common.bounded(df, "n", 1 << 20).count() == 301


def test_forty_languages_are_learned(spark):
    rng = np.random.default_rng(40)
    words = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 5, p=rng.dirichlet(np.full(26, 0.2)))) for _ in range(30)] for _ in range(40)]
    rows = [(i, " ".join(rng.choice(words[i % 40], 30)), f"lang{i % 40:02}") for i in range(1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs)
    assert len(model.languages) == 40
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predicted(docs, model).where("held_out").collect()}
    assert np.mean([lang == rows[i][2] for i, lang in got.items()]) > 0.95
    few = language_id.fit(docs, rows=80)
    assert len(few.languages) == 40


def test_nystroem_on_all_rows_is_kernel_ridge_regression():
    rng = np.random.default_rng(41)
    texts = ["".join(rng.choice(list("abcdef " if i % 2 else "defghi "), 60)) for i in range(30)]
    langs = ["xy"[i % 2] for i in range(30)]
    x = language_id.presence(texts)
    model = language_id.fit_rows(np.packbits(x.astype(np.uint8), axis=1), langs, ridge=1e-2)
    k = language_id.kernel(x, x).astype(float)
    target = np.array([[1.0, -1.0] if v == "x" else [-1.0, 1.0] for v in langs])
    dense = k @ np.linalg.solve(k + 1e-2 * len(langs) * np.eye(30) / 100, target)
    assert np.allclose(model.scores(x), dense, atol=2e-2)


def test_toxicity_learns_from_the_last_words_of_a_text(spark):
    rng = np.random.default_rng(45)
    filler = ["".join(rng.choice(list("bcdfgaeiou"), 6)) for _ in range(3000)]
    rows = [(i, " ".join(rng.choice(filler, 550, replace=False)) + (" idiot moron zzznasty zzzvile" if i % 2 else " zzzkind zzzgood"), i % 2) for i in range(600)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, t) for i, _, t in rows], LABELS)
    model = toxicity.fit(docs, labels)
    assert {"zzznasty", "zzzvile"} <= {e for x in model.voters.mined for e in x} | set(model.words)
    score = model.scores(["zzznasty zzzvile " + " ".join(filler[:30]), "zzzkind zzzgood " + " ".join(filler[:30])])
    assert score[0] > score[1]


def test_quality_learns_from_a_passage_at_any_place(spark):
    rng = np.random.default_rng(42)
    good, bad = "river stone garden window morning letter".split(), "offer click winner casino prize bonus".split()

    def text(i):
        passages = [" ".join(rng.choice(good, 64)) for _ in range(25)]
        if i % 2 == 0:
            passages[19 + i % 5] = " ".join(rng.choice(bad, 64))
        return " ".join(passages)

    rows = [(i, text(i)) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = passage_quality.fit(docs, spark.createDataFrame([(i, i % 2, 0) for i, _ in rows], LABELS))
    held = passage_quality.scored(docs, model).where("held_out").collect()
    assert len(held) > 40 and np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.9


def peak(f):
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_long_texts_are_handled_few_at_a_time(spark):
    rows = [(i, "x" * n) for i, n in enumerate([10, 3 << 20, 1 << 20, 1 << 20, 1 << 20, *[1 << 14] * 300])]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["doc_id", "text"])
    got = list(common.slices([batch]))
    assert [x for b in got for x in b.column("doc_id").to_pylist()] == list(range(305))
    assert all(b.num_rows == 1 or b.nbytes <= common.SLICE_BYTES for b in got) and max(b.num_rows for b in got) > 60


def test_words_of_a_long_text_are_hashed_in_parts(monkeypatch):
    rng = np.random.default_rng(47)
    words = ["".join(rng.choice(list("abcdefA9.é"), n)) for n in rng.integers(1, 9, 500)]
    text = " ".join(rng.choice(words, 200_000)).encode()
    _, most = peak(lambda: textstats.passages_and_words([text]))
    assert most < 30 * len(text)
    texts = [b"", b" \n", text[:3000], b"a", b"\tb  c\n" + b"d" * 2000]
    whole = textstats.passages_and_words(texts)
    monkeypatch.setattr(textstats, "HASHED", 7)
    assert all((a == b).all() for a, b in zip(whole, textstats.passages_and_words(texts), strict=True))
    assert [textstats.n_passages(t) for t in texts] == np.bincount(whole[0]).tolist()


def test_rows_of_the_quality_sample_are_chosen_by_size_alone(spark, monkeypatch):
    seen, real = [], common.bounded
    monkeypatch.setattr(common, "bounded", lambda rows, *how: (seen.append(dict(rows.dtypes)), real(rows, *how))[1])
    monkeypatch.setattr(passage_quality, "PASSAGES", 64)
    rows = [(i, ("good river " if i % 2 else "bad casino ") * (400 if i == 3 else 40), i % 2) for i in range(60)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(7, 0, 0)], LABELS)
    sizes, fit = [], passage_quality.BagModel.fit
    monkeypatch.setattr(passage_quality.BagModel, "fit", lambda self, bags, y, **how: (sizes.append([len(t) for t in bags.tables]), fit(self, bags, y, epochs=1))[1])
    passage_quality.fit(docs, labels)
    assert seen == [{"doc_id": "bigint", "label": "int", "n": "int"}]
    assert len(sizes) == 1 and 40 < sum(sizes[0]) <= 64 and max(sizes[0]) == 2


def test_long_bags_are_learned_from_in_blocks(monkeypatch):
    rng = np.random.default_rng(48)
    parts = [(rng.normal(size=(n, 13)).astype(np.float32), np.repeat(np.arange(n), 20), rng.integers(0, passage_quality.BUCKETS, 20 * n)) for n in [1500, 3, 900, 700, 40, 1200] * 6]
    y = np.arange(36) % 2.0
    bags, model = passage_quality.Bags(parts), lambda: passage_quality.BagModel(13, embedded=passage_quality.BUCKETS)
    whole, most = peak(lambda: model().fit(bags, y, epochs=1))
    assert most < 13 * passage_quality.HELD * (13 + passage_quality.BUCKETS)  # bytes; 141 MB when a batch was held whole
    monkeypatch.setattr(passage_quality, "HELD", 1000)
    assert [sum(bags.sizes(b)) for b in bags.blocks(range(6))] == [1500, 903, 740, 1200]
    blocks = model().fit(bags, y, epochs=1)
    assert all(np.allclose(whole.p[k], blocks.p[k], atol=1e-3) for k in whole.p) and np.isclose(whole.shift, blocks.shift, atol=1e-2)


def brute(rows, ask, k=5):
    out = set()
    for q, v in rows:
        if q in ask:
            near = sorted((-float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), i) for i, w in rows if i != q and len(w) == len(v))
            out |= {(q, i) for _, i in near[:k]}
    return out


def spied(monkeypatch):
    widths, real = [], hilbert_ann.Curves
    monkeypatch.setattr(hilbert_ann, "Curves", lambda sample, **how: (widths.append(sample.shape), real(sample, **how))[1])
    return widths


def test_a_rare_length_has_curves_of_its_own(spark, monkeypatch):
    widths = spied(monkeypatch)
    rng = np.random.default_rng(43)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(1000, 21_000)] + [(i, rng.normal(size=7).tolist()) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    ask = set(range(0, 400, 10))
    got = hilbert_ann.search(df, spark.createDataFrame([(i,) for i in ask], "vec_id long"))
    found = {(r["query_id"], r["vec_id"]) for r in got.collect()}
    truth = brute([r for r in rows if len(r[1]) == 7], ask)
    assert sorted(n for _, n in widths) == [4, 7] and (400, 7) in widths
    assert len(found & truth) >= 0.9 * len(truth) and len(found) == len(truth)


def test_curves_find_odd_and_equal_vectors(spark, monkeypatch):
    widths = spied(monkeypatch)
    rng = np.random.default_rng(44)
    base = rng.integers(-9, 9, 8).astype(float)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(100, 500)] + [(i, (m * base).tolist()) for i, m in ((7, 3.0), (3, 5.0), (9, 1.0), (4, 0.5), (8, 7.0), (50, 11.0), (6, 2.0))]
    odd = [(51, [1e200] * 8), (52, [1e-200] * 8), (200, None), (201, [0.0] * 8), (202, [1.0, None] * 4), (203, [float("nan")] * 8), (None, [1.0] * 8)]
    copies = [(i, [2.0] * 8) for i in range(1000, 1600)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows + odd + copies], "vec_id long, embedding array<double>, score string, n int").repartition(4)
    got = sorted(tuple(r)[:4] for r in hilbert_ann.search(df, df.where("vec_id in (50, 51, 52, 100, 1001)").select("vec_id")).collect())
    by = {q: [(i, s) for q2, _, i, s in got if q2 == q] for q in (50, 51, 52, 100, 1001)}
    assert widths and [n for _, n in widths] == [8]
    assert by[50] == [(3, 1.0), (4, 1.0), (6, 1.0), (7, 1.0), (8, 1.0)]
    assert by[51] == [(52, 1.0), *((i, 1.0) for i in range(1000, 1004))] and by[52][0] == (51, 1.0)
    assert by[1001] == [(51, 1.0), (52, 1.0), (1000, 1.0), (1002, 1.0), (1003, 1.0)] and len(by[100]) == 5


def test_bags_make_the_inputs_of_their_passages():
    rng = np.random.default_rng(46)
    parts, whole = [], []
    for n in (1, 4, 2, 7):
        table, row = rng.normal(size=(n, 13)).astype(np.float32), np.sort(rng.integers(0, n, 40 * (n > 1)))
        bucket = rng.integers(0, 6, len(row))
        parts.append((table, row, bucket))
        whole.append(passage_quality.inputs(table, row, bucket))
    bags = passage_quality.Bags(parts)
    assert (bags.together([2, 0, 3]) == np.concatenate([whole[j] for j in (2, 0, 3)])).all() and bags.sizes([1, 3]) == [4, 7]
    y = np.array([0.0, 1.0, 0.0, 1.0])
    models = [passage_quality.BagModel(13, embedded=passage_quality.BUCKETS).fit(b, y, epochs=3) for b in (bags, [w.copy() for w in whole])]
    assert models[0].shift == models[1].shift and all((models[0].p[k] == models[1].p[k]).all() for k in models[0].p)
