"""Hard negatives against brute force in whole numbers."""

import math

import numpy as np
import pytest

from terrace.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int, cell string, n string"


def usable(v):
    return v is not None and None not in v and all(map(math.isfinite, v))


def brute_mined(rows, ask, positives=5, negatives=3):
    rows = [(i, tuple(math.floor(256 * x) for x in v), label) for i, v, label in {(i, tuple(v) if v is not None else None, label) for i, v, label in rows} if i is not None and label is not None and usable(v)]
    rows = list(set(rows))
    out = []
    for a, q, own in rows:
        if a not in ask:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, label) for i, v, label in rows if i != a and len(v) == len(q))
        for p, positive, _ in [s for s in scored if s[2] == own][:positives]:
            window = [(i, -n) for n, i, label in scored if label != own and 50 * -p <= 100 * -n <= 95 * -p]
            out += [(a, positive, k + 1, i, -p, n) for k, (i, n) in enumerate(window[:negatives])]
    return sorted(out)


def mined(spark, rows, ask, **how):
    df = spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v], label, "c", "n") for i, v, label in rows], SCHEMA).repartition(3)
    got = hard_negatives.mined(df, spark.createDataFrame([(i,) for i in ask], "vec_id long"), **how)
    assert dict(got.dtypes)["rank"] == "int"
    return sorted(tuple(r)[:6] for r in got.collect())


def clustered(seed, n, width=6, labels=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(5, width))
    return [(i, (centres[rng.integers(5)] + 0.2 * rng.normal(size=width)).tolist(), int(rng.integers(labels))) for i in range(n)]


@pytest.mark.parametrize(("held", "pivots"), [(60, 5), (1 << 21, 16), (1 << 21, 1)])
def test_mined_against_brute_force(spark, held, pivots):
    rows = clustered(1, 160)
    got = mined(spark, rows, range(0, 160, 9), held=held, pivots=pivots)
    assert got == brute_mined(rows, set(range(0, 160, 9))) and len(got) > 50


def test_mined_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"], None if r["label"] is None else (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got = sorted(tuple(r)[:6] for r in hard_negatives.op12_hard_negatives(spark, sf_dir).collect())
    assert got == brute_mined(rows, {i for i, _, _ in rows if i % 50 == 0}) and len(got) > 50


def test_mined_of_odd_rows(spark):
    rows = clustered(2, 60, width=3)
    rows += [(100 + i, [0.5, 0.5, 0.5], i % 3) for i in range(30)] + [(7, [0.1, 0.2, 0.3], 2), (7, [0.1, 0.2, 0.3], 2), (7, [0.9, 0.2, 0.3], 1), (8, [0.1, 0.2, 0.3], 0)]
    rows += [(200, None, 1), (201, [1.0, None, 2.0], 1), (202, [1.0, float("nan"), 0.0], 0), (203, [float("inf"), 1.0, 1.0], 0), (None, [1.0, 1.0, 1.0], 1), (204, [1.0, 1.0, 1.0], None)]
    rows += [(205, [0.0, 0.0, 0.0], 0), (206, [], 0), (207, [], 1), (208, [], 0), (209, [1.0], 0), (210, [1.5], 0), (211, [0.8], 1), (212, [1.0, 1.0], 1)]
    ask = {0, 1, 7, 8, 100, 101, 200, 204, 205, 206, 209, 212, 999}
    got = mined(spark, rows, ask, held=90)
    assert got == brute_mined(rows, ask) and {r[0] for r in got} >= {7, 100, 206, 209}
    assert mined(spark, [], ask) == []


def test_mined_of_very_long_vectors_is_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.integers(1, 9, 4) * 2.0 ** rng.integers(0, 18)).tolist(), int(rng.integers(2))) for i in range(60)]
    assert mined(spark, rows, range(20)) == brute_mined(rows, set(range(20)))
    huge = [(0, [1e300, 1.0], 0), (1, [2.0, 1.0], 0), (2, [0.004, 0.0], 1), (3, [1.0, 1.0], 1)]
    assert all(r[4] == r[5] == 2**63 - 1 or r[0] != 0 for r in mined(spark, huge, [0, 1]))


def test_brackets_hold_every_score():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(400, 8)) * 256 * rng.lognormal(0, 1, (400, 1)))
    pivots = hard_negatives.Pivots(x[:50], float((x * x).sum(axis=1).max()), 7)
    table = pivots.distances(x).T
    pruned = 0
    for q in x[:60]:
        own = pivots.distances(q[None], anchors=True)[0]
        least, most = hard_negatives.bracket(table, table, own, float(q @ q), pivots.longest)
        assert (least <= x @ q).all() and (x @ q <= most).all()
        pruned += (most < np.sort(x @ q)[-5]).sum()
    assert pruned > 100
