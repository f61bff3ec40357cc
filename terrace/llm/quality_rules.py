"""Quality rules: fixed base rules, then gradient-boosted trees over document statistics.

The trees are grown on statistics of a bounded sample of labelled rows, with a score that may only fall as the shares of
symbols, repeated lines, repeated and doubled words, capitals and exclamation marks rise (six constraints set by hand). They
are laid out as complete binary trees in numpy arrays, which score all documents of a batch level by level. Each task scores its own rows: there is no shuffle.

A null or empty text has no words and fails the base rules. Repeated or null doc_ids are judged row by row. Without labelled
rows of both kinds the base rules alone decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common, textstats

#: Labelled rows of each kind that the trees are grown on.
SAMPLE = 3000
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeats", "upper", "shouts", "digits", "distinct", "adjacent", "marks")
#: The score may only fall (-1) with these.
MONOTONE = {"symbols": -1, "dup_lines": -1, "repeats": -1, "upper": -1, "shouts": -1, "adjacent": -1}


def statistics(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(base counts, features) of each text."""
    base = np.array([textstats.base_counts(t) for t in texts], np.int64).reshape(-1, 5)
    owner, table = textstats.passages(texts)
    size = np.expm1(table[:, 0])
    total = np.maximum(1, np.bincount(owner, size, minlength=len(texts)))
    mean = lambda name: np.bincount(owner, table[:, textstats.PASSAGE.index(name)] * size, minlength=len(texts)) / total
    words = np.maximum(1, base[:, 0])
    lines = np.array([t.count(b"\n") + 1 for t in texts])
    x = np.stack(
        [np.log1p(base[:, 0]), base[:, 1] / words, base[:, 2] / np.maximum(1, base[:, 1]), base[:, 3] / lines, base[:, 4] / words]
        + [mean(name) for name in ("upper", "shouts", "digits", "distinct", "adjacent", "marks")],
        axis=1,
    )
    return base, x


class Trees:
    """Boosted trees of one depth: arrays of features and thresholds by (tree, node), of values by (tree, leaf)."""

    def __init__(self, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray, bias: float):
        self.feature, self.threshold, self.value, self.bias = feature, threshold, value, bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        rows, total = np.arange(len(x)), np.full(len(x), self.bias)
        inner = self.feature.shape[1]
        for f, t, v in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            while inner and len(node) and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > t[node])
            total += v[node - inner]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, monotone: list[int], rounds: int = 60, depth: int = 3, rate: float = 0.2, ridge: float = 2.0, bins: int = 48) -> Trees:
    """Newton boosting of the logistic loss on quantile bins; both kinds weigh the same. A node's value stays within the bounds
    that constrained splits above it set."""
    n, m = x.shape
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(cuts[j], x[:, j], side="left") for j in range(m)], axis=1)
    weight = np.where(y > 0, 0.5 / max(1e-9, y.mean()), 0.5 / max(1e-9, 1 - y.mean()))
    inner, margin = (1 << depth) - 1, np.zeros(n)
    feature, threshold, value = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, inner + 1))
    for r in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = weight * (p - y), weight * np.maximum(p * (1 - p), 1e-6)
        node, low, high = np.zeros(n, np.int64), np.full(2 * inner + 1, -np.inf), np.full(2 * inner + 1, np.inf)
        for k in range(inner):
            mine = np.flatnonzero(node == k)
            low[2 * k + 1 : 2 * k + 3], high[2 * k + 1 : 2 * k + 3] = low[k], high[k]
            best = (1e-6, None)
            if len(mine) >= 10:
                gs, hs = g[mine].sum(), h[mine].sum()
                whole = gs * gs / (hs + ridge)
                for j in range(m):
                    gl = np.cumsum(np.bincount(binned[mine, j], g[mine], len(cuts[j]) + 1))[:-1]
                    hl = np.cumsum(np.bincount(binned[mine, j], h[mine], len(cuts[j]) + 1))[:-1]
                    wl = np.clip(-gl / (hl + ridge), low[k], high[k])
                    wr = np.clip(-(gs - gl) / (hs - hl + ridge), low[k], high[k])
                    gain = gl * gl / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - whole
                    ok = (hl > 0.05) & (hs - hl > 0.05) & ((wr - wl) * monotone[j] >= 0)
                    gain = np.where(ok, gain, -1)
                    if len(gain) and gain.max() > best[0]:
                        c = int(gain.argmax())
                        best = (gain[c], (j, c, wl[c], wr[c]))
            if best[1]:
                j, c, wl, wr = best[1]
                feature[r, k], threshold[r, k] = j, cuts[j][c]
                if monotone[j]:
                    mid = (wl + wr) / 2
                    above, below = (2 * k + 1, 2 * k + 2) if monotone[j] < 0 else (2 * k + 2, 2 * k + 1)
                    low[above], high[below] = max(low[k], mid), min(high[k], mid)
                node[mine] = 2 * k + 1 + (binned[mine, j] > c)
            else:
                node[mine] = 2 * k + 1
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, inner + 1), np.bincount(leaf, h, inner + 1)
        value[r] = rate * np.clip(-gs / (hs + ridge), low[inner:], high[inner:])
        margin += value[r][leaf]
    return Trees(feature, threshold, value, 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> Trees | None:
    """The trees, grown on the driver from the statistics of the sample; None without both kinds of rows."""

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.list_(pa.float64()))])
        for batch in common.slices(batches):
            yield common.record(out, [batch.column("doc_id"), batch.column("label").cast(pa.int32()), list(statistics(common.text_bytes(batch))[1])])

    rows = common.labelled(docs, labels, label, most).mapInArrow(measured, "doc_id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["x"]))
    y = np.array([r["label"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return None
    return grow(np.array([r["x"] for r in rows]), y, [MONOTONE.get(f, 0) for f in FEATURES])


def judge(texts: list[bytes], trees: Trees | None, least: float = 0.5) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(base counts, base_failed, score, kept) of each text."""
    base, x = statistics(texts)
    failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
    score = trees.scores(x) if trees else np.ones(len(texts))
    return base, failed, score, ~failed & (score >= least)


def verdicts(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """doc_id, the base counts, base_failed, score and kept for each row of docs."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in textstats.BASE), ("base_failed", pa.bool_()), ("score", pa.float64()), ("kept", pa.bool_())])
        for batch in common.slices(batches):
            base, failed, score, kept = judge(common.text_bytes(batch), trees)
            yield common.record(out, [batch.column("doc_id"), *base.T, failed, score, kept])

    ddl = "doc_id long, " + "".join(f"{n} long, " for n in textstats.BASE) + "base_failed boolean, score double, kept boolean"
    return common.plain(docs).mapInArrow(judged, ddl)


def keep(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield batch.filter(pa.array(judge(common.text_bytes(batch), trees)[3]))

    return docs.mapInArrow(kept, docs.schema)


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of every document, by base rules and then trees learned outside fold 0. Null and empty texts fail the base rules; rows of one doc_id are judged each."""
    docs = common.table(spark, sf_dir, "documents")
    return verdicts(docs, fit(docs, common.table(spark, sf_dir, "labels")))
