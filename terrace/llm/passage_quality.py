"""Quality classifier: attention-based multiple-instance learning over passages.

A document is a bag of passages of 64 words. Every passage is encoded by a dense layer from what it says and how it is
written: the embeddings of its words and word pairs, by hash, and its character and word statistics. A gated attention layer
weighs the passages, and the weighted mean of their codes is scored. All layers, embeddings included, are learned together
from document labels alone, by Adam on a bounded sample of labelled rows: of SAMPLE rows of each kind as many as hold PASSAGES
passages, each with all of its own. Each task then scores its own documents, every passage of them, so there is no shuffle.

A null or empty text is a bag of one passage of zeros. Repeated or null doc_ids are scored row by row. Without labelled rows
of both kinds every score is the share of good rows in the sample, or 0.5.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, textstats

#: Labelled rows of each kind that the model is fitted on.
SAMPLE = 2500
#: Passages of all these rows, and hashed words and word pairs that have embeddings.
PASSAGES, BUCKETS = 50_000, 1024
#: Passages that a task encodes at a time, and passages of more than one document whose inputs the fit holds.
BLOCK, HELD = 2048, 8192
#: A score from here on predicts label 1; the scores are shifted so that the sample is split best here.
CUT = 0.3


def contents(row: np.ndarray, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(passage, bucket) of each word and of each pair of neighbours in a passage, passages in order."""
    top = np.uint64(65 - BUCKETS.bit_length())
    one = words * np.uint64(0x9E3779B97F4A7C15) >> top
    two = (words[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + words[1:]) * np.uint64(0x9E3779B97F4A7C15) >> top
    rows, buckets = np.concatenate([row, row[1:][~first[1:]]]), np.concatenate([one, two[~first[1:]]]).astype(np.int64)
    order = np.argsort(rows, kind="stable")
    return rows[order], buckets[order]


def inputs(table: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """The statistics of each passage, then the square root of each bucket's share of its words and pairs."""
    n = len(table)
    held = np.bincount(row * BUCKETS + bucket, minlength=n * BUCKETS).reshape(n, BUCKETS).astype(np.float32)
    held /= np.maximum(1, held.sum(axis=1, keepdims=True))
    return np.concatenate([table.astype(np.float32), np.sqrt(held, out=held)], axis=1)


class Bags:
    """The passages of documents: statistics, and what a passage holds of its few buckets. together() makes inputs() of some documents."""

    def __init__(self, parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        """parts: of each document the table of its passages, and (passage, bucket) of its words and pairs."""
        self.tables, self._held = [], []
        for table, row, bucket in parts:
            cell, times = np.unique(row * BUCKETS + bucket, return_counts=True)
            of = cell // BUCKETS
            share = times.astype(np.float32) / np.maximum(1, np.bincount(row, minlength=len(table)))[of].astype(np.float32)
            self.tables.append(table.astype(np.float32))
            self._held.append((of.astype(np.int32), (cell % BUCKETS).astype(np.int32), np.sqrt(share)))

    def __len__(self) -> int:
        return len(self.tables)

    def sizes(self, some: Sequence[int]) -> list[int]:
        return [len(self.tables[j]) for j in some]

    def blocks(self, some: Sequence[int]) -> list[list[int]]:
        """some, dealt into runs of HELD passages at most, or of one document."""
        out, size = [], HELD
        for j, n in zip(some, self.sizes(some), strict=True):
            if size + n > HELD:
                out.append([])
                size = 0
            out[-1].append(j)
            size += n
        return out

    def together(self, some: Sequence[int]) -> np.ndarray:
        sizes = self.sizes(some)
        width = self.tables[0].shape[1]
        x = np.zeros((sum(sizes), width + BUCKETS), np.float32)
        x[:, :width] = np.concatenate([self.tables[j] for j in some])
        for j, start in zip(some, np.cumsum([0, *sizes[:-1]]).tolist(), strict=True):
            of, bucket, share = self._held[j]
            x[of + start, bucket + width] = share
        return x


class _Dense(Bags):
    """Bags whose inputs are given."""

    def __init__(self, tables: Sequence[np.ndarray]):
        self.tables = list(tables)

    def together(self, some: Sequence[int]) -> np.ndarray:
        return np.concatenate([self.tables[j] for j in some])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BagModel:
    """Encoder h = tanh(xW + b); attention a ~ exp((tanh(hV) * sigmoid(hU))w); score sigmoid(c . sum(a h) + d).

    The first `features` inputs are statistics; a row of W for each of the `embedded` others is the embedding of a bucket.
    """

    def __init__(self, features: int, width: int = 24, gate: int = 12, seed: int = 5, embedded: int = 0):
        rng = np.random.default_rng(seed)
        init = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape)
        self.features = features
        self.p = {"W": init(features, width), "b": np.zeros(width), "V": init(width, gate), "U": init(width, gate), "w": init(gate), "c": init(width), "d": np.zeros(1)}
        if embedded:
            self.p["W"] = np.concatenate([self.p["W"], rng.normal(0, 0.1, (embedded, width))])
        self.mean, self.scale, self.shift = np.zeros(features), np.ones(features), 0.0

    def _scale(self, x: np.ndarray) -> np.ndarray:
        """x itself, with its statistics scaled."""
        x[:, : self.features] = np.clip((x[:, : self.features] - self.mean) / self.scale, -8, 8)
        return x

    def code(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(x @ self.p["W"].astype(x.dtype) + self.p["b"])

    def _forward(self, x: np.ndarray, bag: np.ndarray, n: int) -> dict:
        return self.attend(self.code(x), bag, n)

    def attend(self, h: np.ndarray, bag: np.ndarray, n: int) -> dict:
        p = self.p
        t, s = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        e = np.exp(np.clip((t * s) @ p["w"], -30, 30))
        a = e / np.bincount(bag, e, n)[bag]
        z = np.stack([np.bincount(bag, a * h[:, j], n) for j in range(h.shape[1])], axis=1)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "logit": z @ p["c"] + p["d"][0]}

    def _gradient(self, x: np.ndarray, bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        return self._gradient_of([lambda: x], bag, y, weight)

    def _gradient_of(self, blocks: Sequence[Callable[[], np.ndarray]], bag: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        """blocks: each makes a part of the inputs, twice."""
        p, f = self.p, self.attend(np.concatenate([self.code(x()) for x in blocks]), bag, len(y))
        dlogit = weight * (_sigmoid(f["logit"]) - y) / len(y)
        dz = dlogit[:, None] * p["c"]
        da = (dz[bag] * f["h"]).sum(axis=1)
        dh = f["a"][:, None] * dz[bag]
        du = f["a"] * (da - np.bincount(bag, f["a"] * da, len(y))[bag])  # through the softmax of each bag
        dt, ds = du[:, None] * f["s"] * p["w"], du[:, None] * f["t"] * p["w"]
        dt, ds = dt * (1 - f["t"] ** 2), ds * f["s"] * (1 - f["s"])
        dh += dt @ p["V"].T + ds @ p["U"].T
        dh *= 1 - f["h"] ** 2
        dw, at = 0.0, 0
        for make in blocks:
            x = make()
            dw = dw + x.T @ dh[at : at + len(x)].astype(x.dtype)
            at += len(x)
        return {"W": dw, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": (f["t"] * f["s"]).T @ du, "c": f["z"].T @ dlogit, "d": np.array([dlogit.sum()])}

    def _makers(self, bags: Bags, some: list[int]) -> list[Callable[[], np.ndarray]]:
        parts = bags.blocks(some)
        if len(parts) == 1:
            x = self._scale(bags.together(some))
            return [lambda: x]
        return [lambda part=part: self._scale(bags.together(part)) for part in parts]

    def fit(self, bags: Bags | Sequence[np.ndarray], y: np.ndarray, epochs: int = 25, batch: int = 64, rate: float = 0.01, decay: float = 1e-4, seed: int = 6) -> BagModel:
        bags = bags if isinstance(bags, Bags) else _Dense(bags)
        rows = np.concatenate([b[:, : self.features] for b in bags.tables])
        self.mean, self.scale = rows.mean(0), rows.std(0) + 1e-3
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        rng, step = np.random.default_rng(seed), 0
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for i in range(0, len(y), batch):
                some = order[i : i + batch].tolist()
                bag = np.repeat(np.arange(len(some)), bags.sizes(some))
                step += 1
                for k, g in self._gradient_of(self._makers(bags, some), bag, y[some], weight[some]).items():
                    g = g + decay * self.p[k]
                    m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        bag = np.repeat(np.arange(len(y)), bags.sizes(range(len(y))))
        codes = np.concatenate([self.code(self._scale(bags.together(part))) for i in range(0, len(y), batch) for part in bags.blocks(range(i, min(i + batch, len(y))))])
        self.shift = _best_cut(self.attend(codes, bag, len(y))["logit"], y)
        return self

    def scores(self, codes: np.ndarray, bag: np.ndarray, n: int) -> np.ndarray:
        """Of n bags of passages with these codes."""
        return _sigmoid(self.attend(codes, bag, n)["logit"] - self.shift + np.log(CUT / (1 - CUT)))


def _best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The value that splits the kinds with the best mean of the two rates; the middle of the best stretch."""
    order = np.argsort(logit)
    s, t = logit[order], y[order]
    gain = np.concatenate([[0], np.cumsum((1 - t) / max(1, (1 - y).sum()) - t / max(1, y.sum()))])  # kind 0 below, kind 1 above
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    edges = np.concatenate([[s[0] - 1], (s[1:] + s[:-1]) / 2, [s[-1] + 1]])
    return float(edges[best[len(best) // 2]])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = SAMPLE) -> BagModel | float:
    """The model, or the share of label 1 if the sample holds one kind only. Rows are chosen by their sizes, and only these are encoded, so
    that no task meets what the whole sample says."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("n", pa.int32())])
        for batch in common.slices(batches):
            yield common.record(out, [batch.column("doc_id"), batch.column("label").cast(pa.int32()), [textstats.n_passages(t) for t in common.text_bytes(batch)]])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("label", pa.int32()), ("x", pa.binary()), ("row", pa.binary()), ("bucket", pa.binary())])
        for batch in common.slices(batches):
            owner, x, *words = textstats.passages_and_words(common.text_bytes(batch))
            row, bucket = contents(*words)
            at = np.searchsorted(owner, np.arange(batch.num_rows + 1))
            parts = []
            for a, b in zip(at[:-1], at[1:], strict=True):
                i, j = np.searchsorted(row, [a, b])
                parts.append((x[a:b].tobytes(), (row[i:j] - a).astype(np.uint16).tobytes(), bucket[i:j].astype(np.uint16).tobytes()))
            yield common.record(out, [batch.column("doc_id"), batch.column("label").cast(pa.int32()), *zip(*parts, strict=True)])

    sample = common.labelled(docs, labels, label, most)
    few = common.bounded(sample.mapInArrow(counted, "doc_id long, label int, n int"), "n", PASSAGES).select("doc_id", "label")
    rows = sample.join(F.broadcast(few), ["doc_id", "label"]).mapInArrow(encoded, "doc_id long, label int, x binary, row binary, bucket binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["label"], r["x"], r["bucket"]))
    y = np.array([r["label"] for r in rows], float)
    if not 0 < y.sum() < len(y):
        return float(y.mean()) if len(y) else 0.5
    whole = lambda b: np.frombuffer(b, np.uint16).astype(np.int64)
    bags = Bags([(np.frombuffer(r["x"], np.float32).reshape(-1, len(textstats.PASSAGE)), whole(r["row"]), whole(r["bucket"])) for r in rows])
    del rows
    return BagModel(len(textstats.PASSAGE), embedded=BUCKETS).fit(bags, y)


def score_texts(texts: list[bytes], model: BagModel | float) -> np.ndarray:
    if isinstance(model, float):
        return np.full(len(texts), model)
    bag, table, *words = textstats.passages_and_words(texts)
    row, bucket = contents(*words)
    codes = []
    for at in range(0, len(table), BLOCK):
        i, j = np.searchsorted(row, [at, at + BLOCK])
        codes.append(model.code(model._scale(inputs(table[at : at + BLOCK], row[i:j] - at, bucket[i:j]))))
    return model.scores(np.concatenate(codes), bag, len(texts))


def scored(docs: DataFrame, model: BagModel | float) -> DataFrame:
    """doc_id, held_out, score, predicted for each row of docs."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])
        for batch in common.slices(batches):
            yield common.record(out, [batch.column("doc_id"), score_texts(common.text_bytes(batch), model)])

    found = common.plain(docs).mapInArrow(score, "doc_id long, score double")
    return found.select("doc_id", (common.fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: BagModel | float) -> DataFrame:
    """The rows of docs that are predicted good, with all their columns."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            yield batch.filter(pa.array(score_texts(common.text_bytes(batch), model) >= CUT))

    return docs.mapInArrow(kept, docs.schema)


def op10_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document, learned from at most SAMPLE labelled rows of each kind outside fold 0. Null and empty texts are scored as one passage of zeros; rows of one doc_id each."""
    docs = common.table(spark, sf_dir, "documents")
    return scored(docs, fit(docs, common.table(spark, sf_dir, "labels")))
