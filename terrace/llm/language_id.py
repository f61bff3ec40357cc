"""Language identification by a string kernel.

The blended-spectrum presence kernel of two texts counts the hashed letter n-grams (n from 1 to 3) that both hold, divided by
the geometric mean of their own counts. Landmarks are drawn from a bounded sample of each language; the Nyström map of the
kernel to them feeds one-versus-rest kernel ridge regression, fitted on the driver. A task turns its texts into 0/1 rows over
the n-gram buckets and scores them by two matrix products: with the landmarks' rows, then with the coefficients.

Every language with a labelled row is learned, up to ROWS of them; ROWS and MARKS are shared out among the languages where there
are many. Whole texts are read, lower-cased. A null text, or one without a letter, is `und` with score 0; so is every text if no row
can be learned from. Repeated or null doc_ids are labelled row by row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 14
#: Rows of each language that are learned from, and those of them that are landmarks.
SAMPLE, LANDMARKS = 300, 48
#: Rows, and landmarks, of all languages.
ROWS, MARKS = 20_000, 1536
_MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)


def presence(texts: list[str]) -> np.ndarray:
    """A row of 0 and 1 over the n-gram buckets for each text. Runs of anything but letters count as one space."""
    rows = np.zeros((len(texts), BUCKETS), np.float32)
    for row, text in zip(rows, texts, strict=True):
        c = np.frombuffer(text.lower().encode("utf-32-le"), np.uint32)
        mark = (c < 65) | ((c > 90) & (c < 97)) | ((c > 122) & (c < 0xAA))
        c = np.where(mark, np.uint32(32), c)
        c = np.concatenate([[np.uint32(32)], c[~(mark & np.concatenate([[False], mark[:-1]]))], [np.uint32(32)]])
        h = c * _MIX[0]
        shift = np.uint32(32 - BUCKETS.bit_length() + 1)
        for n in (1, 2, 3):
            row[(h ^ np.uint32(n * 0x9E37)) * _MIX[3] >> shift] = 1
            if n < 3:
                h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * _MIX[n] + c[n:] * _MIX[0]
    return rows


def kernel(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return (x @ y.T) / np.sqrt(np.maximum(1, x.sum(1))[:, None] * np.maximum(1, y.sum(1)))


class KernelModel:
    def __init__(self, languages: list[str], landmarks: np.ndarray, coefficients: np.ndarray):
        self.languages, self.coefficients = languages, coefficients
        self._packed = np.packbits(landmarks.astype(np.uint8), axis=1)
        self._rows: np.ndarray | None = None

    def __getstate__(self):
        return self.__dict__ | {"_rows": None}

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self._rows is None:
            self._rows = unpacked(self._packed)
        return kernel(x, self._rows) @ self.coefficients

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        s = self.scores(presence(texts)) * 6  # one-versus-rest values lie about -1 and 1
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        return [self.languages[i] for i in p.argmax(axis=1)], p.max(axis=1)


def unpacked(packed: np.ndarray) -> np.ndarray:
    return np.unpackbits(packed, axis=1).astype(np.float32)


def fit_rows(packed: np.ndarray, langs: list[str], landmarks: int = LANDMARKS, ridge: float = 1e-2) -> KernelModel:
    """packed: the n-gram row of each text, eight buckets a byte. The first rows of each language are its landmarks."""
    names = sorted(set(langs))
    landmarks = max(1, min(landmarks, MARKS // len(names)))
    y = np.array([names.index(v) for v in langs])
    picked = np.concatenate([np.flatnonzero(y == k)[:landmarks] for k in range(len(names))])
    mark = unpacked(packed[picked])
    value, vector = np.linalg.eigh(kernel(mark, mark).astype(np.float64))
    good = value > 1e-6 * value.max()
    whiten = vector[:, good] / np.sqrt(value[good])  # K_mm to the power -1/2
    z = np.concatenate([kernel(unpacked(packed[i : i + 256]), mark) for i in range(0, len(packed), 256)]) @ whiten
    target = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (len(y) / len(names) / np.bincount(y, minlength=len(names)))[y][:, None]  # every language weighs the same
    beta = np.linalg.solve(z.T @ (weight * z) + ridge * len(y) * np.eye(z.shape[1]) / 100, z.T @ (weight * target))
    return KernelModel(names, mark, (whiten @ beta).astype(np.float32))


def fit(docs: DataFrame, most: int = SAMPLE, rows: int = ROWS) -> KernelModel | None:
    """Learns from at most `most` rows of each language outside fold 1 of 3, and `rows` of all."""
    ok = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (common.fold(F.col("doc_id"), 3) != 1) & (F.trim("lang") != ""))
    ok = ok.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    languages = ok.select("lang").distinct().count()
    few = common.sampled(ok.select("doc_id", "lang").distinct(), "doc_id", "lang", max(1, min(most, rows // max(1, languages))), rows)
    one = ok.join(F.broadcast(few), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("one"))
    found = grams(one.select("one.h", "one.text", "lang")).collect()
    found.sort(key=lambda r: (r["h"], r["lang"], r["packed"]))  # by hash, so that landmarks are drawn at random
    if not found:
        return None
    return fit_rows(np.stack([np.frombuffer(r["packed"], np.uint8) for r in found]), [r["lang"] for r in found])


def grams(rows: DataFrame) -> DataFrame:
    """h, lang and the packed n-gram row of each text with a letter; texts stay in their tasks."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("h", pa.int64()), ("lang", pa.string()), ("packed", pa.binary())])
        for batch in common.slices(batches, 128):
            some = batch.filter(pa.array([any(map(str.isalpha, t)) for t in batch.column("text").to_pylist()], pa.bool_()))
            packed = np.packbits(presence(some.column("text").to_pylist()).astype(np.uint8), axis=1)
            yield common.record(out, [some.column("h"), some.column("lang"), [x.tobytes() for x in packed]])

    return rows.mapInArrow(pack, "h long, lang string, packed binary")


def predicted(docs: DataFrame, model: KernelModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of docs."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])
        for batch in common.slices(batches, 128):
            texts = batch.column("text").to_pylist()
            known = [i for i, t in enumerate(texts) if model and t and any(map(str.isalpha, t))]
            langs, score = ["und"] * len(texts), np.zeros(len(texts))
            if known:
                found, score[known] = model.predict([texts[i] for i in known])
                for i, lang in zip(known, found, strict=True):
                    langs[i] = lang
            yield common.record(out, [batch.column("doc_id"), langs, score])

    found = common.plain(docs).mapInArrow(predict, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", (common.fold(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from at most SAMPLE rows of each language outside fold 1. Texts without a letter are `und`; rows of one doc_id are labelled each."""
    docs = common.table(spark, sf_dir, "documents")
    return predicted(docs, fit(docs))
