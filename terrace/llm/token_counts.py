"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where their encodings meet again.

A byte-level BPE first cuts a text into pre-tokens and merges inside them only. Each cut hangs on the text from the pre-token's
start to two code points after its end, never on what stands before, and a special string is found wherever it stands. So if
the encodings of two overlapping chunks have a pre-token's end in common, and that end lies further from the first chunk's end
than a special string and those two code points are long, then from there on the second chunk is encoded as the whole text is,
provided the first one was so up to there: the boundary is proven, chunk by chunk from the text's start. The first common
boundary of two chunks is their splice, and a text's count is the sum of what its chunks hold between their splices.

A text of up to `chunk` code points is one piece, counted where it is read. The chunks of longer ones are rows of a table, which
any task may encode; only their boundaries inside the overlaps go on. Where two chunks have no boundary in common, as inside a
word or a run of spaces longer than the overlap, the overlap is widened to both of them: they are encoded as one, and its
splices are sought anew, until all are found. A pre-token is thus in one task at last, however long it is, as its merges need.

A null or empty text has no bytes and no tokens. Special strings inside texts are special tokens, as is the library's default.
Repeated and null doc_ids are counted row by row, other columns are ignored, and an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import ByteBpe, byte_bpe

#: Code points of a chunk, and of the part that it shares with the next one.
CHUNK, OVERLAP = 1 << 16, 1 << 10
LIMIT = 512
#: Code points beyond a pre-token's end that its end may hang on.
AHEAD = 2


def margin(bpe: ByteBpe) -> int:
    """How far from a chunk's end a boundary must be to be one of the whole text, too."""
    return AHEAD + max((len(s) for s in bpe.special), default=0)


def boundaries(text: str, bpe: ByteBpe) -> tuple[np.ndarray, np.ndarray]:
    """The ends of the pre-tokens and special strings of a text, 0 first, and the number of tokens before each."""
    parts = re.split("(" + "|".join(map(re.escape, sorted(bpe.special, key=len, reverse=True))) + ")", text) if any(s in text for s in bpe.special) else [text]
    widths, tokens = [0], [0]
    for i, part in enumerate(parts):
        if i % 2:
            widths.append(len(part))
            tokens.append(1)
        elif part:
            pieces = bpe.pieces(part)
            widths += map(len, pieces)
            tokens += [len(x) >> 2 for x in bpe.ids(pieces)]
    return np.cumsum(widths), np.cumsum(tokens)


def chunks_of(text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Pieces of `chunk` code points, each sharing its last `overlap` ones with the next."""
    step = chunk - overlap
    return [text[at : at + chunk] for at in range(0, max(1, len(text) - overlap), step)]


_ENCODED = "row long, first long, last long, final boolean, n long, head_at array<int>, head_n array<long>, tail_at array<int>, tail_n array<long>"
_SCHEMA = pa.schema(
    [("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("final", pa.bool_()), ("n", pa.int64()), ("head_at", pa.list_(pa.int32())), ("head_n", pa.list_(pa.int64())), ("tail_at", pa.list_(pa.int32())), ("tail_n", pa.list_(pa.int64()))]
)


def _encoded(spans: DataFrame, path: str | None, overlap: int) -> DataFrame:
    """Of each span (row, first and last chunk, final, text): its tokens, and its boundaries inside the overlaps with the spans
    before and after it, as places from the overlap's start."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in common.slices(batches, 16):
            rows = []
            for row, first, last, final, text in zip(*(batch.column(c).to_pylist() for c in ("row", "first", "last", "final", "text")), strict=True):
                at, n = boundaries(text, bpe)
                bpe.trim()
                head, shared = at <= overlap, len(text) - overlap
                tail = (at >= shared) & (at <= len(text) - margin(bpe)) & (not final)
                rows.append((row, first, last, final, n[-1], at[head], n[head], at[tail] - shared, n[tail]))
            yield common.record(_SCHEMA, list(zip(*rows, strict=True)) or [[]] * len(_SCHEMA))

    return spans.select("row", "first", "last", "final", "text").mapInArrow(encode, _ENCODED)


def _junctions(encoded: DataFrame) -> DataFrame:
    """row, first, n: where the span that begins with chunk `first` meets the one before it, the tokens that the latter holds up to their
    splice less those that the former holds up to there; NULL if they have no boundary in common."""
    before = encoded.where("not final").select(F.col("row").alias("_row"), (F.col("last") + 1).alias("_first"), "tail_at", "tail_n")
    met = encoded.where("first > 0").select("row", "first", "head_at", "head_n").join(before, (F.col("row") == F.col("_row")) & (F.col("first") == F.col("_first")))
    at = F.array_min(F.array_intersect("tail_at", "head_at"))
    here = lambda side: F.element_at(f"{side}_n", F.array_position(f"{side}_at", F.col("at")).cast("int"))
    met = met.withColumn("at", at)
    return met.select("row", "first", F.when(F.col("at").isNotNull(), here("tail") - here("head")).alias("n"))


def _widened(encoded: DataFrame, junctions: DataFrame, pieces: DataFrame, path: str | None, chunk: int, overlap: int) -> DataFrame:
    """The spans again, those that did not meet encoded as one."""
    apart = junctions.where("n is null").select(F.col("row").alias("_row"), F.col("first").alias("_first"))
    marked = encoded.join(apart, (F.col("row") == F.col("_row")) & (F.col("first") == F.col("_first")), "left")
    order = Window.partitionBy("row").orderBy("first")  # a few numbers for each span of a text
    marked = marked.withColumn("of", F.sum(F.col("_row").isNull().cast("int")).over(order)).withColumn("spans", F.count("*").over(Window.partitionBy("row", "of")))
    wide = marked.where("spans > 1").groupBy("row", "of").agg(F.min("first").alias("low"), F.max("last").alias("high")).drop("of")
    parts = pieces.join(wide.select("row", "low", "high", F.explode(F.sequence("low", "high")).alias("first")), ["row", "first"])
    text = F.when(F.col("first") < F.col("high"), F.substring("text", 1, chunk - overlap)).otherwise(F.col("text"))
    whole = parts.groupBy("row", F.col("low").alias("first"), F.col("high").alias("last")).agg(F.array_sort(F.collect_list(F.struct("first", text.alias("text")))).alias("all"), F.max("final").alias("final"))
    joined = whole.select("row", "first", "last", "final", F.concat_ws("", F.col("all.text")).alias("text"))
    return marked.where("spans = 1").select(encoded.columns).union(_encoded(joined, path, overlap))


def token_counts(docs: DataFrame, path: str | None = None, chunk: int = CHUNK, overlap: int = OVERLAP, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of each document's whole text."""
    if not margin(byte_bpe(path)) < overlap <= chunk // 2:
        raise ValueError("an overlap is longer than a special string, and half a chunk at most")
    plain = common.plain(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in common.slices(batches):
            yield common.record(counted, [batch.column("doc_id"), batch.column("n_bytes"), [len(bpe.encode(t)) >> 2 for t in batch.column("text").to_pylist()]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("row", pa.int64()), ("first", pa.int64()), ("last", pa.int64()), ("final", pa.bool_()), ("text", pa.string())])
        for batch in common.slices(batches, 1):
            doc_id, n_bytes, row, text = (batch.column(c)[0].as_py() for c in ("doc_id", "n_bytes", "row", "text"))
            parts = chunks_of(text, chunk, overlap)
            for at in range(0, len(parts), 64):
                some = range(at, min(at + 64, len(parts)))
                yield common.record(out, [[doc_id] * len(some), [n_bytes] * len(some), [row] * len(some), some, some, [k == len(parts) - 1 for k in some], parts[at : at + 64]])

    sized = plain.withColumn("n_bytes", F.octet_length("text").cast("long"))
    short = sized.where(F.length("text") <= chunk).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    long_ = sized.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    pieces = common.written(long_.mapInArrow(cut, "doc_id long, n_bytes long, row long, first long, last long, final boolean, text string"), "chunks")
    encoded = common.written(_encoded(pieces, path, overlap), "encoded-chunks")
    junctions = common.written(_junctions(encoded), "junctions")
    while junctions.where("n is null").limit(1).count():
        encoded = common.written(_widened(encoded, junctions, pieces, path, chunk, overlap), "encoded-chunks")
        junctions = common.written(_junctions(encoded), "junctions")
    sums = junctions.select("row", "n").union(encoded.where("final").select("row", "n")).groupBy("row").agg(F.sum("n").alias("n_tokens"))
    whole = pieces.where("first = 0").select("row", "doc_id", "n_bytes").join(sums, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.union(whole).withColumn("over_limit", F.col("n_tokens") > limit)


def op11_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document. Null and empty texts have none; rows of one doc_id are counted each."""
    return token_counts(common.table(spark, sf_dir, "documents"))
