"""Token ids in Re-Pair compressed shards.

Documents are dealt out by ranges of doc_id, rows of one doc_id by the order they are read in, and sorted; each task tokenizes its texts and closes a shard whenever it has
`shard_tokens` ids (a document is never split). A shard replaces frequent id pairs by nonterminals, round after round,
and keeps the rules, the expansion length of every rule, the remaining symbols in the fewest whole bytes, and the ids and
lengths of its documents. A range of ids is decoded from the expansion lengths without expanding what stands before it.

The file format is a Parquet dataset, one row a shard: Spark writes and commits it, so a task that is lost and run again
leaves no half file. Repeated and null doc_ids are separate documents (nulls first, equal ids as read), and however many
there are of one doc_id, they are spread over the tasks; a null or empty text is its end id only; other columns are not
stored; an empty table gives an empty store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import KEPT, byte_bpe

#: Ids below this are tokens, the others rules.
FIRST_RULE = 1 << 17
SHARD_TOKENS = 1 << 20
#: A pair that occurs less often in a shard earns no rule.
LEAST = 6

SHARDS = pa.schema(
    [("part", pa.int32()), ("shard", pa.int32()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("doc_tokens", pa.list_(pa.int64())),
     ("rules", pa.binary()), ("rule_lengths", pa.binary()), ("symbols", pa.binary()), ("n_symbols", pa.int64()), ("width", pa.int32())]
)
SHARDS_DDL = "part int, shard int, n_tokens long, doc_ids array<long>, doc_tokens array<long>, rules binary, rule_lengths binary, symbols binary, n_symbols long, width int"


#: Buckets that count pairs at most, a power of two, and the rank of a pair that is not replaced.
BUCKETS, NEVER = 1 << 18, np.iinfo(np.int32).max


def frequent_pairs(a: np.ndarray, b: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the pairs of a and b that occur `floor` times, their ranks there, the pairs by rank, most frequent first).

    Hashed buckets sort out most rare pairs. Of what is left each bucket counts one pair exactly; the pairs that share its
    bucket go on to the next turn, which hashes otherwise.
    """
    at, turn, known = np.arange(len(a)), 0, 0
    where, number, pairs, sizes = [at[:0]], [at[:0]], [np.zeros(0, np.uint64)], [at[:0]]
    while len(a) >= floor:
        buckets = max(256, min(BUCKETS, 1 << len(a).bit_length()))
        h = a * np.uint32(2654435761 + 2 * turn)
        h ^= b * np.uint32(2246822519 - 2 * turn)
        h >>= np.uint32(33 - buckets.bit_length())
        bucket = h.astype(np.intp)
        enough = np.bincount(bucket, minlength=buckets) >= floor
        some = np.flatnonzero(enough[bucket])
        if not len(some):
            break
        a, b, at, bucket = a[some], b[some], at[some], bucket[some]
        pair = a.astype(np.uint64) << np.uint64(32) | b
        owner = np.empty(buckets, np.uint64)
        owner[bucket] = pair
        mine = owner[bucket] == pair
        own = bucket[mine]
        counts = np.bincount(own, minlength=buckets)
        good = np.flatnonzero(counts >= floor)
        numbers = np.full(buckets, -1, np.intp)
        numbers[good] = np.arange(known, known + len(good))
        found = numbers[own]
        where.append(at[mine][found >= 0])
        number.append(found[found >= 0])
        pairs.append(owner[good])
        sizes.append(counts[good])
        rest = ~mine
        a, b, at, turn, known = a[rest], b[rest], at[rest], turn + 1, known + len(good)
    every, size = np.concatenate(pairs), np.concatenate(sizes)
    order = np.lexsort((every, -size))
    rank = np.empty(known, np.int32)
    rank[order] = np.arange(known, dtype=np.int32)
    return np.concatenate(where), rank[np.concatenate(number)], every[order]


def compress(ids: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, rules, rule lengths) of a shard.

    Every round takes the pairs over a falling frequency, all at once: where two of them overlap the more frequent one
    (then the left one) is replaced. Rounds at the lowest frequency go on until no pair occurs `least` times; they
    only count the pairs that were frequent before or have a new symbol, as no others can be.
    """
    seq = ids.astype(np.uint32)
    rules: list[np.ndarray] = []
    n_rules, floor = 0, max(least, len(seq) // 256)
    at = None  # the places to count, if not all
    while len(seq) >= 2:
        a, b = (seq[:-1], seq[1:]) if at is None else (seq[at], seq[at + 1])
        where, rank, pairs = frequent_pairs(a, b, floor)
        if len(pairs):
            ranks = np.full(len(seq) + 1, NEVER, np.int32)  # of the pair that begins at each place, behind an edge
            ranks[(where if at is None else at[where]) + 1] = rank
            wanted = np.flatnonzero(ranks < NEVER)
            here, left, right = ranks[wanted], ranks[wanted - 1], ranks[np.minimum(wanted + 1, len(seq))]
            take = (here < left) & (here <= right)
            run = np.flatnonzero(here == left)  # x x x: every other pair of a run
            if len(run):
                heads = np.flatnonzero(here != left)
                first = heads[np.searchsorted(heads, run, side="right") - 1]
                take[run] = ((run - first) % 2 == 0) & take[first] & (here[run] <= right[run])
                take[1:] &= ~(take[:-1] & (wanted[1:] == wanted[:-1] + 1))
            pos, taken = wanted[take] - 1, here[take]
            met = np.zeros(len(pairs), bool)
            met[taken] = True
            used, name = np.flatnonzero(met), (np.cumsum(met) - 1)[taken]
            rules.append(np.stack([pairs[used] >> np.uint64(32), pairs[used] & np.uint64(0xFFFFFFFF)], axis=1).astype(np.uint32))
            seq[pos] = (FIRST_RULE + n_rules + name).astype(np.uint32)
            keep = np.ones(len(seq), bool)
            keep[pos + 1] = False
            seq = seq[keep]
            if floor == least:
                new = seq >= FIRST_RULE + n_rules
                at = np.flatnonzero(new[:-1] | new[1:] | (ranks[1:] < NEVER)[keep][:-1])
            n_rules += len(used)
        elif floor == least:
            break
        floor = max(least, floor // 8)
    table = np.concatenate(rules) if rules else np.zeros((0, 2), np.uint32)
    return seq, table, rule_lengths(table)


def rule_lengths(rules: np.ndarray) -> np.ndarray:
    """Ids that each rule expands to; a rule only uses rules before it."""
    lengths = np.zeros(len(rules), np.int64)
    todo = np.arange(len(rules))
    while len(todo):
        a, b = rules[todo, 0].astype(np.int64) - FIRST_RULE, rules[todo, 1].astype(np.int64) - FIRST_RULE
        la, lb = np.where(a < 0, 1, lengths[np.maximum(a, 0)]), np.where(b < 0, 1, lengths[np.maximum(b, 0)])
        ready = (la > 0) & (lb > 0)
        lengths[todo[ready]] = (la + lb)[ready]
        todo = todo[~ready]
    return lengths


def pack(values: np.ndarray, width: int) -> bytes:
    """Little-endian, `width` bytes each."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpack(data: bytes, width: int, start: int, stop: int) -> np.ndarray:
    """Values start to stop, from the bytes that hold them."""
    out = np.zeros((stop - start, 4), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, count=(stop - start) * width, offset=start * width).reshape(-1, width)
    return out.view("<u4").ravel()


class Shard:
    """A stored shard (a row of the dataset), decoded as a whole or by ranges of ids."""

    def __init__(self, row: dict):
        self.n_tokens, self.doc_ids, self.doc_tokens = row["n_tokens"], row["doc_ids"], row["doc_tokens"]
        self._rules = np.frombuffer(row["rules"], np.uint32).reshape(-1, 2)
        self._lengths = np.frombuffer(row["rule_lengths"], np.uint32).astype(np.int64)
        self._data, self._n, self._width = row["symbols"], row["n_symbols"], row["width"]
        self._ends: np.ndarray | None = None

    def _symbols(self, start: int, stop: int) -> np.ndarray:
        return unpack(self._data, self._width, start, stop)

    def _sizes(self, symbols: np.ndarray) -> np.ndarray:
        rule = symbols.astype(np.int64) - FIRST_RULE
        return np.where(rule < 0, 1, self._lengths[np.maximum(rule, 0)] if len(self._lengths) else 1)

    def _unfold(self, symbols: np.ndarray) -> np.ndarray:
        """Rule by rule, until no rule is left."""
        while True:
            is_rule = symbols >= FIRST_RULE
            if not is_rule.any():
                return symbols
            size = np.where(is_rule, 2, 1)
            end = np.cumsum(size)
            out = np.empty(end[-1], np.uint32)
            out[end[~is_rule] - 1] = symbols[~is_rule]
            pair = self._rules[symbols[is_rule] - FIRST_RULE]
            out[end[is_rule] - 2], out[end[is_rule] - 1] = pair[:, 0], pair[:, 1]
            symbols = out

    def decode(self) -> np.ndarray:
        """All ids: each rule is unfolded once, then every symbol copies its part."""
        symbols = self._symbols(0, self._n)
        rules = self._unfold(np.arange(FIRST_RULE, FIRST_RULE + len(self._rules), dtype=np.uint32))
        parts = np.concatenate([np.arange(FIRST_RULE, dtype=np.uint32), rules])
        starts = np.concatenate([np.arange(FIRST_RULE), FIRST_RULE + np.cumsum(self._lengths) - self._lengths])
        size = self._sizes(symbols)
        at = np.repeat(starts[symbols] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        return parts[at]

    def decode_range(self, start: int, length: int) -> np.ndarray:
        """Ids start to start + length of the shard; only the symbols that cover them are expanded."""
        if self._ends is None:
            self._ends = np.cumsum(self._sizes(self._symbols(0, self._n)))
        start, stop = max(0, start), min(self.n_tokens, start + length)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = np.searchsorted(self._ends, start, side="right"), np.searchsorted(self._ends, stop, side="left")
        before = self._ends[first - 1] if first else 0
        return self._unfold(self._symbols(int(first), int(last) + 1))[start - before : stop - before]

    def decode_document(self, k: int) -> np.ndarray:
        return self.decode_range(int(sum(self.doc_tokens[:k])), self.doc_tokens[k])


def _shard_row(part: int, shard: int, doc_ids: list, lengths: list, ids: np.ndarray) -> pa.RecordBatch:
    symbols, rules, sizes = compress(ids)
    width = max(1, (int(symbols.max()).bit_length() + 7) // 8) if len(symbols) else 1
    row = [part, shard, len(ids), doc_ids, lengths, rules.astype(np.uint32).tobytes(), sizes.astype(np.uint32).tobytes(), pack(symbols, width), len(symbols), width]
    return common.record(SHARDS, [[x] for x in row])


def encode_shards(docs: DataFrame, end_id: int = 2, shard_tokens: int = SHARD_TOKENS, tokenizer_path: str | None = None) -> DataFrame:
    """The shards of documents(doc_id, text) in ascending order of doc_id, still to be written."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, part, shard = byte_bpe(tokenizer_path, 2 * KEPT), TaskContext.get().partitionId(), 0
        end = end_id.to_bytes(4, "little")
        held, ids, lengths, size = [], [], [], 0
        for batch in common.slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                held.append(bpe.encode(text) + end)
                ids.append(doc_id)
                lengths.append(len(held[-1]) // 4)
                size += lengths[-1]
                if size >= shard_tokens:
                    yield _shard_row(part, shard, ids, lengths, np.frombuffer(b"".join(held), np.uint32))
                    held, ids, lengths, size, shard = [], [], [], 0, shard + 1
        if ids:
            yield _shard_row(part, shard, ids, lengths, np.frombuffer(b"".join(held), np.uint32))

    rows = common.plain(docs).withColumn("row", F.monotonically_increasing_id()).repartitionByRange("doc_id", "row")
    return rows.sortWithinPartitions("doc_id", "row").select("doc_id", "text").mapInArrow(shards, SHARDS_DDL)


def write_store(docs: DataFrame, path: str, **how) -> DataFrame:
    """Writes the shards to path and returns them as read back."""
    encode_shards(docs, **how).write.parquet(path)
    return read_store(docs.sparkSession, path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SHARDS_DDL).parquet(path)


def shard_starts(store: DataFrame) -> DataFrame:
    """(part, shard, base): ids before each shard. Sums within a part, then over the parts, of which there are as many as tasks wrote."""
    sizes = store.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_part_base"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", "shard", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("_base"))
    return sizes.join(parts, "part").select("part", "shard", (F.col("_part_base") + F.col("_base")).alias("base"))


def document_digests(store: DataFrame) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32, all from the decoded shards."""
    out = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("doc_id", pa.int64()), ("_at", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            row = {name: batch.column(name)[0].as_py() for name in batch.schema.names}
            ids = memoryview(Shard(row).decode().astype("<u4").tobytes())
            ends = np.cumsum(row["doc_tokens"])
            starts = ends - row["doc_tokens"]
            crc = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            k = len(ends)
            yield common.record(out, [[row["part"]] * k, [row["shard"]] * k, row["doc_ids"], starts, row["doc_tokens"], crc])

    found = store.mapInArrow(digests, "part int, shard int, doc_id long, _at long, n_tokens long, ids_crc32 long")
    return found.join(shard_starts(store), ["part", "shard"]).select("doc_id", (F.col("base") + F.col("_at")).alias("start"), "n_tokens", "ids_crc32")


def op1_repair_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, length and checksum of every document's ids, read back from Re-Pair shards. Null and empty texts are their end id; equal and null doc_ids are documents of their own."""
    docs = common.table(spark, sf_dir, "documents")
    store = common.written(encode_shards(docs), "token-shards")
    return document_digests(store)
