"""Line dedup by patience alignment with earlier documents.

Documents that overlap are found by the hashes of what they share: lines of LINE_WORDS words or more, and windows, which are
stretches of lines that hold `min_words` words and would hold fewer without their last or without their first line. A rare unit,
of RARE holders at most, makes a partner of every earlier holder; any other one makes a partner of the document of smallest
doc_id that holds it, so that a unit which very many documents hold makes one tie for each of them, not all pairs. Partners
whose ties hold `min_words` words are aligned, each pair of documents on its own.

A pair is aligned by patience diff: lines equal at both ends of a stretch, then the lines that stand once in either document, of
which the longest growing chain are anchors, then the same again between neighbouring anchors. Aligned lines that stand together
in both documents go from `min_words` words on. Neighbours in the alignment with no more than GAP other lines between them in
either document form an edited block: what was one passage, with lines changed, put in or left out; its aligned lines go if
they hold `edited_words` words, and the lines between them stay. Lines in another order do not align, and stay. Moved and
repeated blocks are found by aligning what is left: the windows that the pair shares outside the blocks found so far are dealt
into growing chains, each an alignment of its own. So every run of `min_words` words in one piece in both goes, as windows find
its first holder whoever holds its lines first; edited blocks are found in the holders of rare lines and in first holders.

Units are compared by 128 bits of hash over hashes of their lines, lines of a pair by 64; only lines with a word count, and
blank lines inside a run go with it. A null text stays null and an empty one empty; a document whose lines all go is left with
an empty text. Rows with a null doc_id are left alone. Rows that repeat a doc_id are not compared with each other. All other
columns pass unchanged, but n_chars follows the text. An empty table gives an empty one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words that a run of lines in one piece in both documents must hold to be deleted.
MIN_WORDS = 20
#: Words that the aligned lines of an edited block must hold, other lines between two of them at most, and words of a line that ties or anchors.
EDITED_WORDS, GAP, LINE_WORDS = 50, 1, 4
#: Documents that hold a rare unit at most.
RARE = 4


def solid_lines(text: str) -> tuple[list[int], list[int], list[bytes]]:
    """Of the lines with words: their indices, numbers of words and hashes."""
    solid, words, hashes = [], [], []
    for i, line in enumerate(text.encode().split(b"\n")):
        n = len(line.split())
        if n:
            solid.append(i)
            words.append(n)
            hashes.append(xxhash.xxh3_128_digest(line))
    return solid, words, hashes


def windows(words: list[int], min_words: int) -> list[tuple[int, int]]:
    """(start, stop) of the shortest stretch of min_words words from each line on, and of the shortest that ends with each."""
    found = set()
    least, stop, total = max(1, min_words), 0, 0
    for start, n in enumerate(words):
        while stop < len(words) and total < least:
            total += words[stop]
            stop += 1
        if total < least:
            break
        found.add((start, stop))
        total -= n
    start = total = 0
    for stop, n in enumerate(words, 1):
        total += n
        while total - words[start] >= least:
            total -= words[start]
            start += 1
        if total >= least:
            found.add((start, stop))
    return sorted(found)


def units(text: str, min_words: int) -> dict[bytes, int]:
    """The words of each unit of a text, by its hash."""
    _, words, hashes = solid_lines(text)
    found = {(i, i + 1) for i, n in enumerate(words) if n >= LINE_WORDS}.union(windows(words, min_words))
    return {xxhash.xxh3_128_digest(b"".join(hashes[a:b])): sum(words[a:b]) for a, b in found}


def partners(docs: DataFrame, min_words: int = MIN_WORDS, rare: int = RARE) -> DataFrame:
    """doc_id, row (hash of the text), first_doc, first_row: pairs of a document and an earlier one that share units worth an alignment."""
    out = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("h", pa.binary()), ("words", pa.int32())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = []
            for doc_id, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "text")), strict=True):
                rows += [(doc_id, row, h, min(n, 1 << 30)) for h, n in units(text, min_words).items()]
            yield common.record(out, list(zip(*rows, strict=True)) or [[]] * 4)

    held = common.written(_rows(docs).mapInArrow(cut, "doc_id long, row long, h binary, words int"), "units")
    shared = held.groupBy("h").agg(F.count("*").alias("holders"), F.min(F.struct("doc_id", "row")).alias("first"), F.max("doc_id").alias("last"))
    shared = common.written(shared.where("first.doc_id < last"), "shared-units")  # so that the join shuffles both sides anew and can split a very common unit
    tied = common.written(held.join(shared.select("h", "holders", "first"), "h"), "ties")
    to_first = tied.where((F.col("holders") > rare) & (F.col("doc_id") > F.col("first.doc_id"))).select("doc_id", "row", F.col("first.doc_id").alias("first_doc"), F.col("first.row").alias("first_row"), "words")
    few = tied.where(F.col("holders") <= rare).groupBy("h", "words").agg(F.collect_list(F.struct("doc_id", "row")).alias("all"))  # `rare` holders at most
    later = few.select("all", "words", F.explode("all").alias("one"))
    both = later.select("words", "one", F.explode("all").alias("first")).where("first.doc_id < one.doc_id")
    to_rare = both.select("one.doc_id", "one.row", F.col("first.doc_id").alias("first_doc"), F.col("first.row").alias("first_row"), "words")
    pairs = to_first.union(to_rare).groupBy("doc_id", "row", "first_doc", "first_row").agg(F.sum("words").alias("words"))
    return pairs.where(F.col("words") >= min_words).drop("words")


def _rows(docs: DataFrame) -> DataFrame:
    return common.plain(docs).withColumn("row", F.xxhash64("text")).where("doc_id is not null and text is not null")


def _longest_growing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs in order of their first value, the longest choice whose second values grow, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tops, y)
        back[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(y)
            piles.append(i)
        else:
            tops[k], piles[k] = y, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def growing_chains(pairs: list[tuple[int, int]]) -> list[list[tuple[int, int]]]:
    """Pairs in order of their first value, dealt into as few choices as can be whose second values grow."""
    chains: list[list[tuple[int, int]]] = []
    tops: list[int] = []  # falling: the last second value of each chain, negated so that they grow
    for x, y in pairs:
        k = bisect_left(tops, -y + 1)
        if k == len(chains):
            chains.append([])
            tops.append(0)
        chains[k].append((x, y))
        tops[k] = -y
    return chains


def patience(mine: list, other: list, solid: list[bool]) -> list[tuple[int, int]]:
    """(place in mine, place in other) of the lines that patience diff aligns, in order. solid: whether a line of mine can be an anchor."""
    aligned, open_ = [], [(0, len(mine), 0, len(other))]
    while open_:
        a, b, c, d = open_.pop()
        while a < b and c < d and mine[a] == other[c]:
            aligned.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and mine[b - 1] == other[d - 1]:
            b, d = b - 1, d - 1
            aligned.append((b, d))
        if a == b or c == d:
            continue
        here, there = _once(mine, a, b), _once(other, c, d)
        chain = _longest_growing([(i, there[x]) for x, i in here.items() if i >= 0 and solid[i] and there.get(x, -1) >= 0])
        if chain:
            edges = [(a - 1, c - 1), *chain, (b, d)]
            aligned += chain
            open_ += [(i + 1, k, j + 1, n) for (i, j), (k, n) in zip(edges, edges[1:], strict=False)]
    return sorted(aligned)


def _once(lines: list, start: int, stop: int) -> dict:
    """The place of each line in a stretch, -1 if it stands there more than once; in order of the places."""
    found: dict = {}
    for i in range(start, stop):
        found[lines[i]] = -1 if lines[i] in found else i
    return found


def common_blocks(mine: list, other: list, words: list[int], min_words: int = MIN_WORDS, edited_words: int = EDITED_WORDS) -> list[tuple[int, int]]:
    """(start, stop) of the blocks of mine that go, mine and other being lines with words, words their numbers in mine."""
    blocks = []
    aligned = patience(mine, other, [n >= LINE_WORDS for n in words])
    for gap, least in ((0, min_words), (GAP, edited_words)):
        for run in _runs(aligned, gap):
            if sum(words[i] for i, _ in run) >= least:
                blocks += [(i, i + 1) for i, _ in run]
    gone = {i for i, _ in blocks}
    known, places = set(other), {}
    left = [(i, k) for i, k in windows(words, min_words) if not gone.issuperset(range(i, k)) and known.issuperset(mine[i:k])]
    wanted = {tuple(mine[i:k]) for i, k in left}
    for size in sorted({k - i for i, k in left}):
        for j in range(len(other) - size + 1):
            if other[j] in known and (x := tuple(other[j : j + size])) in wanted:
                places.setdefault(x, j)
    stops: dict[tuple[int, int], int] = {}
    for i, k in left:
        if (j := places.get(tuple(mine[i:k]))) is not None:
            stops[i, j] = max(k, stops.get((i, j), 0))
    for chain in growing_chains(sorted(stops)):
        blocks += [(i, stops[i, j]) for i, j in chain]
    return blocks


def _runs(aligned: list[tuple[int, int]], gap: int) -> list[list[tuple[int, int]]]:
    """Neighbours in an alignment with no more than `gap` other lines between them in either document."""
    runs: list[list[tuple[int, int]]] = []
    for i, j in aligned:
        if runs and i - runs[-1][-1][0] - 1 <= gap and j - runs[-1][-1][1] - 1 <= gap:
            runs[-1].append((i, j))
        else:
            runs.append([(i, j)])
    return runs


def shared_blocks(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """_doc_id, _row (hash of the text), _blocks: for each document that shares blocks with earlier ones, their starts and stops among its lines
    with words."""
    pairs = common.written(partners(docs, min_words), "partners")
    held = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("lines", pa.list_(pa.int64())), ("words", pa.list_(pa.int32()))])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            found = [solid_lines(t) for t in batch.column("text").to_pylist()]
            lines = [[int.from_bytes(h[:8], "little", signed=True) for h in hashes] for _, _, hashes in found]
            yield common.record(held, [batch.column("doc_id"), batch.column("row"), lines, [words for _, words, _ in found]])

    lines = _rows(docs).mapInArrow(hashed, "doc_id long, row long, lines array<long>, words array<int>").dropDuplicates(["doc_id", "row"])
    lines = common.written(lines, "lines")
    both = pairs.join(lines, ["doc_id", "row"]).join(lines.select(F.col("doc_id").alias("first_doc"), F.col("row").alias("first_row"), F.col("lines").alias("others")), ["first_doc", "first_row"])
    span = pa.struct([("start", pa.int32()), ("stop", pa.int32())])
    out = pa.schema([("_doc_id", pa.int64()), ("_row", pa.int64()), ("blocks", pa.list_(span))])

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 16):
            rows = []
            for doc_id, row, mine, words, other in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "row", "lines", "words", "others")), strict=True):
                if blocks := common_blocks(mine, other, words, min_words):
                    rows.append((doc_id, row, [{"start": a, "stop": b} for a, b in joined(blocks)]))
            yield common.record(out, list(zip(*rows, strict=True)) or [[]] * 3)

    found = both.select("doc_id", "row", "lines", "words", "others").mapInArrow(align, "_doc_id long, _row long, blocks array<struct<start int, stop int>>")
    return found.groupBy("_doc_id", "_row").agg(F.flatten(F.collect_list("blocks")).alias("_blocks"))


def joined(blocks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same lines in as few blocks as can be."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(blocks):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def remove(text: str, blocks: list[dict]) -> tuple[str, list[tuple[int, int]]]:
    """(the text without the blocks it has in common with earlier documents, first and last line of each run of them)."""
    solid = solid_lines(text)[0]
    runs = [(solid[a], solid[b - 1]) for a, b in joined([(x["start"], x["stop"]) for x in blocks])]  # blank lines inside a run go with it
    gone = {i for first, last in runs for i in range(first, last + 1)}
    return "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone), runs


def deduplicated(docs: DataFrame, min_words: int = MIN_WORDS, keep_emptied: bool = True) -> DataFrame:
    """docs with the repeated runs deleted from text; without documents that lost all their words if keep_emptied is false."""
    schema, name = docs.schema, "_blocks"
    while name.lower() in {c.lower() for c in docs.columns}:
        name += "_"
    found = shared_blocks(docs, min_words).withColumnRenamed("_blocks", name)
    same = (docs["doc_id"].cast("long") == found["_doc_id"]) & (F.xxhash64(docs["text"].cast("string")) == found["_row"])
    tied = docs.join(found, same, "left").drop(found["_doc_id"], found["_row"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            out, emptied = _cut_batch(batch, name)
            done = out.drop_columns([name])
            yield done if keep_emptied else done.filter(pa.array([not x for x in emptied]))

    return tied.mapInArrow(cut, schema)


def _cut_batch(batch: pa.RecordBatch, name: str) -> tuple[pa.RecordBatch, list[bool]]:
    """The batch with its texts cut, and which of them lost all words; name: of the column of blocks."""
    texts, blocks = batch.column("text").to_pylist(), batch.column(name).to_pylist()
    emptied, sizes = [False] * len(texts), {}
    for i, (text, found) in enumerate(zip(texts, blocks, strict=True)):
        if text and found:
            new, _ = remove(text, found)
            texts[i], sizes[i], emptied[i] = new, len(new), not new.encode().split()
    batch = batch.set_column(batch.schema.get_field_index("text"), batch.schema.field("text"), pa.array(texts, batch.schema.field("text").type))
    at = batch.schema.get_field_index("n_chars")
    if at >= 0 and pa.types.is_integer(batch.schema.field(at).type) and sizes:
        counts = [sizes.get(i, n) for i, n in enumerate(batch.column(at).to_pylist())]
        batch = batch.set_column(at, batch.schema.field(at), pa.array(counts, batch.schema.field(at).type))
    return batch, emptied


def removals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text without the runs, n_lines before, n_removed, removed (first and last line of each run, from 0)."""
    docs = common.plain(docs)
    tied = docs.join(shared_blocks(docs, min_words), (F.col("doc_id") == F.col("_doc_id")) & (F.xxhash64("text") == F.col("_row")), "left").select("doc_id", "text", "_blocks")
    span = pa.struct([("first", pa.int32()), ("last", pa.int32())])
    out = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n_lines", pa.int32()), ("n_removed", pa.int32()), ("removed", pa.list_(span))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches):
            rows = []
            for doc_id, text, found in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "_blocks")), strict=True):
                new, runs = remove(text, found) if text and found else (text, [])
                n = text.count("\n") + 1 if text else 0
                rows.append((doc_id, new, n, sum(b - a + 1 for a, b in runs), [{"first": a, "last": b} for a, b in runs]))
            yield common.record(out, list(zip(*rows, strict=True)) or [[]] * 5)

    return tied.mapInArrow(cut, "doc_id long, text string, n_lines int, n_removed int, removed array<struct<first int, last int>>")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text without the blocks it has in common with earlier ones. Null texts and null doc_ids stay as they are; rows of one doc_id are not compared."""
    return removals(common.table(spark, sf_dir, "documents"))
