"""Token counts of spliced chunks against the library's whole-text encoding."""

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from terrace.llm import token_counts
from terrace.llm.tokens import ByteBpe

SCHEMA = "doc_id long, text string, n_tokens int, first string"


def library_counts(rows, limit=512):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        n = len(t.encode(text or "", add_special_tokens=False).ids)
        out.append((doc_id, len((text or "").encode()), n, n > limit))
    return sorted(out, key=str)


def counts(spark, rows, **how):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in token_counts.token_counts(df, **how).collect()), key=str)


def odd_texts():
    rng = np.random.default_rng(11)
    letters = list("aab  \n\t'slldr1²½é日🙂!?<|>") + ["<|endoftext|>", "  \n ", "'ll", "word ", "<|endof", "text|>"]
    texts = ["".join(rng.choice(letters, rng.integers(0, 900))) for _ in range(40)]
    texts += ["a" * 700, " " * 700, "\n \t" * 200, "x" * 300 + " " * 300 + "y" * 300, "ab " * 300 + "z" * 500 + " cd" * 300, "!" * 33 + "<|endoftext|>" * 40, "'" * 500, "日本" * 300 + " ok", None, "", "a", " "]
    return texts


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 16), (64, 30), (200, 16), (1 << 16, 1 << 10)])
def test_spliced_counts_equal_the_library(spark, chunk, overlap):
    rows = [(i // 2 if i % 7 else None, t) for i, t in enumerate(odd_texts())]
    assert counts(spark, rows, chunk=chunk, overlap=overlap) == library_counts(rows)


def test_counts_of_huge_texts(spark):
    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) for _ in range(500)]
    prose = " ".join(rng.choice(words, 60_000))
    rows = [(1, prose), (2, "x" * 300_000), (3, prose[:100_000] + " " * 200_000 + prose[:90_000]), (3, prose[: 1 << 16]), (4, prose[: (1 << 16) + 1]), (5, "日本語 " * 50_000)]
    assert counts(spark, rows) == library_counts(rows)


def test_boundaries_stay_what_follows_a_chunk():
    """What makes a boundary proven: no text after a chunk moves a boundary before its margin, no text before it one after a common boundary."""
    bpe, rng = ByteBpe(), np.random.default_rng(2)
    pool = [t for t in odd_texts() if t]
    for _ in range(400):
        text = "".join(rng.choice(pool, 2))
        cut = int(rng.integers(0, len(text) + 1))
        at, n = token_counts.boundaries(text, bpe)
        whole = dict(zip(at.tolist(), n.tolist(), strict=True))
        front = dict(zip(*(x.tolist() for x in token_counts.boundaries(text[:cut], bpe)), strict=True))
        safe = cut - token_counts.margin(bpe)
        assert {k: v for k, v in front.items() if k <= safe} == {k: v for k, v in whole.items() if k <= safe}
        back = {cut + k: v for k, v in zip(*(x.tolist() for x in token_counts.boundaries(text[cut:], bpe)), strict=True)}
        common = sorted(back.keys() & whole.keys())
        for k in common[1:]:
            assert back[k] - back[common[0]] == whole[k] - whole[common[0]]
        assert {k for k in back if k >= common[0]} == {k for k in whole if k >= common[0]}


def test_counts_query(spark, sf_dir):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = token_counts.op11_token_counts(spark, sf_dir)
    assert got.columns[:4] == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == library_counts(rows)


def test_counts_of_no_rows_and_bad_overlaps(spark):
    assert counts(spark, []) == []
    with pytest.raises(ValueError, match="overlap"):
        counts(spark, [], chunk=100, overlap=60)
    with pytest.raises(ValueError, match="overlap"):
        counts(spark, [], chunk=100, overlap=15)
