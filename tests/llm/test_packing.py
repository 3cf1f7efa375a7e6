"""Packing against the tokenizer itself and against the contract's laws."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from perron.llm import packing

PARTS = ["the", "It's", "l'été", "naïve", "ÀÉÎ", "İstanbul", "ﬁne", "é", "don't", "x.y", "(a)", "42", "3.14", "ß", "ẞ", "Ω", "你好", "😀", "<|endoftext|>", "<|", " ", " ", "ŉ", "ǅ", "àb", "…", "\x00", "\x1c", "''s", "'S", "--", "ª", "²", "µ", "ƻ", "ʰ"]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.default_vocabulary())


def random_texts(n: int) -> list[str]:
    rng = random.Random(4)
    letters = "abcdefghijABCDEéäñÖßŁ0123456789.,;:!?'\"-_<|> \t\n\x0b"
    word = lambda: rng.choice(PARTS) if rng.random() < 0.3 else "".join(rng.choices(letters, k=rng.randint(1, 12)))
    return [rng.choice((" ", "  ", "\n", "")).join(word() for _ in range(rng.randint(0, 30))) for _ in range(n)]


def test_ids_equal_the_tokenizers(tokenizer, monkeypatch):
    texts = random_texts(3000)
    want = [tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID] for t in texts]
    for cache in (packing.CACHE_WORDS, 700):
        monkeypatch.setattr(packing, "CACHE_WORDS", cache)
        own = packing.WordTokenizer(packing.default_vocabulary())
        for lo in range(0, len(texts), 500):
            ids, offsets = own.documents(pa.array(texts[lo : lo + 500]))
            assert [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])] == want[lo : lo + 500]


def test_whole_table(spark, tokenizer):
    """op6 over a whole given table: every piece's ids, and gapless sequences that are nearly full."""
    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = packing.op6_packing(spark, folder).collect()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"]) for r in rows) == sorted((i, k, s, min(4096, len(x) - s)) for i, x in ids.items() for k, s in enumerate(range(0, len(x), 4096)))
    assert all(zlib.crc32(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"] for r in rows)
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in sequences.values():
        ends = np.cumsum([n for _, n in sorted(s)])
        assert [o for o, _ in sorted(s)] == [0, *ends[:-1]] and ends[-1] <= 4096
    assert len(sequences) <= 1.1 * sum(map(len, ids.values())) / 4096 + 8


def test_odd_tables(spark):
    """Empty table, repeated and null ids, clashing extra columns."""
    rows = [(1, "a b"), (1, "a b"), (None, None), (2, ""), (3, "w " * 9000)]
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, piece int, sequence_id string")
    found = packing.pack(df).collect()
    assert sorted((r["doc_id"] or 0, r["piece"], r["length"]) for r in found) == [(0, 0, 1), (1, 0, 3), (1, 0, 3), (2, 0, 1), (3, 0, 4096), (3, 1, 4096), (3, 2, 809)]
    assert packing.pack(df.limit(0)).count() == 0
