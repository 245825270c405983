"""Chunks by a vocabulary's tokens against the published loop."""

from __future__ import annotations

import hashlib
import random

import pytest

from tidemark.functions import vocabulary
from tidemark.plans import filings

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.tiktoken")


def loop(text, size, overlap):
    own = vocabulary.encoding(PATH)
    tokens = own.encode_ordinary(text)
    if len(tokens) <= size:
        return [text]
    out, start = [], 0
    while start < len(tokens):
        end = min(start + size, len(tokens))
        piece = own.decode(tokens[start:end])
        if end < len(tokens):
            last = piece.rfind(". ", int(len(piece) * 0.8))
            if last > 0:
                piece = piece[: last + 1]
                end = start + len(own.encode_ordinary(piece))
        out.append(piece.strip())
        start = end - overlap
        if start >= len(tokens) - overlap:
            break
    return out


def test_chunks_equal_the_loop():
    rng = random.Random(1)
    for n in (0, 3, 30, 400, 2000):
        text = " ".join(rng.choice(["Revenue", "fell", "sharply.", "naïve", "2010", "😀", "a"]) for _ in range(n)) + rng.choice(["", " \n"])
        for size, overlap in ((50, 5), (400, 40)):
            got = vocabulary.chunks(text, PATH, size, overlap)
            assert got == loop(text, size, overlap) and (n < 3 or got)
    assert vocabulary.chunks(" as it is ", PATH, 50, 5) == [" as it is "]
    assert len(vocabulary.chunks("word " * 300, PATH, 10, 20)) > 10  # an overlap of more than a piece still moves on


def test_query(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, rng.choice([None, "", "Words. " * rng.randrange(1, 900)])) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((r.doc_id, r.pos, r.n, r.h) for r in filings.vocabulary_chunks(spark, str(tmp_path)).collect())
    assert got == sorted((i, k, len(c), hashlib.md5(c.encode()).hexdigest()) for i, x in rows for k, c in enumerate(loop(x or "", 400, 40)))
