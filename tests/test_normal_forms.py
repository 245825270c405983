"""NFKC behind a quick check, against Python's own on all code points and on mixed sequences."""

from __future__ import annotations

import random
import sys
import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import grounding

POINTS = [c for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c < 0xE000]


def test_a_text_that_passes_the_check_is_composed():
    odd = {*t.uncomposed()}
    plain = [chr(c) for c in POINTS if chr(c) not in odd]
    assert 100_000 < len(plain) and sum(x in odd for x in "ﬁ e\u0301 \u212b ² 가") == 4  # a composed syllable stays
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choices(plain, k=300))
        assert unicodedata.normalize("NFKC", text) == text


def test_every_code_point_and_mixed_sequences(spark):
    rng = random.Random(2)
    odd = [chr(c) for c in POINTS if unicodedata.combining(chr(c)) or unicodedata.normalize("NFKC", chr(c)) != chr(c)]
    rows = [(k, "".join(f"a{chr(c)} " for c in POINTS[k : k + 64])) for k in range(0, len(POINTS), 64)]
    rows += [(-1 - k, "".join(rng.choice([rng.choice(odd), "e", "o", " ", "\u1100", "\u1161", "\u11a8", "\u0301", "\u2003"]) for _ in range(rng.randrange(1, 30)))) for k in range(800)]
    d = spark.createDataFrame([*rows, (-9999, None), (-9998, "")], "i long, x string")
    got = {r.i: (r.a, r.b) for r in d.select("i", t.nfkc(F.col("x")).alias("a"), t.normalise(F.col("x"), True).alias("b")).collect()}
    assert got[-9999] == (None, None) and got[-9998] == ("", "")
    assert all(got[i][0] == unicodedata.normalize("NFKC", x) for i, x in rows)
    # letters whose lower case depends on the library's Unicode version aside, the whole rule is the same
    bad = [i for i, x in rows if got[i][1] != t.normalised(x)]
    assert len(bad) <= 5, [(i, got[i][1], t.normalised(dict(rows)[i])) for i in bad[:3]]


def test_quotes_that_are_not_composed_are_found(spark):
    d = spark.createDataFrame([("the ﬁrst café", "In THE first cafe\u0301 we met."), ("absent", "In the first"), (None, "x"), ("x", None)], "quote string, doc string")
    assert [r.exact for r in grounding.exact(d).collect()] == [True, False, None, None]
    assert grounding.exact(d).columns == ["quote", "doc", "exact"]
