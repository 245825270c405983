"""Stems by the publication's own examples, and lexicon counts by plain loops."""

from __future__ import annotations

import random
import re

import pytest

from tidemark.functions import stems
from tidemark.functions import text as t
from tidemark.plans import filings

#: Examples that the publication gives with its rules.
GIVEN = """caresses caress, ponies poni, ties ti, caress caress, cats cat, feed feed, agreed agre, plastered plaster, bled bled, motoring motor, sing sing, conflated conflat, troubled troubl, sized size, hopping hop,
tanned tan, falling fall, hissing hiss, fizzed fizz, failing fail, filing file, happy happi, sky sky, relational relat, conditional condit, rational ration, valenci valenc, hesitanci hesit, digitizer digit, conformabli conform,
radicalli radic, differentli differ, vileli vile, analogousli analog, vietnamization vietnam, predication predic, operator oper, feudalism feudal, decisiveness decis, hopefulness hope, callousness callous, formaliti formal,
sensitiviti sensit, sensibiliti sensibl, triplicate triplic, formative form, formalize formal, electriciti electr, electrical electr, hopeful hope, goodness good, revival reviv, allowance allow, inference infer, airliner airlin,
gyroscopic gyroscop, adjustable adjust, defensible defens, irritant irrit, replacement replac, adjustment adjust, dependent depend, adoption adopt, homologou homolog, communism commun, activate activ, angulariti angular,
homologous homolog, effective effect, bowdlerize bowdler, probate probat, rate rate, cease ceas, controll control, roll roll, is is, by by, été été"""


@pytest.mark.parametrize(("word", "want"), [x.split() for x in GIVEN.replace("\n", " ").split(", ")])
def test_published_examples(word, want):
    assert stems.stem(word) == want


def test_counts_equal_a_loop(spark, tmp_path):
    rng = random.Random(1)
    words = ["gains", "gained", "Gaining", "loss", "losses", "LOSING", "lost", "neutral", "été", "the"]
    rows = [(i, rng.choice([None, "", " ".join(rng.choice(words) + rng.choice(["", ",", "."]) for _ in range(rng.randrange(1, 40)))])) for i in range(60)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = [("gain", 1), ("loss", -1), ("losing", -1)]
    own = {}
    for w, p in lexicon:
        own[stems.stem(w)] = max(p, own.get(stems.stem(w), -9))
    for plain in (False, True):
        by = dict(lexicon) if plain else own
        want = {}
        for i, x in rows:
            found = re.findall(r"[^\W\d_]+", (x or "").lower())
            hits = [by.get(w if plain else stems.stem(w)) for w in found]
            want[i] = (len(found), sum(h == 1 for h in hits), sum(h == -1 for h in hits))
        got = t.lexicon_counts(d, "doc_id", "text", spark.createDataFrame(lexicon, "word string, polarity int"), stems=not plain)
        assert {r.doc_id: (r.n_words, r.pos, r.neg) for r in got.collect()} == want
        assert plain or sum(p for _, p, _ in want.values()) > 50


def test_query_reads_whole_documents(spark, tmp_path):
    rng = random.Random(2)
    listed = {stems.stem(w): p for w, p in filings.LEXICON}
    rows = [(i, " ".join(rng.choice(["the", "thes", "une", "unes", "not", "noted", "of", "other"]) for _ in range(rng.randrange(0, 300)))) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = {i: (len(x.split()), *(sum(listed.get(stems.stem(w)) == p for w in x.split()) for p in (1, -1))) for i, x in rows}
    assert {r.doc_id: (r.n_words, r.pos, r.neg) for r in filings.stemmed_counts(spark, str(tmp_path)).collect()} == want
