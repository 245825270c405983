"""Language identification: the fit, the temperature and the predictions against plain loops; every language is learnt."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from tidemark.llm import language_id as L
from tidemark.llm.textbuf import utf8

SCHEMA = "doc_id long, text string, lang string"


def plain_fit(rows, k, epochs, bits):
    """One weight after the other."""
    z, n = {}, {}
    bias = 1 << bits

    def weight(i, j):
        a, b = z.get((i, j), 0.0), n.get((i, j), 0.0)
        pen = 0.0 if i == bias else L.L1
        return 0.0 if abs(a) <= pen else (math.copysign(pen, a) - a) / ((L.BETA + math.sqrt(b)) / L.ALPHA + L.L2)

    for _ in range(epochs):
        for idx, x, y in rows:
            feats = [*zip(idx.tolist(), x.tolist(), strict=True), (bias, 1.0)]
            w = {(i, j): weight(i, j) for i, _ in feats for j in range(k)}
            s = [sum(v * w[i, j] for i, v in feats) for j in range(k)]
            p = [math.exp(a - max(s)) for a in s]
            p = [a / sum(p) - (j == y) for j, a in enumerate(p)]
            for i, v in feats:
                for j in range(k):
                    g, old = v * p[j], n.get((i, j), 0.0)
                    z[i, j] = z.get((i, j), 0.0) + g - (math.sqrt(old + g * g) - math.sqrt(old)) / L.ALPHA * w[i, j]
                    n[i, j] = old + g * g
    return [[weight(i, j) for j in range(k)] for i in range(bias + 1)]


def test_fit_equals_a_plain_loop(monkeypatch):
    monkeypatch.setattr(L, "L1", 0.7)
    rng = np.random.default_rng(1)
    rows = []
    for _ in range(60):
        idx = np.unique(rng.integers(0, 32, 8))
        y = int(idx.sum() % 3)
        rows.append((idx, rng.random(len(idx)) + (y == 1) * (idx % 3 == 0), y))
    w, bias = L.fit(rows, 3, epochs=4, bits=5)
    want = np.array(plain_fit(rows, 3, 4, 5))
    assert np.allclose(w, want[:-1], atol=1e-12) and np.allclose(bias, want[-1], atol=1e-12)
    assert (w == 0).any() and (w != 0).any()  # the penalty sets some to exactly 0


def test_temperature_is_the_best_of_its_grid():
    rng = np.random.default_rng(2)
    s, y = rng.normal(0, 5, (80, 4)), rng.integers(0, 4, 80)

    def loss(t):
        return -sum(row[k] / t - math.log(sum(math.exp(v / t) for v in row)) for row, k in zip(s, y, strict=True))

    grid = [float(t) for t in np.geomspace(0.1, 10, 81)]
    assert loss(L.temperature(s, y)) == pytest.approx(min(map(loss, grid)))
    assert L.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def plain_predict(model, text):
    """Position by position, over the text alone."""
    data, off = utf8(__import__("pyarrow").array([text]))
    by, _, letter = L.grams(data, off, 0, 1)
    if not letter.any():
        return "und", 0.0
    dense, total, s = model.dense(), 0, [0.0] * len(model.langs)
    for g in by:
        for f in g.tolist():
            total += 1
            for j in range(len(s)):
                s[j] += float(dense[j][f >> (L.BITS - model.bits)])
    s = [(a / max(total, 1) + b) / model.temp for a, b in zip(s, model.bias, strict=True)]
    p = [math.exp(a - max(s)) for a in s]
    return model.langs[p.index(max(p))], max(p) / sum(p)


def tongue(rng, k, n=30):
    """A language of its own: words over eight letters that other languages hardly share."""
    letters = [chr(0x4E00 + 8 * k + j) for j in range(8)]
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 7))) for _ in range(n))


@pytest.mark.parametrize("cells", [1 << 24, 1 << 14])
def test_predictions_equal_a_plain_loop(spark, monkeypatch, cells):
    monkeypatch.setattr(L, "CELLS", cells)
    rng = random.Random(3)
    rows = [(i, tongue(rng, i % 5), f"l{i % 5}") for i in range(200)] + [(900, "", "l0"), (901, None, "l1"), (902, "1 2", "l2"), (903, tongue(rng, 7), None)]
    d = spark.createDataFrame(rows, SCHEMA)
    model = L.train(d, sample=150)
    assert model.bits == (16 if cells == 1 << 24 else 11)
    for r in L.identified(d, model).collect():
        lang, score = plain_predict(model, r.text)
        assert r.lang_pred == lang and r.score == pytest.approx(score, abs=1e-6)
    got = {r.doc_id: r.lang_pred for r in L.identified(d, model).collect()}
    assert sum(got[i] == f"l{i % 5}" for i in range(200)) >= 198


@pytest.mark.parametrize("seed", [1, 40, 44, 45])
def test_a_language_under_one_id_is_learnt(spark, seed):
    rng = random.Random(seed)
    rows = [(i, tongue(rng, 0), "en") for i in range(1000, 1500)] + [(seed, tongue(rng, 1, 8), "xx") for _ in range(2000)]
    model = L.train(spark.createDataFrame(rows, SCHEMA), sample=200)
    assert model.langs == ["en", "xx"]


def test_a_language_of_one_repeated_text_is_learnt(spark):
    rng = random.Random(9)
    rows = [(i, tongue(rng, 0), "en") for i in range(500)] + [(i, "repeated words", "xx") for i in range(600, 3000)]
    d = spark.createDataFrame(rows, SCHEMA)
    model = L.train(d, sample=200)
    assert model.langs == ["en", "xx"]
    assert {r.lang_pred for r in L.identified(d.where("lang = 'xx'"), model).collect()} == {"xx"}


def test_very_many_languages_are_learnt_within_the_bound(spark, monkeypatch):
    monkeypatch.setattr(L, "CELLS", 1 << 21)
    monkeypatch.setattr(L, "MOST", 1000)
    rng = random.Random(6)
    rows = [(i, tongue(rng, i % 300, 12), f"l{i % 300:03}") for i in range(3000)]
    d = spark.createDataFrame(rows, SCHEMA)
    model = L.train(d, learnable=L.F.lit(True))
    assert len(model.langs) == 300 and (1 << model.bits) * 300 <= 1 << 21
    right = L.identified(d, model).where("lang = lang_pred").count()
    assert right >= 2850
    monkeypatch.setattr(L, "LANGS", 299)
    with pytest.raises(ValueError, match="299"):
        L.train(d, learnable=L.F.lit(True))
