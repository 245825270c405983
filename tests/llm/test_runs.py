"""Periodic runs against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import pytest

from tidemark.llm import runs as R
from tidemark.llm.registry import queries


def brute(w, least=6, times=4):
    """Every period, every stretch; the smallest period of a stretch names it."""
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            s, size = i, j + q - i
            if size >= max(least, times * q) and not any(a <= s and s + size <= a + b and p < q for (a, p), b in out.items() if q % p == 0 and a == s and b == size):
                out[s, q] = size
            i = j + 1
    return [(s, out[s, q], q) for s, q in sorted(out)]


def sequences():
    rng = random.Random(5)
    yield []
    for n in range(1, 9):
        yield [0] * n
    for k in (1, 2, 3, 5):
        for _ in range(150):
            yield [rng.randrange(k) for _ in range(rng.randrange(1, 60))]
    for _ in range(200):
        w = []
        while len(w) < 150:
            unit = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            w += (unit * rng.randrange(1, 9))[: rng.randrange(1, 60)]
            if rng.random() < 0.3:
                w += w[-20:]
        yield w
    a, b = [0], [0, 1]
    for _ in range(10):
        a, b = b, b + a
    yield b  # Fibonacci
    t = [0]
    for _ in range(8):
        t += [1 - x for x in t]
    yield t  # Thue-Morse, where hashes of this kind meet
    yield t * 5
    yield (t * 5)[::-1] + [2] + t * 6


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (3, 3)])
def test_runs_equal_brute_force(least, times):
    for w in sequences():
        assert R.runs(w, least, times) == brute(w, least, times), w


def test_extensions_with_blind_hashes(monkeypatch):
    """Where every hash is equal, the words decide."""
    monkeypatch.setattr(R.Extensions, "_same", lambda self, i, j, k: True)
    for w in list(sequences())[::7]:
        assert R.runs(w) == brute(w)


def test_long_repetitions_take_linear_work():
    for unit in ([0], [0, 1, 0], list(range(500))):
        w = (unit * 100_000)[:100_000]
        assert R.runs(w) == [(0, 100_000, len(unit))]


def expected(i, text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        a = h // 10 % len(w)
        p = 1 + (len(w) - a) // (3 + h // 10 % 8)
        w = [x if k < a else w[a + (k - a) % p] for k, x in enumerate(w)]
    found = brute([{x: k for k, x in enumerate(sorted(set(w)))}[x] for x in w]) if w else []
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None,) * 3)
    gone = {k for s, size, q in found for k in range(s + q, s + size)}
    text = " ".join(x for k, x in enumerate(w) if k not in gone)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return i, len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{size},{q}\n" for s, size, q in found)), sha(text)


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(8)
    rows = [(None, "a " * 9, "en"), (1, None, "en"), (2, "", None), (2, "", None), (3, " \t\n\x0b\x0c\r", "x"), (4, "ä b ä b\nä b\tä b ä b ä b", "x"), (10**15, "x y " * 3000, "en")]
    for i in range(5, 160):
        rows.append((i, " ".join(" ".join([*(rng.choice("abcde") for _ in range(rng.randrange(1, 5)))] * rng.randrange(1, 7)) for _ in range(rng.randrange(1, 12))), "en"))
    d = spark.createDataFrame([(*r, 1, "2") for r in rows], "doc_id long, text string, lang string, n_runs long, start string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = queries()["op13_periodic_runs"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted((expected(i, x) for i, x, _ in rows), key=str)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 5
    assert R.report(d.limit(0)).count() == 0


def test_collapsed_keeps_other_texts_and_columns(spark):
    d = spark.createDataFrame([(1, "so  so so so so so it is", "a"), (2, "left  as it is", "b"), (3, None, "c")], "doc_id long, text string, start string")
    assert [tuple(r) for r in R.collapsed(d).orderBy("doc_id").collect()] == [(1, "so it is", "a"), (2, "left  as it is", "b"), (3, None, "c")]
