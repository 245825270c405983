"""Quality rules: counts by brute force, the forest by a plain walk, verdicts by planted junk."""

from __future__ import annotations

import random
import re

import numpy as np

from tidemark.llm import quality as Q
from tidemark.llm.registry import queries

DOC = "doc_id long, text string, lang string, n_words string, kept int"


def plain(text):
    """The contract's counts, word by word."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines, dup = [], 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.append(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    again = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(again), n < 20 or 100 * len(again) > 30 * n


def texts():
    rng = random.Random(2)
    yield from [None, "", " \n\t\x0b\x0c\r ", "a", "é ü 😀 x y", "|\n|\n | \n|", "x\r\nx\r\nx\nx", "a b c d e f g h " * 3, "q " * 400, "w" * 200_000]
    for _ in range(150):
        words = [rng.choice(["a", "bb", "ß", "#x", "<b>", "|"]) + str(rng.randrange(rng.choice([2, 40, 400]))) for _ in range(rng.randrange(1, 120))]
        if rng.random() < 0.5:
            words += words[: rng.randrange(1, 30)]
        yield "".join(w + rng.choice([" ", "\n", "  ", "\t", "\n\n"]) for w in words)


def test_counts_equal_brute_force(spark, tmp_path):
    rows = [(i if i else None, x, "en", "z", 5) for i, x in enumerate(texts())]
    rows += rows[:5]
    spark.createDataFrame(rows, DOC).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = queries()["op12_quality_rules"](spark, str(tmp_path))
    assert got.columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    want = sorted(((i, *plain(x)) for i, x, *_ in rows), key=str)
    out = got.collect()
    assert sorted((tuple(r[:7]) for r in out), key=str) == want
    assert all(r.kept == (not r.base_failed) for r in out)  # nothing to calibrate by


def walk(tree, row, node=0):
    ratio, value, child, length = tree
    return length[node] if ratio[node] < 0 else walk(tree, row, child[node] + int(row[ratio[node]] > value[node]))


def test_forest_scores_equal_a_walk_and_find_outliers():
    rng = np.random.default_rng(1)
    rows = np.vstack([rng.normal(0, 1, (2000, 7)), rng.normal(9, 1, (6, 7))])
    forest = Q.Forest(rows)
    got = forest.score(rows)
    need = 2 * (np.log(255) + 0.5772156649) - 2 * 255 / 256
    for k in (0, 5, 2001):
        assert np.isclose(got[k], 2 ** (-np.mean([walk(t, rows[k]) for t in forest.trees]) / need))
    assert min(got[2000:]) > np.quantile(got[:2000], 0.995)
    assert list(Q.Forest(rows[:1]).score(rows[:2])) == [0, 0] and len(Q.Forest(np.zeros((50, 7))).score(np.zeros((0, 7)))) == 0


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) + rng.choice(["", "", "", ",", "."]) for _ in range(n))


def test_threshold_leaves_good_rows_alone(spark, tmp_path):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(1500):
        bad = i % 12 == 0
        words = prose(rng, rng.randrange(60, 200))
        text = " | ".join(words.split()) if bad and i % 24 else words.upper().replace(" ", "!! ") if bad else words
        rows.append((i, text, "en"))
        if i % 5:
            labels.append((i, int(not bad)))
    rows += [(5000 + i, rows[1][1], "en") for i in range(600)]  # copies of a good text
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = {r.doc_id: r.kept for r in queries()["op12_quality_rules"](spark, str(tmp_path)).collect()}
    good = [i for i in range(1500) if i % 12]
    assert len(kept) == 2100 and sum(kept[i] for i in good) >= 0.99 * len(good) and all(kept[5000 + i] == kept[1] for i in range(600))
    assert sum(not kept[i] for i in range(0, 1500, 12)) >= 100
    assert Q.measured(spark.createDataFrame([], "doc_id long, text string")).count() == 0
