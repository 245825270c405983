"""Recall of decontamination against a scan of every diagonal."""

from __future__ import annotations

import random

from tidemark.llm import decontamination as dc


def scan(text, item):
    best = None
    for at in range(1 - len(item), len(text)):
        same = [0 <= at + j < len(text) and text[at + j] == w for j, w in enumerate(item) if 0 <= at + j < len(text)]
        run = top = 0
        for x in same:
            run = max(0, run + (1 if x else -dc.MISS))
            top = max(top, run)
        n = sum(same)
        ok = n == len(item) if len(item) < dc.MIN_WORDS else (n >= dc.MIN_WORDS and n >= dc.MIN_SHARE * len(item)) or top >= dc.OVERLAP
        if ok:
            best = max(best or (0, -9999, 0), (n, -at, top))
    return best


def test_every_diagonal_over_the_rule_is_found(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda p: f"{p}{rng.randrange(2000)}"
    items = [[word("b") for _ in range(n)] for n in (1, 3, 7, 8, 9, 10, 11, 13, 15, 20, 30, 40, 59)]
    texts = []
    for item in items:
        for share in (0, 0.1, 0.2, 0.25, 0.4):
            for _ in range(3):
                x = item.copy()
                for j in rng.sample(range(len(x)), int(share * len(x))):
                    x[j] = word("s")
                texts.append([word("d") for _ in range(rng.randrange(12))] + x + [word("d") for _ in range(9)])
        texts.append([word("s") if j % 4 == 3 else w for j, w in enumerate(item)])
        texts.append(item[: len(item) // 2] + ["inserted"] + item[len(item) // 2 :])
    texts += [["x"] + items[-1][10:45] + ["y"], ["x"] + items[-1][10:22] + ["y"]]
    want = {(i, k): b for i, x in enumerate(texts) for k, item in enumerate(items) if (b := scan(x, item))}
    d = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(texts)], "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    found = lambda: {(r.doc_id, r.item_id): (r.matched_words, -r["at"], r.overlap) for r in dc.contamination(d, bench).collect()}
    assert found() == want and (len(texts) - 2, 12) in want and (len(texts) - 1, 12) not in want


def test_null_ids_by_both_paths(spark, monkeypatch):
    item = " ".join(f"w{i}" for i in range(20))
    d = spark.createDataFrame([(None, item), (1, item), (1, "other")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    want = sorted(map(str, dc.contamination(d, bench).collect()))
    monkeypatch.setattr(dc, "BROADCAST_ROWS", 1)
    assert sorted(map(str, dc.contamination(d, bench).collect())) == want and len(want) == 2
