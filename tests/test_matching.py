"""Best-first matching in rounds against the loop over all pairs."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import evaluate

E, G = "doc long, i long, text string, quote string", "doc long, j long, text string, quote string"


def score(a, b):
    x, y, q, r = (t.normalised(v) for v in (a[2], b[2], a[3], b[3]))
    return max(t.token_set_ratio(x, y), t.partial_ratio(q, r) if q and r else 0.0)


def plain(events, gold, threshold, look=None):
    out = []
    for doc in {e[0] for e in events}:
        pairs = [(score(a, b), a[1], b[1]) for a in events if a[0] == doc for b in gold if b[0] == doc]
        out += [(doc, *r) for r in evaluate.greedy(pairs, threshold, look)]
    return sorted(out)


def rows(rng, n, docs, words):
    phrase = lambda k: " ".join(rng.choice(words) for _ in range(k))
    return [(rng.randrange(docs), i, rng.choice([None, "", phrase(rng.randrange(1, 7)), phrase(5)]), rng.choice([None, "", phrase(rng.randrange(1, 12))])) for i in range(n)]


@pytest.mark.parametrize(("threshold", "look"), [(60.0, None), (60.0, (50.0, 72.0)), (90.0, (30.0, 95.0)), (0.0, None)])
def test_rounds_equal_the_greedy_loop(spark, threshold, look):
    rng = random.Random(int(threshold))
    words = ["Merger", "completed", "loss", "of", "the", "“plant”", "ﬁre", "in", "Texas", "2010", "revenue", "fell"]
    events, gold = rows(rng, 60, 4, words), rows(rng, 50, 4, words)
    gold += [(0, 900 + k, e[2], e[3]) for k, e in enumerate(events) if e[0] == 0][:5]
    got = evaluate.match_events(spark.createDataFrame(events, E), spark.createDataFrame(gold, G), threshold, look)
    want = plain(events, gold, threshold, look)
    if threshold == 0.0:  # pairs of score 0 match too, as in the loop
        assert len(want) == got.count()
    assert [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in sorted(map(tuple, got.collect()))] == [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in want]


def test_the_bound_is_never_below_the_score(spark):
    rng = random.Random(3)
    words = ["a", "ab", "abc", "bca", "zzz", "é", "😀", "and", "dna"]
    events, gold = rows(rng, 40, 1, words), rows(rng, 40, 1, words)
    own = {a[1]: a for a in events}
    other = {b[1]: b for b in gold}
    both = evaluate._measured(spark.createDataFrame(events, E), "i", "a").join(evaluate._measured(spark.createDataFrame(gold, G), "j", "b"), "doc")
    got = both.select("i", "j", evaluate._bound("a", "b").alias("bound")).collect()
    assert len(got) == 1600 and all(r.bound >= score(own[r.i], other[r.j]) - 1e-9 for r in got)
    assert sum(r.bound < 60 for r in got) > 100  # and it prunes


def test_a_document_with_very_many_events(spark):
    """Chains in which every event likes the next one's partner best are undone round by round; ties go as in the loop."""
    pairs = [(0, i, j, 100.0 - abs(i - j) - (i % 7) / 10) for i in range(300) for j in range(max(0, i - 3), min(300, i + 4))]
    d = spark.createDataFrame(pairs, "doc long, i long, j long, score double")
    got = sorted((r.i, r.j) for r in evaluate.best_first(d, 60.0).collect())
    assert got == sorted((i, j) for i, j, _ in evaluate.greedy([(s, i, j) for _, i, j, s in pairs], 60.0))
    assert evaluate.best_first(d.limit(0), 60.0).count() == 0
    plan = evaluate.best_first(d.withColumn("score", F.lit(80.0)).where("i < 5 and j < 5"), 60.0)
    assert plan.count() == 5
