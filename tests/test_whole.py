"""Queries work on whole tables and whole texts."""

from __future__ import annotations

import random

import pytest

from tidemark.functions import text as t
from tidemark.plans import filings


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def write(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


# --- filings: all documents ---


def test_window_lcs_equals_each_window():
    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice(alphabet) for _ in range(rng.randrange(1, most))) for alphabet, most in (("abcé", 30), ("abcd\U0001f600", 120)))
        want = [t.lcs(a, b[max(i, 0) : i + len(a)]) for i in range(1 - len(a), len(b))]
        assert t.window_lcs([(a, b), (a, b[::-1] + b), (a, b)])[2].tolist() == want


def test_facts_and_sections_of_all_documents(spark, tmp_path):
    rng = random.Random(2)
    texts = [None, "", "short", *[prose(rng, n) for n in (60, 60, 60, 400, 400, 400, 9000, 9000, 9000)]]
    texts[10] = "x" * 50 + "e" * 200 + prose(rng, 9000)
    sf = write(spark, tmp_path, "documents", [(i, x, None if x is None else len(x)) for i, x in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in filings.Q["grounded_quotes"](spark, sf).collect()}
    assert set(got) == set(range(len(texts)))
    assert [got[i].method for i in (0, 1, 2, 3, 4, 8)] == ["empty", "empty", "empty", "empty", "exact", "exact"] and all(not got[i].grounded for i in (0, 1, 2))
    q, doc = t.normalised(texts[6][49:169][::-1]), t.normalised(texts[6])
    assert got[6].score == pytest.approx(max(t.ratio(q, doc[max(i, 0) : i + len(q)]) for i in range(1 - len(q), len(doc))), abs=1e-6)
    assert sum(r.total_facts for r in filings.Q["grounding_summary"](spark, sf).collect()) == len(texts)
    kept = {r.doc_id for r in filings.Q["kept_facts"](spark, sf).collect()}
    assert kept >= {i for i in range(len(texts)) if i % 3 == 0}
    found = {r.doc_id: r for r in filings.Q["filing_sections"](spark, sf).collect()}
    assert set(found) == set(range(len(texts)))
    assert found[2].found == [] and found[2].missing == ["mda", "risk_factors"] and found[9].missing == []


# --- matched events: whole texts, quotes too ---


def test_matched_events_by_whole_texts_and_quotes(spark, tmp_path):
    from tidemark.operators import evaluate

    rng = random.Random(3)
    same, alike = prose(rng, 60), prose(rng, 200)
    turns = [(1, 0, "user", same + " " + alike), (1, 1, "assistant", same + " " + "9" * 1500), (2, 0, "user", "1" * 250 + " " + alike), (2, 1, "assistant", "2" * 250 + " " + alike), (3, 0, "user", None), (3, 1, "assistant", alike)]
    sf = write(spark, tmp_path, "conversations", turns, "conv_id long, turn int, role string, text string")
    got = {r.doc: r.score for r in filings.Q["matched_events"](spark, sf).collect()}
    assert set(got) == {2} and got[2] > 80  # those of 1 agree in their first 200 characters alone, those of 2 only after them
    e = spark.createDataFrame([(1, 0, "alpha beta", "the net income fell by a third in the year")], "doc long, i long, text string, quote string")
    g = spark.createDataFrame([(1, 0, "gamma delta", "net income fell by a third")], "doc long, j long, text string, quote string")
    assert [r.score for r in evaluate.match_events(e, g).collect()] == [100.0]
    assert evaluate.match_events(e.withColumn("quote", e.quote.substr(1, 0)), g).count() == 0


# --- views and digests of whole texts ---


def test_views_and_digests_cover_whole_texts(spark, tmp_path):
    head = "word " * 100
    sf = write(spark, tmp_path, "documents", [(i, head + x) for i, x in enumerate(("gains of all kinds", "losses", "a lawsuit", "new plants"))], "doc_id long, text string")
    views = [tuple(r)[1:] for r in filings.Q["annotated_views"](spark, sf).collect()]
    assert len(views) == 4 and len(set(map(str, views))) > 1
    assert len({r.h for r in filings.Q["cleaned_text"](spark, sf).collect()}) == 4


# --- all tickers, all draws ---


def test_all_tickers_count_and_all_draws_are_made(spark, monkeypatch):
    import inspect

    from tidemark.plans import market

    v = spark.createDataFrame([(f"T{i:02}", i, "high", "10-K") for i in range(25)], "ticker string, view_bps int, confidence string, filing_type string")
    monkeypatch.setattr(filings.d, "views", lambda *_: v)
    assert [tuple(r) for r in filings.Q["confidence_histogram"](spark, "").collect()] == [("10-K", "high", 25, 0, 24, 12.0)]
    signature, seen = inspect.signature(market.stats.bootstrap_sharpe), {}
    monkeypatch.setattr(market.d, "backtested", lambda *_: (v, v))
    monkeypatch.setattr(market.stats, "bootstrap_sharpe", lambda *a, **k: (seen.update((b := signature.bind(*a, **k)).apply_defaults() or b.arguments), v)[1])
    market.Q["sharpe_bootstrap"](spark, "")
    assert seen["draws"] == 10_000
