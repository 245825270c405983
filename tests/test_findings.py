"""What the third round found: frames that are read again for every row, plans that hold other plans, numbers that may be computed twice."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import alloc, asof, backtest, quantiles, scan


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_next_value_has_no_frame_that_begins_at_its_row(spark):
    d = spark.createDataFrame([("a", date(2020, 1, 1) + timedelta(i), float(i) if i % 3 == 0 else None) for i in range(40)], "ticker string, date date, x double")
    out = scan.running(d, ["ticker"], ["date"], scan.days("date", 7), "x", "y", "next")
    assert "unboundedfollowing" not in plan(out).lower().replace(" ", "").replace("_", "")
    assert [r.y for r in out.orderBy("date").collect()] == [float(-(-i // 3) * 3) if i <= 39 else None for i in range(40)]


def test_only_the_last_row_of_a_time_is_scanned(spark):
    views = spark.createDataFrame([("a", date(2020, 1, 1), i, i * 10) for i in range(50)] + [("a", date(2020, 1, 3), 7, None)], "ticker string, view_date date, seq int, v int")
    at = spark.createDataFrame([("a", date(2020, 1, 2)), ("a", date(2020, 1, 3)), ("b", date(2020, 1, 3))], "ticker string, rebal_date date")
    out = asof.asof(at, views, ["ticker"], "rebal_date", "view_date", ["seq"])
    assert "max_by" in plan(out)
    assert sorted((r.ticker, r.rebal_date.day, r.seq, r.v) for r in out.where("seq is not null").collect()) == [("a", 2, 49, 490), ("a", 3, 7, None)]


def test_backtest_and_quantiles_are_files_to_what_reads_them(spark):
    rets = spark.createDataFrame([(t, date(2020, 1, 1) + timedelta(i), 0.01 * (i % 3 - 1)) for t in "ab" for i in range(20)], "ticker string, date date, ret double")
    periods = spark.createDataFrame([(date(2020, 1, 2), date(2020, 1, 3), date(2020, 1, 21))], "rebal_date date, trade_date date, until date")
    universe = spark.createDataFrame([("a", 1), ("b", 2)], "ticker string, ord int")
    weights = universe.select(F.lit("s").alias("strategy"), F.lit(date(2020, 1, 2)).alias("rebal_date"), "ticker", F.lit(0.5).alias("w"))
    for df in backtest.run(rets, periods, weights, universe):
        assert "Join" not in plan(df) and "Window" not in plan(df) and "InMemory" not in plan(df)
    assert "InMemory" not in plan(quantiles.quantiles(rets, ["ticker"], "ret", [0.5]))


def test_projection_is_exact():
    rng = np.random.default_rng(0)
    for i in range(300):
        n = int(rng.integers(1, 60))
        high = max(rng.uniform(0.01, 1), 1 / n)
        v = np.round(rng.normal(size=n) * 10 ** rng.uniform(-2, 1), i % 4 + 1)
        w = alloc.project(v, high)
        assert abs(w.sum() - 1) < 1e-9 and w.min() >= 0 and w.max() <= high
        inside = (w > 1e-12) & (w < high - 1e-12)  # all that are not clipped are shifted by one number
        assert not inside.any() or np.ptp((v - w)[inside]) < 1e-9


def test_numbers_in_prompts_are_formatted_by_their_binary_value(spark):
    from tidemark.functions import prompts

    rng = np.random.default_rng(3)
    own = [2.675, 0.125, 0.375, 0.25, 0.35, -0.25, -0.04, 1.005, 99.995, 0.05, 0.15, 12345.625, 1e15 + 0.3, 3e-9, -1e-20, 0.999, 9.95, 7.0]
    own += (np.round(rng.uniform(-500, 500, 3000), 3)).tolist() + (rng.integers(-9000, 9000, 1000) / 8).tolist()
    d = spark.createDataFrame([(x,) for x in own], "x double")
    for form in ("%.2f", "%+.1f", "%.1f"):
        got = {r.x: r.t for r in d.select("x", prompts.fixed(F.col("x"), form).alias("t")).collect()}
        assert {x: t for x, t in got.items() if t != form % x} == {}


def test_gold_events_are_repeated_only_where_a_document_has_many(spark):
    from tidemark.operators import evaluate

    text = lambda k: f"event number {k} of some length about topic{k * 7919 % 1000}"
    rows = [(doc, k, text(k)) for doc, n in ((1, 70), (2, 3)) for k in range(n)]
    d = spark.createDataFrame(rows, "doc long, k long, text string").withColumn("quote", F.col("text"))
    events, gold = d.withColumnRenamed("k", "i"), d.withColumnRenamed("k", "j")
    small = evaluate.scored_pairs(events.where("doc = 2"), gold.where("doc = 2"), 99.0)
    assert "sequence" not in small._jdf.queryExecution().optimizedPlan().toString().lower()
    assert small.count() == 3
    both = {(r.doc, r.i, r.j) for r in evaluate.scored_pairs(events, gold, 99.99).collect()}
    assert {(doc, k, k) for doc, k, _ in rows} <= both


def test_near_copies_are_the_same_in_many_passes(spark, monkeypatch):
    from tidemark.llm import jaccard_join as j

    rng = np.random.default_rng(5)
    docs = []
    for g in range(6):
        base = [f"w{x}" for x in rng.integers(0, 500, 120)]
        for k in range(5):
            own = list(base)
            for at in rng.integers(0, 120, k):
                own[at] = f"x{rng.integers(0, 9999)}"
            docs.append((g * 5 + k, " ".join(own)))
    sets = {i: {tuple(w[a : a + 3]) for a in range(len(w) - 2)} for i, t in docs if (w := t.split())}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    counts = []
    passes = j.passes
    monkeypatch.setattr(j, "PASS", 6000)
    monkeypatch.setattr(j, "passes", lambda amount: counts.append(passes(amount)) or counts[-1])
    got = {r.doc_id: r.component_id for r in j.jaccard_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == root
    assert max(counts) > 1


def test_passes_share_out_every_row_of_the_blocks(spark):
    from tidemark.llm import jaccard_join as j

    rng = np.random.default_rng(6)
    own = [np.unique(rng.integers(0, 2**63, 60).astype(np.uint64)) for _ in range(12)]
    own += [np.unique(np.concatenate([s[:-1], s[:1]])) for s in own]  # each less one member
    rows = spark.createDataFrame([(b, i, i) for i in range(24) for b in (i % 12, 100 + i % 4)], "bucket long, fp long, comp long")
    sketches = spark.createDataFrame([(i, len(s), bytearray(j.sketch(s))) for i, s in enumerate(own)], "fp long, n long, sketch binary")
    whole = {tuple(r) for r in j.unresolved(rows, sketches, 90, 100).collect()}
    parts = [{tuple(r) for r in j.unresolved(rows, sketches, 90, 100, k, 3).collect()} for k in range(3)]
    assert whole and set().union(*parts) == whole and max(map(len, parts)) < len(whole)


def test_python_is_handed_long_texts_in_bounded_batches(spark, tmp_path):
    from tidemark.plans import domain

    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    spark.range(60).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 1 << 20).alias("text")).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    sizes = lambda it: (type(p)({"n": [len(p)]}) for p in it)
    seen = [r.n for r in domain.table(spark, str(tmp_path), "documents").mapInPandas(sizes, "n int").collect()]
    assert sum(seen) == 60 and max(seen) < 20


def test_short_quotes_are_held_against_texts_by_bits(monkeypatch):
    from tidemark.functions import text as t

    rng = random.Random(7)
    pairs = []
    for n in (1, 2, 8, 62, 63, 64, 119, 126, 127, 252):
        for alphabet in ("ab", "abcdefgh ijkl", "aé\U0001f600 "):
            a, b = ("".join(rng.choice(alphabet) for _ in range(k)) for k in (n, n + rng.randrange(400)))
            near = list(a)
            for _ in range(n // 20):
                near[rng.randrange(n)] = "#"
            pairs += [(a, b), (a, b[:50] + "".join(near) + b[50:]), (a, "".join(near)[n // 3 :] + b), (a, b + "".join(near)[: n - n // 3])]
    want = []
    for a, b in (sorted(p, key=len) for p in pairs):
        start = np.arange(1 - len(a), len(b))
        sizes = np.minimum(start + len(a), len(b)) - np.maximum(start, 0)
        want.append(100.0 if a in b else float((200.0 * t.window_lcs([(a, b)])[0] / (len(a) + sizes)).max()))
    monkeypatch.setattr(t, "window_lcs", None)  # combing is for longer ones
    assert t.partial_ratios(pairs) == want
    assert [x if x > 70 else 70.0 for x in want] == t.partial_ratios(pairs, 70.0)


def test_every_quote_is_checked_once_whatever_reads_it(spark):
    from tidemark.operators import grounding

    text = "the company expects revenue to rise by a tenth in the coming year, and costs to fall by less than that. " * 3
    quotes = ["", None, "REVENUE to rise", "revenue to rxse by x tenth in the coming year", "none of these words is what the filing said", "short one"]
    d = spark.createDataFrame([(i, "risk", q, text) for i, q in enumerate(quotes)] + [(9, "risk", "revenue", None)], "i long, kind string, quote string, doc string")
    scored, judged = grounding.grounded(d), grounding.grounded(d, scores=False)
    kept = grounding.kept_facts(judged)
    for df in (scored, judged, kept):
        physical = df._jdf.queryExecution().executedPlan().toString()
        assert physical.count("Scan") == physical.count("EvalPython") == 1
    got = {r.i: (r.grounded, r.method) for r in scored.collect()}
    assert got == {r.i: (r.grounded, r.method) for r in judged.collect()}
    assert got == {0: (False, "empty"), 1: (False, "empty"), 2: (True, "exact"), 3: (True, "fuzzy"), 4: (False, "none"), 5: (False, "none"), 9: (False, "none")}
    assert {r.i for r in kept.collect()} == {2, 3}


def test_normalised_is_one_rule_for_every_code_point():
    import sys
    import unicodedata

    from tidemark.functions import text as t

    table = str.maketrans(t.PLAIN | dict.fromkeys(t.DROPPED, ""))
    for c in range(sys.maxunicode + 1):
        x = f"A{chr(c)} é"
        assert t.normalised(x) == " ".join(unicodedata.normalize("NFKC", x).translate(table).lower().split())
