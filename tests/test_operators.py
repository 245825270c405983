"""Hand-computed cases of the operators."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import scalars as s
from tidemark.functions import text as t
from tidemark.operators import alloc, annotate, asof, backtest, calendar, coverage, evaluate, features, grounding, metrics, panel, stats
from tidemark.sources import market_api, readers, sinks


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_active_views_take_the_latest_and_then_its_age(spark):
    v = spark.createDataFrame([("A", date(2006, 3, 2), 50, 1), ("B", date(2006, 3, 1), 40, 2), ("C", date(2006, 7, 1), 99, 3), ("D", date(2006, 5, 1), 10, 4), ("D", date(2006, 5, 1), 20, 5)], "ticker string, view_date date, view_bps int, seq int")
    at = spark.createDataFrame([(date(2006, 6, 30), x) for x in "ABCD"], "rebal_date date, ticker string")
    got = asof.active_views(v, at).select("ticker", "view_bps")
    assert rows(got, "ticker") == [("A", 50), ("D", 20)]


def test_asof_never_looks_ahead(spark):
    rng = np.random.default_rng(1)
    l = spark.createDataFrame([(int(k), int(x)) for k, x in zip(rng.integers(0, 5, 200), rng.integers(0, 100, 200))], "k int, at int")
    r = spark.createDataFrame([(int(k), int(x), i) for i, (k, x) in enumerate(zip(rng.integers(0, 5, 100), rng.integers(0, 100, 100)))], "k int, ts int, seq int")
    got = asof.asof(l, r, ["k"], "at", "ts", ["seq"]).collect()
    by = {}
    for x in r.collect():
        by.setdefault(x.k, []).append((x.ts, x.seq))
    for g in got:
        want = max([x for x in by.get(g.k, []) if x[0] <= g["at"]], default=None)
        assert (g.ts, g.seq) == (want or (None, None))
    ahead = asof.asof_forward(l, r, ["k"], "at", "ts").collect()
    for g in ahead:
        assert g.ts == min([x[0] for x in by.get(g.k, []) if x[0] >= g["at"]], default=None)


def test_metrics(spark):
    r = spark.createDataFrame([("x", date(2020, 1, 1) + timedelta(i), v) for i, v in enumerate([0.01, -0.02, 0.015, -0.005, 0.02])], "strategy string, date date, ret double")
    m = metrics.metrics(r).first()
    want = {"total_return": 0.0196162403, "ann_return": 1.6620236486, "ann_vol": 0.2596343583, "sharpe": 6.3243696230, "sortino": 9.7522062127, "max_drawdown": -0.02, "calmar": 82.1011824297}
    for k, v in want.items():
        assert m[k] == pytest.approx(v, abs=1e-8), k


def test_calendar(spark):
    got = rows(calendar.rebalance_dates(spark, date(2006, 1, 1), date(2007, 12, 31)), "rebal_date")
    assert [x[0] for x in got] == [date(2006, 3, 31), date(2006, 6, 30), date(2006, 9, 29), date(2006, 12, 29), date(2007, 3, 30), date(2007, 6, 29), date(2007, 9, 28), date(2007, 12, 31)]
    with pytest.raises(ValueError):
        calendar.rebalance_dates(spark, date(2006, 1, 1), date(2007, 1, 1), "weekly")


def test_backtest_equals_a_loop_over_days(spark):
    rng = np.random.default_rng(3)
    days = [date(2020, 1, 1) + timedelta(i) for i in range(30)]
    names, r = ["A", "B", "C"], rng.normal(0, 0.02, (30, 3))
    rets = spark.createDataFrame([(n, d, float(r[i, j])) for i, d in enumerate(days) for j, n in enumerate(names)], "ticker string, date date, ret double")
    cuts = [5, 12, 20]
    per = [(days[c - 1], days[c], days[cuts[k + 1]] if k < 2 else days[-1]) for k, c in enumerate(cuts)]
    periods = spark.createDataFrame(per, "rebal_date date, trade_date date, until date")
    target = rng.dirichlet([1, 1, 1], 3)
    w = spark.createDataFrame([("s", p[0], n, float(target[k, j])) for k, p in enumerate(per) for j, n in enumerate(names)], "strategy string, rebal_date date, ticker string, w double")
    net, turns = backtest.run(rets, periods, w, spark.createDataFrame([(n, i) for i, n in enumerate(names)], "ticker string, ord int"), 10.0)
    have, want, cost = np.full(3, 1 / 3), [], []
    for k, (_, a, b) in enumerate(per):
        turn = np.abs(target[k] - have).sum()
        have = target[k]
        cost.append(turn)
        for i, d in enumerate(days):
            if a <= d < b:
                x = have @ r[i]
                have = have * (1 + r[i]) / (1 + x)
                want.append(x - (turn * 10 / 1e4 if d == a else 0))
    assert [x.ret for x in net.orderBy("date").collect()] == pytest.approx(want, abs=1e-12)
    assert [x.turnover for x in turns.orderBy("rebal_date").collect()] == pytest.approx(cost, abs=1e-12)


def test_ffill_limit(spark):
    p = spark.createDataFrame([("A", date(2020, 1, 1) + timedelta(i), 1.0 if i == 0 else None) for i in range(8)], "ticker string, date date, close double")
    got = [x.close for x in panel.ffill(p, "close", 5).orderBy("date").collect()]
    assert got == [1.0] * 6 + [None] * 2


def test_tilt_and_posterior():
    assert alloc.tilt(np.array([0.01, 0.02, 0.03, 0.10]), np.full(4, 0.25)) == pytest.approx([0.11207918, 0.29597361, 0.29597361, 0.29597361], abs=1e-8)
    cov = np.array([[0.04, 0.01], [0.01, 0.09]])
    pi = alloc.prior(cov, np.full(2, 0.5))
    assert pi == pytest.approx([0.0625, 0.125])
    assert alloc.posterior(cov, pi, np.array([0]), np.array([0.02]), np.array([0.0009])) == pytest.approx([0.03318966, 0.11767241], abs=1e-8)


def test_mean_variance_meets_its_conditions():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.01, (300, 20))
    cov, mu = alloc.shrunk_cov(alloc.Moments.of(x)), rng.normal(0.05, 0.1, 20)
    w = alloc.mean_variance(mu, cov)
    assert w.sum() == pytest.approx(1) and w.min() >= -1e-12 and w.max() <= 0.10 + 1e-9
    g = mu - 2.5 * cov @ w
    inner = (w > 1e-6) & (w < 0.1 - 1e-6)
    if inner.any():
        level = g[inner].mean()
        assert np.abs(g[inner] - level).max() < 1e-4
        assert (g[w <= 1e-6] <= level + 1e-4).all() and (g[w >= 0.1 - 1e-6] >= level - 1e-4).all()


def test_z_scores(spark):
    d = spark.createDataFrame([(1, 0.1), (1, 0.3), (1, -0.2), (2, 0.7)], "k int, tone double")
    got = features.z_score(d, "k", "tone", "z").withColumn("b", features.z_to_bps(F.col("z")))
    assert [(round(x.z, 8), x.b) for x in got.orderBy("k", "tone").collect()] == [(-1.29777137, -130), (0.16222142, 16), (1.13554995, 114), (0.0, 0)]


def test_tertiles_and_spearman(spark):
    d = spark.createDataFrame([(float(x),) for x in range(10, 70, 10)], "v double")
    assert [x.b for x in stats.tertiles(d, "v", "b").orderBy("v").collect()] == ["lo", "lo", "mid", "mid", "hi", "hi"]
    assert stats.tertiles(spark.createDataFrame([(1.0,), (1.0,)], "v double"), "v", "b").count() == 0
    e = spark.createDataFrame([(1, 10), (2, 30), (2, 20), (4, 40)], "a int, b int")
    assert stats.spearman(e, "a", "b").first().rank_ic == pytest.approx(0.9486832981)


def test_t_distribution():
    assert stats.t_p_value(2.262157, 9) == pytest.approx(0.05, abs=1e-6)
    assert stats.t_p_value(1.959964, 1e7) == pytest.approx(0.05, abs=1e-6)


def test_ols_matches_least_squares(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 2))
    y = 0.5 + x @ [1.0, -2.0] + rng.normal(size=200) * 0.1
    d = spark.createDataFrame([("g", *map(float, a), float(b)) for a, b in zip(x, y)], "g string, p double, q double, y double")
    got = stats.ols(d, "g", "y", ["p", "q"]).first()
    beta = np.linalg.lstsq(np.column_stack([np.ones(200), x]), y, rcond=None)[0]
    assert [got.alpha, *got.betas] == pytest.approx(beta.tolist(), abs=1e-9)
    full = np.column_stack([np.ones(200), x])
    error = np.sqrt(np.square(y - full @ beta).sum() / 197 * np.diag(np.linalg.inv(full.T @ full)))
    assert [got.t_alpha, *got.t_betas] == pytest.approx((beta / error).tolist(), rel=1e-6)


@pytest.mark.parametrize(("form", "day", "want"), [("10-K", "2024-02-01", "FY 2023"), ("10-K", "2024-10-30", "FY 2024"), ("10-Q", "2024-02-10", "Q4 2023"), ("10-Q", "2024-05-01", "Q1 2024"), ("10-Q", "2024-08-01", "Q2 2024"), ("10-Q", "2024-11-01", "Q3 2024"), ("10-Q", None, "Unknown")])
def test_fiscal_period(spark, form, day, want):
    d = spark.createDataFrame([(form, day)], "f string, d string")
    assert d.select(s.fiscal_period(F.col("f"), F.col("d").cast("date"))).first()[0] == want


def test_coercions(spark):
    d = spark.createDataFrame([(" Supply Chain", None, "bullish", "NA", "12.5", "x")], "a string, b string, c string, n string, r string, bad string")
    got = d.select(s.coerce(F.col("a"), s.RISK_CATEGORIES, "other"), s.coerce(F.col("b"), s.SEVERITIES, "medium"), s.coerce(F.col("c"), s.SENTIMENTS, "neutral"), s.clean_null(F.col("n")), s.clamp_round(F.col("r")), s.clamp_round(F.col("bad"))).first()
    assert tuple(got) == ("supply_chain", "medium", "neutral", None, 12, 0)


def test_estimates_take_the_first_within_five_days(spark):
    q = spark.createDataFrame([("A", 0, date(2024, 1, 10)), ("A", 1, date(2024, 3, 10))], "ticker string, pos int, date date")
    e = spark.createDataFrame([("A", 0, date(2024, 1, 15), 1.0), ("A", 1, date(2024, 1, 10), 2.0), ("A", 2, date(2024, 3, 16), 3.0)], "ticker string, epos int, edate date, v double")
    assert [(x.pos, x.v) for x in features.matched_quarters(q, e).collect()] == [(0, 1.0)]
    far = spark.createDataFrame([(3.10, 1.0, 2.0, 0.5, 1.0, 1.0)], "eps double, eps_avg double, eps_high double, eps_low double, revenue double, revenue_avg double")
    x = features.surprises(far).first()
    assert x.eps is None and x.eps_surprise is None and x.dispersion is None and x.revenue_surprise is None and x.revenue == 1.0


def test_grounding():
    doc = t.normalised("The company’s revenue rose by\xa012 percent in the second quarter of the year.")
    assert grounding.check("", doc) == (False, 0.0, "empty")
    assert grounding.check("company's revenue rose by 12 percent", doc) == (True, 100.0, "exact")
    assert grounding.check("not in the document", doc)[2] == "none"
    assert grounding.check("revenue rose by 13 percent in the second quarter", doc)[2] == "fuzzy"


def test_similarity_bounds():
    rng = np.random.default_rng(4)
    for _ in range(50):
        a, b = ("".join(rng.choice(list("abc"), rng.integers(0, 12))) for _ in range(2))
        short, long_ = sorted((a, b), key=len)
        windows = [long_[max(0, i) : i + len(short)] for i in range(-len(short) + 1, len(long_))] if short else []
        want = max((t.ratio(short, w) for w in windows if w), default=100.0 if not long_ else 0.0)
        assert t.partial_ratio(a, b) == pytest.approx(want if short else want)


def test_greedy_matching():
    assert evaluate.greedy([(80, 0, 0), (90, 0, 1), (85, 1, 1), (50, 1, 0)], 60) == [(0, 1, 90)]
    assert evaluate.greedy([(70, 0, 0), (70, 1, 0)], 60) == [(1, 0, 70)]


def test_quotas():
    q = coverage.quotas({"a": 50, "b": 30, "c": 3, "d": 1}, 20)
    assert sum(q.values()) == 20 and q["d"] == 1 and q["c"] >= 2


def test_lenient_json(spark):
    d = spark.createDataFrame([('{"k": 1}',), ('x ```json\n{"k": 2}\n``` y',), ('so {"k": 3} there',), ("none",)], "v string")
    assert [x[0] for x in d.select(t.lenient_json(F.col("v"), "struct<k:int>")["k"]).collect()] == [1, 2, 3, None]


def test_chunks_cover_the_text():
    text = ". ".join(f"Sentence number {i} of the text" for i in range(400))
    got = t.char_chunks(text, 1000, 100)
    assert text.startswith(got[0]) and text.endswith(got[-1]) and all(len(x) <= 1000 for x in got)
    pos = 0
    for x in got:
        at = text.find(x, max(0, pos - 200))
        assert at <= pos
        pos = at + len(x)
    assert t.token_chunks("", 10, 2) == [""] and t.token_chunks("abc", 10, 2) == ["abc"]


def test_annotator(spark):
    calls = {"n": 0}

    def flaky(p: str) -> str:
        if "bad" in p:
            raise ValueError("broken")
        return '{"view_bps": 512.9, "confidence": " HIGH ", "reasoning": "short"}'

    d = spark.createDataFrame([(1, "good"), (2, "bad")], "id int, prompt string")
    a = annotate.annotate(d, "id", "prompt", flaky)
    assert [(x.id, x.view_bps, x.confidence) for x in annotate.views(a, "id").collect()] == [(1, 300, "high")]
    assert [(x.id, x.incident_type) for x in annotate.incidents(a, "id").collect()] == [(2, "llm_error")]
    assert calls["n"] == 0


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "AAA").mkdir()
    (tmp_path / "AAA/prices.csv").write_text("date,open,close\n2020-01-01,1,2\nbad,1,1\n2020-01-02,1,3\n")
    assert rows(readers.prices(spark, f"{tmp_path}/*/prices.csv"), "date") == [("AAA", date(2020, 1, 1), 2.0), ("AAA", date(2020, 1, 2), 3.0)]
    (tmp_path / "AAA/10-K_2020-03-01.html").write_text("<p>x</p>")
    assert rows(readers.filings(spark, f"{tmp_path}/*/*.html"), "ticker") == [("AAA", "10-K", date(2020, 3, 1), "<p>x</p>")]
    (tmp_path / "ff.txt").write_text("Header\n\n,Mkt,SMB\n20200101, 1.0, 2.0\n20200102,0.5,-1\n\nAnnual\n2020,9,9\n")
    assert rows(readers.factor_file(spark, f"{tmp_path}/ff.txt", ["mkt", "smb"]), "date") == [(date(2020, 1, 1), 0.01, 0.02), (date(2020, 1, 2), 0.005, -0.01)]
    assert rows(readers.universe(spark, "core:\n  - A\n  - B\nholdout:\n  - C\n"), "ord") == [("A", "core", 0), ("B", "core", 1), ("C", "holdout", 2)]
    out = f"{tmp_path}/sink"
    d = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    sinks.append_new(d.where("id = 1"), out, ["id"])
    sinks.append_new(d, out, ["id"])
    assert rows(spark.read.parquet(out), "id") == [(1, "a"), (2, "b")]
    spark.dataSource.register(market_api.MarketPrices)
    m = spark.read.format("market_prices").options(symbols="X,Y", start="2024-01-01", end="2024-01-07").load()
    assert m.count() == 10
