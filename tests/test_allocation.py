"""Covariances from prefix sums, and rebalances that hold, against plain numpy and a loop over days."""

from __future__ import annotations

from datetime import date, timedelta

import numpy as np
import pytest

from tidemark.operators import alloc, backtest

DAYS = [date(2020, 1, 1) + timedelta(i) for i in range(140)]
NAMES = ["A", "B", "C", "D"]


def panel(spark, seed=3, days=DAYS, names=NAMES):
    r = np.random.default_rng(seed).normal(0.001, 0.02, (len(days), len(names)))
    return r, spark.createDataFrame([(n, d, float(r[i, j])) for i, d in enumerate(days) for j, n in enumerate(names)], "ticker string, date date, ret double")


def dates(spark, ds):
    return spark.createDataFrame([(d,) for d in ds], "rebal_date date")


def ledoit_wolf(x):
    """The shrinkage from centred days, as it is defined."""
    n, p = x.shape
    c = x - x.mean(0)
    s = c.T @ c / n
    mu = np.trace(s) / p
    d2 = np.square(s - mu * np.eye(p)).sum() / p
    b2 = min(sum(np.square(np.outer(t, t) - s).sum() / p for t in c) / n**2, d2)
    return (b2 / d2 * mu * np.eye(p) + (1 - b2 / d2) * s) * 252


def test_moments_are_those_of_the_windows(spark):
    r, rets = panel(spark)
    at = [DAYS[30], DAYS[30], DAYS[60], DAYS[61], DAYS[95], DAYS[139] + timedelta(50), DAYS[10]]
    sums = alloc.moments(rets, dates(spark, at), 31)
    cov = {(x.rebal_date, x.a, x.b): x.cov for x in alloc.covariance(sums).collect()}
    tops = {DAYS[30]: 31, DAYS[60]: 61, DAYS[61]: 62, DAYS[95]: 96, at[5]: 140}  # the tenth day has no window
    assert len(cov) == len(tops) * 10
    for d, top in tops.items():
        want = np.cov(r[top - 31 : top], rowvar=False) * 252
        for i, a in enumerate(NAMES):
            for j, b in enumerate(NAMES[i:], i):
                assert cov[d, a, b] == pytest.approx(want[i, j], rel=1e-9)
    assert alloc.moments(rets.limit(0), dates(spark, at), 31).count() == 0


def test_shrinkage_from_sums_equals_its_definition():
    for seed, n, p in ((1, 300, 5), (2, 70, 40), (3, 60, 2)):
        x = np.random.default_rng(seed).normal(0.002, 0.02, (n, p)) @ np.random.default_rng(9).normal(0, 1, (p, p))
        assert alloc.shrunk_cov(alloc.Moments.of(x)) == pytest.approx(ledoit_wolf(x), rel=1e-9, abs=1e-12)


def test_weights_come_from_the_windows_and_hold_without(spark):
    r, rets = panel(spark)
    ds = [DAYS[20], DAYS[90], DAYS[120]]
    at = spark.createDataFrame([(d, t) for d in ds for t in NAMES], "rebal_date date, ticker string")
    views = spark.createDataFrame([(DAYS[90], "B", 80, "medium", 0.03), (DAYS[120], "C", -50, "high", 0.02), (DAYS[120], "gone", 10, "low", 0.02)], "rebal_date date, ticker string, view_bps int, confidence string, sigma double")
    sums = alloc.moments(rets, dates(spark, ds), 70)
    got = alloc.allocate(sums, at, views, ["mvo", "bl_llm_tilt_pos", "bl_llm", "random_n"], least=60).collect()
    by = {}
    for x in got:
        by.setdefault((x.strategy, x.rebal_date), []).append(x)
    for name in ("mvo", "bl_llm_tilt_pos", "bl_llm"):
        assert [(x.ticker, x.w, x.held) for x in by[name, DAYS[20]]] == [(None, None, True)]
    assert len(by["random_n", DAYS[20]]) == 4 and not by["random_n", DAYS[20]][0].held  # needs no covariance
    x = r[21:91]
    cov = ledoit_wolf(x)
    w = {y.ticker: y.w for y in by["mvo", DAYS[90]]}
    assert [w[t] for t in NAMES] == pytest.approx(alloc.mean_variance(x.mean(0) * 252, cov), abs=1e-6)
    post = alloc.posterior(cov, alloc.prior(cov, np.full(4, 0.25)), np.array([1]), np.array([0.008]), np.array([0.0009]))
    w = {y.ticker: y.w for y in by["bl_llm_tilt_pos", DAYS[90]]}
    assert [w[t] for t in NAMES] == pytest.approx(alloc.tilt(post, np.full(4, 0.25)), abs=1e-9)
    assert [y.w for y in by["bl_llm_tilt_pos", DAYS[120]]] == [0.25] * 4  # no medium view: the base
    few = alloc.allocate(sums, at, views, ["mvo"], least=71).collect()
    assert all(y.held and y.ticker is None for y in few) and len(few) == 3


def loop(r, per, targets, cost_bps=10.0):
    """Day by day: a rebalance without targets keeps the drifted weights and trades nothing."""
    have, net, turns = np.full(len(NAMES), 1 / len(NAMES)), {}, []
    for (d, a, b), target in zip(per, targets, strict=True):
        own = [i for i, x in enumerate(DAYS) if a <= x < b]
        new = have.copy() if target is None else target
        turn = float(np.abs(new - have).sum())
        if not own:
            continue
        turns.append((d, turn))
        have = new.copy()
        for k, i in enumerate(own):
            x = float(have @ r[i])
            net[DAYS[i]] = x - (turn * cost_bps / 1e4 if k == 0 else 0)
            have = have * (1 + r[i])
            have = have / have.sum()
    return net, turns


@pytest.mark.parametrize("bad", [(), (0,), (0, 1), (1,), (1, 2), (2, 4), (4,), (0, 1, 2, 3, 4)])
def test_held_rebalances_equal_a_day_loop(spark, bad):
    r, rets = panel(spark, 5)
    cuts = [10, 30, 55, 80, 110]
    per = [(DAYS[c - 1], DAYS[c], DAYS[cuts[k + 1]] if k < 4 else DAYS[-1]) for k, c in enumerate(cuts)]
    drawn = np.random.default_rng(6).dirichlet([1] * 4, 5)
    targets = [None if k in bad else drawn[k] for k in range(5)]
    periods = spark.createDataFrame(per, "rebal_date date, trade_date date, until date")
    universe = spark.createDataFrame([(n, i) for i, n in enumerate(NAMES)], "ticker string, ord int")
    schema = "strategy string, rebal_date date, ticker string, w double"
    rows = [("s", per[k][0], n, float(t[j])) for k, t in enumerate(targets) if t is not None for j, n in enumerate(NAMES)]
    rows += [("other", per[k][0], n, float(drawn[-1 - k][j])) for k in range(5) for j, n in enumerate(NAMES)]
    held = spark.createDataFrame([("s", per[k][0]) for k in bad], "strategy string, rebal_date date")
    net, turns = backtest.run(rets, periods, spark.createDataFrame(rows, schema), universe, 10.0, held)
    for name, ts in (("s", targets), ("other", list(drawn[::-1]))):
        want, trades = loop(r, per, ts)
        got = {x.date: x.ret for x in net.where(f"strategy = '{name}'").collect()}
        assert set(got) == set(want) and all(got[d] == pytest.approx(v, abs=1e-12) for d, v in want.items())
        own = sorted((x.rebal_date, x.turnover) for x in turns.where(f"strategy = '{name}'").collect())
        assert [d for d, _ in own] == [d for d, _ in trades] and [v for _, v in own] == pytest.approx([v for _, v in trades], abs=1e-12)
