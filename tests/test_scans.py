"""Scans with carry and exact quantiles against plain windows, numpy and loops."""

from __future__ import annotations

import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import asof, features, panel, quantiles, scan


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(scan, "SIZE", 7)
    monkeypatch.setattr(scan.days, "__defaults__", (9,))
    monkeypatch.setattr(scan.framed, "__defaults__", (0, 0, 7))


def rows(spark, rng, n=120, tickers=("A", "B", None), dup=False):
    out, seen = [], set()
    for _ in range(n):
        t, d = rng.choice(tickers), date(2020, 1, 1) + timedelta(rng.randrange(150))
        if dup or (t, d) not in seen:
            seen.add((t, d))
            out.append((t, d, rng.choice([None, rng.random() * 100]), len(out)))
    return spark.createDataFrame(out, "ticker string, date date, close double, seq long")


def whole():
    return Window.partitionBy("ticker").orderBy("date", "seq")


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_numbers_running_and_sums_equal_windows(spark):
    d = rows(spark, random.Random(1), dup=True)
    order, bucket, W = ["date", "seq"], scan.days("date"), whole()
    same(scan.numbered(d, ["ticker"], order, bucket), d.withColumn("n", F.row_number().over(W).cast("long")))
    up, down = W.rowsBetween(Window.unboundedPreceding, 0), W.rowsBetween(0, Window.unboundedFollowing)
    last = F.last("close", ignorenulls=True).over(up)
    same(scan.running(d, ["ticker"], order, bucket, "close", "x"), d.withColumn("x", last))
    same(scan.running(d, ["ticker"], order, bucket, "close", "x", previous="p"), d.withColumn("x", last).withColumn("p", F.lag("x").over(W)))
    same(scan.running(d, ["ticker"], order, bucket, "close", "x", "next"), d.withColumn("x", F.first("close", ignorenulls=True).over(down)))
    same(scan.running(d, ["ticker"], order, bucket, "close", "x", "least"), d.withColumn("x", F.min("close").over(up)))
    same(scan.summed(d, ["ticker"], order, bucket, "seq", "x"), d.withColumn("x", F.sum("seq").over(up)))
    assert scan.numbered(d.limit(0), ["ticker"], order, bucket).count() == 0


def test_null_times_come_first(spark):
    d = spark.createDataFrame([("A", None, 1.0, 0), ("A", date(2020, 1, 5), None, 1), ("A", date(2020, 3, 5), None, 2)], "ticker string, date date, close double, seq long")
    got = scan.running(d, ["ticker"], ["date", "seq"], scan.days("date"), "close", "x").orderBy("seq").collect()
    assert [r.x for r in got] == [1.0, 1.0, 1.0]


@pytest.mark.parametrize("back, ahead", [(0, 0), (1, 0), (6, 0), (7, 3), (20, 25)])
def test_frames_equal_windows(spark, back, ahead):
    d = scan.numbered(rows(spark, random.Random(2)), ["ticker"], ["date"], scan.days("date"))
    frame = lambda w: {"s": F.count("close").over(w.rowsBetween(-back, ahead)), "a": F.lag("seq", back).over(w), "b": F.lead("seq", ahead).over(w)}
    same(scan.framed(d, ["ticker"], "n", [frame], back, ahead), d.withColumns(frame(whole())))


def test_panels_equal_whole_windows(spark):
    p = panel.grid(rows(spark, random.Random(3), 200, ("A", "B")).drop("seq"))
    w = Window.partitionBy("ticker").orderBy("date")
    assert p.agg(F.max("n") == F.count_distinct("date")).first()[0]
    for limit in (None, 1, 5, 12):
        low = Window.unboundedPreceding if limit is None else -limit
        same(panel.ffill(p, "close", limit), p.withColumn("close", F.last("close", ignorenulls=True).over(w.rowsBetween(low, 0))))
    mean = p.withColumn("close", F.avg("close").over(w.rowsBetween(-9, 0)))
    same(panel.trailing_mean(p, "close", 10), mean)
    same(panel.smoothed(p, "close", 10, 4), mean.withColumn("close", F.last("close", ignorenulls=True).over(w.rowsBetween(-4, 0))))
    full = p.withColumn("close", F.last("close", ignorenulls=True).over(w))
    for pad, q in ((True, full), (False, p)):
        same(panel.returns(p, pad), q.select("ticker", "date", (F.col("close") / F.lag("close").over(w) - 1).alias("ret")))
    own = p.where("close is not null")
    same(panel.forward_return(p, 9), own.select("ticker", "date", (F.lead("close", 9).over(w) / F.col("close") - 1).alias("fwd")))


def test_momentum_equals_a_loop(spark):
    rng = random.Random(4)
    p = spark.createDataFrame([("A", date(2020, 1, 1) + timedelta(i), rng.random() + 1) for i in range(90)], "ticker string, date date, close double")
    got = panel.momentum(p).orderBy("date").collect()
    x = np.array([r.close for r in p.orderBy("date").collect()])
    ret = x[1:] / x[:-1] - 1
    for i, r in enumerate(got):
        assert (r.ret_1m is None) == (i + 1 < 63) and (r.ret_3m is None) == (i + 1 < 64)
        if i + 1 >= 64:
            assert r.ret_1m == pytest.approx(x[i] / x[i - 21] * 100 - 100) and r.ret_3m == pytest.approx(x[i] / x[i - 63] * 100 - 100)
            assert r.vol_60d == pytest.approx(ret[i - 60 : i].std(ddof=1) * 252**0.5 * 100)


def test_as_of_joins_equal_loops(spark):
    rng = random.Random(5)
    l = [(rng.choice("AB"), date(2020, 1, 1) + timedelta(rng.randrange(200)), i) for i in range(80)] + [(None, date(2020, 2, 1), 99)]
    r = [(rng.choice("AB"), date(2020, 1, 1) + timedelta(rng.randrange(200)), i) for i in range(60)] + [(None, date(2020, 1, 1), 98)]
    ld, rd = spark.createDataFrame(l, "k string, at date, i long"), spark.createDataFrame(r, "k string, ts date, seq long")
    for inclusive in (True, False):
        got = {x.i: x.seq for x in asof.asof(ld, rd, ["k"], "at", "ts", ["seq"], inclusive).collect()}
        ahead = {x.i: x.ts for x in asof.asof_forward(ld, rd, ["k"], "at", "ts", inclusive).collect()}
        for k, at, i in l:
            before = [(ts, seq) for kk, ts, seq in r if kk == k and (ts <= at if inclusive else ts < at)]
            after = [ts for kk, ts, _ in r if kk == k and (ts >= at if inclusive else ts > at)]
            assert got[i] == (max(before)[1] if before else None) and ahead[i] == min(after, default=None)


def test_latest_reported_equals_a_loop(spark):
    rng = random.Random(6)
    q = [("A", i, date(2020, 1, 1) + timedelta(rng.randrange(100)), i * 1.0) for i in rng.sample(range(40), 40)]
    a = [("A", date(2020, 1, 1) + timedelta(i)) for i in range(0, 120, 3)]
    got = features.latest_reported(spark.createDataFrame(a, "ticker string, view_date date"), spark.createDataFrame(q, "ticker string, pos long, filing_date date, eps double"))
    want = {at: min(p for _, p, f, _ in q if f < at) for _, at in a if any(f < at for _, _, f, _ in q)}
    assert {r.view_date: r.pos for r in got.collect()} == want


def test_a_ticker_is_many_tasks(spark):
    p = spark.createDataFrame([("A", date(2020, 1, 1) + timedelta(i), float(i)) for i in range(500)], "ticker string, date date, close double")
    for df in (panel.returns(p), panel.ffill(panel.ranked(p), "close", 5), asof.asof(p.select("ticker", "date"), p.withColumnRenamed("date", "ts"), ["ticker"], "date", "ts")):
        windows = [x for x in df._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window [" in x and "sum(" not in x and "windowspec" in x.lower()]
        assert windows
        assert all("__b#" in x.rpartition("], [")[0] for x in windows if "__c" not in x and "row_number" not in x), windows
    assert panel.ranked(p).select(scan.days("date")).distinct().count() > 50  # buckets of the one ticker


@pytest.mark.parametrize("accuracy", [10, 100, 10_000])
def test_quantiles_equal_numpy(spark, monkeypatch, accuracy):
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    rng = random.Random(7)
    groups = {"ties": [rng.choice([1.0, 2.0, 2.0, 2.0, 7.0]) for _ in range(900)], "one": [3.5], None: [rng.gauss(0, 1) for _ in range(1500)], "wide": [10.0 ** rng.randrange(-200, 200) * rng.choice([-1, 1]) for _ in range(700)], "same": [4.0] * 800, "two": [1.0, 2.0]}
    d = spark.createDataFrame([(g, x) for g, v in groups.items() for x in v] + [("none", None), ("two", None)], "g string, x double")
    probs = [0.0, 0.05, 1 / 3, 0.5, 2 / 3, 0.95, 1.0]
    got = {r.g: r.q for r in quantiles.quantiles(d.repartition(7), ["g"], "x", probs).collect()}
    assert got.pop("none") is None and set(got) == set(groups)
    for g, v in groups.items():
        assert np.allclose(got[g], np.quantile(v, probs), rtol=1e-12, atol=0), g
    whole = quantiles.quantiles(d, [], "x", [0.5]).first().q
    assert whole[0] == pytest.approx(np.median([x for v in groups.values() for x in v]))
    assert quantiles.quantiles(d.limit(0), ["g"], "x", probs).count() == 0
