"""Covariances from prefix sums, Black-Litterman, tilts and mean-variance weights: small dense algebra per rebalance date."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

YEAR = 252


def stable_seed(date: str, seed: int = 0) -> int:
    """The same on every machine and in every process."""
    return int.from_bytes(hashlib.blake2b(f"{date}|{seed}".encode(), digest_size=8).digest(), "big") % 2**32


class Moments:
    """Sums over the ``n`` days of a window: ``x`` of each asset's return, ``xx`` of products of two, ``sx`` of each return times the day's sum of squares, ``ss`` of that sum squared."""

    def __init__(self, n: int, x: np.ndarray, xx: np.ndarray, sx: np.ndarray, ss: float) -> None:
        self.n, self.x, self.xx, self.sx, self.ss = n, x, xx, sx, ss

    @staticmethod
    def of(rows: np.ndarray) -> Moments:
        s = np.square(rows).sum(1)
        return Moments(len(rows), rows.sum(0), rows.T @ rows, s @ rows, float(s @ s))

    @property
    def mean(self) -> np.ndarray:
        return self.x / self.n


def sample_cov(m: Moments) -> np.ndarray:
    return (m.xx - np.outer(m.x, m.x) / m.n) / (m.n - 1) * YEAR


def shrunk_cov(m: Moments) -> np.ndarray:
    """Ledoit-Wolf: towards the mean variance times the identity, by the intensity of least expected loss; annualised. The squares of centred
    days that it needs are expanded into the window's sums."""
    n, mean, p = m.n, m.mean, len(m.x)
    s = m.xx / n - np.outer(mean, mean)
    mu = np.trace(s) / p
    delta = (np.square(s).sum() - p * mu * mu) / p
    q = float(mean @ mean)
    fourth = m.ss + 4 * mean @ m.xx @ mean + n * q * q - 4 * mean @ m.sx + 2 * q * np.trace(m.xx) - 4 * q * mean @ m.x
    beta = min((fourth / n - np.square(s).sum()) / (p * n), delta)
    a = beta / delta if delta > 0 else 0.0
    return ((1 - a) * s + a * mu * np.eye(p)) * YEAR


def prior(cov: np.ndarray, w: np.ndarray, delta: float = 2.5) -> np.ndarray:
    return delta * cov @ w


def posterior(cov: np.ndarray, pi: np.ndarray, at: np.ndarray, q: np.ndarray, omega: np.ndarray, tau: float = 0.05) -> np.ndarray:
    """Posterior returns under absolute views ``q`` with variances ``omega`` on assets ``at``; the prior without views."""
    if not len(at):
        return pi
    a = np.linalg.inv(tau * cov)
    lhs, rhs = a.copy(), a @ pi
    np.add.at(lhs, (at, at), 1 / omega)
    np.add.at(rhs, at, q / omega)
    return np.linalg.solve(lhs, rhs)


def tilt(mu: np.ndarray, base: np.ndarray, k: float = 1.0, low: float = 0.005, high: float = 0.10) -> np.ndarray:
    """base * (1 + k z), bounded, then renormalised: the bound may be passed again. No spread: the base."""
    sd = mu.std()
    if sd < 1e-10:
        return base
    w = np.clip(base * (1 + k * (mu - mu.mean()) / sd), low, high)
    return w / w.sum()


def project(v: np.ndarray, high: float) -> np.ndarray:
    """The nearest weights with sum 1 and 0 <= w <= ``high``: ``v`` less one number, clipped. The sum falls piecewise linearly with that number, so it is found between two of the bends."""
    own = np.sort(v)
    total = np.concatenate([[0.0], np.cumsum(own)])
    bends = np.sort(np.concatenate([own - high, own]))
    low, full = np.searchsorted(own, bends, "right"), np.searchsorted(own, bends + high, "left")
    sums = high * (len(v) - full) + total[full] - total[low] - bends * (full - low)
    k = max(int(np.searchsorted(-sums, -1.0, "right")) - 1, 0)
    if k + 1 == len(bends) or sums[k] <= sums[k + 1]:
        return np.clip(v - bends[k], 0, high)
    return np.clip(v - bends[k] - (sums[k] - 1) / (sums[k] - sums[k + 1]) * (bends[k + 1] - bends[k]), 0, high)


def mean_variance(mu: np.ndarray, cov: np.ndarray, aversion: float = 2.5, high: float = 0.10, rounds: int = 5000) -> np.ndarray:
    """max w'mu - aversion / 2 w'Cw with sum 1 and 0 <= w <= high, by accelerated projected gradients; a bound too low for a sum of 1 is raised."""
    n = len(mu)
    high = max(high, 1 / n)

    step = 1 / max(aversion * np.linalg.eigvalsh(cov)[-1], 1e-12)
    w = y = np.full(n, 1 / n)
    t = 1.0
    for _ in range(rounds):
        new = project(y + step * (mu - aversion * cov @ y), high)
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y, t = new + (t - 1) / t2 * (new - w), t2
        if np.abs(new - w).max() < 1e-13:
            break
        w = new
    return np.clip(w, 0, high) / np.clip(w, 0, high).sum()


def _medium(v: pd.DataFrame, positive: bool = False) -> pd.DataFrame:
    v = v[v.confidence == "medium"]
    return v[v.view_bps > 0] if positive else v


#: Of a strategy: (mean daily returns, cov, views with column at, seed) -> weights.
STRATEGIES: dict[str, Callable] = {}
#: Those that need no covariance: (number of assets, seed) -> weights.
FREE: dict[str, Callable] = {}


def strategy(f: Callable) -> Callable:
    STRATEGIES[f.__name__] = f
    return f


def _post(cov: np.ndarray, pi: np.ndarray, v: pd.DataFrame) -> np.ndarray:
    return posterior(cov, pi, v["at"].to_numpy(int), v.view_bps.to_numpy(float) / 1e4, np.square(v.sigma.to_numpy(float)))


@strategy
def bl_prior(mean, cov, v, seed):
    base = np.full(len(cov), 1 / len(cov))
    return mean_variance(prior(cov, base), cov)


@strategy
def mvo(mean, cov, v, seed):
    return mean_variance(mean * YEAR, cov)


@strategy
def bl_llm(mean, cov, v, seed):
    base = np.full(len(cov), 1 / len(cov))
    return mean_variance(_post(cov, prior(cov, base), v), cov)


def _tilted(cov, v):
    base = np.full(len(cov), 1 / len(cov))
    return tilt(_post(cov, prior(cov, base), v), base) if len(v) else base


@strategy
def bl_llm_tilt(mean, cov, v, seed):
    return _tilted(cov, _medium(v))


@strategy
def bl_llm_tilt_pos(mean, cov, v, seed):
    return _tilted(cov, _medium(v, True))


@strategy
def random_views(mean, cov, v, seed):
    n, rng = len(cov), np.random.default_rng(seed)
    drawn = pd.DataFrame({"at": np.arange(n), "view_bps": rng.normal(0, 84.5, n), "sigma": 0.03})
    return mean_variance(_post(cov, prior(cov, np.full(n, 1 / n)), drawn), cov)


@strategy
def shuffled_views(mean, cov, v, seed):
    m = _medium(v, True)
    return _tilted(cov, m.assign(at=np.random.default_rng(seed).choice(len(cov), len(m), replace=False)))


def random_n(n, seed):
    w = np.zeros(n)
    w[np.random.default_rng(seed).choice(n, min(10, n), replace=False)] = 1 / min(10, n)
    return w


FREE["random_n"] = random_n


#: The sums of a window, by pair of assets (a <= b).
SUMS = ("n", "sxy", "sx", "sy", "ssx", "ss")


def moments(rets: DataFrame, rebalances: DataFrame, rows: int = YEAR) -> DataFrame:
    """rebal_date, a, b (a <= b) and ``SUMS`` over the last ``rows`` return days up to each rebalance; dates with fewer have none. ``rets``: complete-case returns.

    Days are cut where any window begins or ends. The sums of each segment are one aggregation, summed up along the segments they are prefix sums, and a window is the difference of two of
    them: a day's products are formed once, however many windows hold it. Days, cuts and windows are a calendar, broadcast.
    """
    days = rets.select("date").distinct().withColumn("k", F.row_number().over(Window.orderBy("date")))
    top = rebalances.select("rebal_date").distinct().join(days, F.col("date") <= F.col("rebal_date")).groupBy("rebal_date").agg(F.max("k").alias("top")).where(F.col("top") >= rows)
    cuts = top.select(F.explode(F.array("top", F.col("top") - rows)).alias("k")).distinct().withColumn("cut", F.lit(1))
    before = Window.orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    days = days.join(F.broadcast(cuts), "k", "left").withColumn("seg", F.coalesce(F.sum("cut").over(before), F.lit(0)))
    ends = days.select("k", "seg")
    windows = top.join(ends, F.col("k") == F.col("top")).select("rebal_date", F.col("top"), F.col("seg").alias("last"))
    windows = windows.join(ends.select((F.col("k") + rows - 1).alias("top"), (F.col("seg") - 1).alias("first")), "top").select("rebal_date", "first", "last")

    own = rets.join(F.broadcast(days.select("date", "seg")), "date").select("seg", "date", "ticker", "ret")
    own = own.join(rets.groupBy("date").agg(F.sum(F.col("ret") * F.col("ret")).alias("s")), "date")
    left = own.select("seg", "date", F.col("ticker").alias("a"), F.col("ret").alias("x"), "s")
    both = left.join(own.select("date", F.col("ticker").alias("b"), F.col("ret").alias("y")), "date").where("a <= b")
    parts = both.groupBy("a", "b", "seg").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum("x").alias("sx"), F.sum("y").alias("sy"), F.sum(F.col("s") * F.col("x")).alias("ssx"), F.sum(F.col("s") * F.col("s")).alias("ss"))
    along = Window.partitionBy("a", "b").orderBy("seg").rowsBetween(Window.unboundedPreceding, 0)  # a row a segment: two a rebalance at most
    upto = parts.select("a", "b", "seg", *[F.sum(c).over(along).alias(c) for c in SUMS])
    edges = windows.select("rebal_date", F.explode(F.array(F.struct(F.col("last").alias("seg"), F.lit(1).alias("sign")), F.struct(F.col("first").alias("seg"), F.lit(-1).alias("sign")))).alias("e")).select("rebal_date", "e.*")
    return upto.join(F.broadcast(edges), "seg").groupBy("rebal_date", "a", "b").agg(*[F.sum(F.col(c) * F.col("sign")).alias(c) for c in SUMS])


def covariance(sums: DataFrame) -> DataFrame:
    """rebal_date, a, b, cov: annualised sample covariances of ``moments``."""
    return sums.select("rebal_date", "a", "b", (F.try_divide(F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"), F.col("n") - 1) * YEAR).alias("cov"))


def allocate(sums: DataFrame, at: DataFrame, views: DataFrame, names: list[str], seed: int = 0, shrink: bool = True, least: int = 60) -> DataFrame:
    """strategy, rebal_date, ticker, w, held. One group a rebalance date, whose covariance serves all strategies: it holds the ``moments`` of pairs, not days.

    ``at``: every rebal_date with every ticker. ``views``: rebal_date, ticker, view_bps, confidence, sigma. Where no covariance can be had (no window, fewer than ``least`` days, or
    an algebra that fails), a strategy that needs one holds what it has: a single row with null ticker and weight, ``held``.
    """

    def matrices(pairs: pd.DataFrame, tickers: list[str]) -> Moments | None:
        if not len(pairs) or not set(pairs.a) == set(tickers) or pairs.n.min() < least or pairs.n.min() != pairs.n.max():
            return None
        place = {t: i for i, t in enumerate(tickers)}
        i, j = pairs.a.map(place).to_numpy(), pairs.b.map(place).to_numpy()
        xx = np.zeros((len(tickers), len(tickers)))
        xx[i, j] = xx[j, i] = pairs.sxy
        own = i == j
        x, sx = np.zeros(len(tickers)), np.zeros(len(tickers))
        x[i[own]], sx[i[own]] = pairs.sx[own], pairs.ssx[own]
        return Moments(int(pairs.n.iloc[0]), x, xx, sx, float(pairs.ss.iloc[0]))

    def run(key, p: pd.DataFrame, v: pd.DataFrame) -> pd.DataFrame:
        out = []
        tickers = sorted(p[p.b.isna()].a)
        if tickers:
            m = matrices(p[p.b.notna()], tickers)
            v = v[v.ticker.isin(tickers)].assign(at=lambda d: [tickers.index(x) for x in d.ticker])
            cov = None if m is None else (shrunk_cov if shrink else sample_cov)(m)
            for name in names:
                own = stable_seed(str(key[0])[:10], seed)
                try:
                    w = FREE[name](len(tickers), own) if name in FREE else None if cov is None else STRATEGIES[name](m.mean, cov, v, own)
                except np.linalg.LinAlgError:
                    w = None
                out += [(name, key[0], None, None, True)] if w is None else [(name, key[0], t, float(x), False) for t, x in zip(tickers, w, strict=True)]
        return pd.DataFrame(out, columns=["strategy", "rebal_date", "ticker", "w", "held"])

    marks = at.select("rebal_date", F.col("ticker").alias("a"), F.lit(None).cast("string").alias("b"), *[F.lit(None).cast(k).alias(c) for c, k in sums.dtypes if c in SUMS])
    both = sums.select("rebal_date", "a", "b", *SUMS).unionByName(marks)
    tasks = 4 * sums.sparkSession.sparkContext.defaultParallelism  # few rows and long sums: a date a task, as far as there are tasks
    both, views = both.repartition(tasks, "rebal_date"), views.repartition(tasks, "rebal_date")
    return both.groupBy("rebal_date").cogroup(views.groupBy("rebal_date")).applyInPandas(run, "strategy string, rebal_date date, ticker string, w double, held boolean")
