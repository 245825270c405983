"""Buckets, ranks, regressions, tests and resampling."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.quantiles import quantiles
from tidemark.operators.rounds import checkpointed


def buckets(df: DataFrame, by: str) -> DataFrame:
    """n, mean and median of fwd_excess, and the share of views (not 0) whose sign was right."""
    hit = F.when(F.col("view_bps") != 0, (F.signum("view_bps") == F.signum("fwd_excess")).cast("int"))
    means = df.groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.avg("fwd_excess").alias("mean"), F.avg(hit).alias("hit"))
    medians = quantiles(df, [by], "fwd_excess", [0.5]).select(F.col(by).alias("__by"), F.col("q")[0].alias("median"))
    return means.join(medians, F.col(by).eqNullSafe(F.col("__by"))).select(by, "n", "mean", "median", "hit")


def tertiles(df: DataFrame, col: str, out: str, labels: tuple[str, str, str] = ("lo", "mid", "hi")) -> DataFrame:
    """Right-closed thirds between interpolated quantiles, so that ties stay together. Equal edges leave no thirds: an empty result."""
    e = quantiles(df, [], col, [0.0, 1 / 3, 2 / 3, 1.0], "e")
    e = e.where("e[0] < e[1] and e[1] < e[2] and e[2] < e[3]")
    own = df.crossJoin(F.broadcast(e))  # one row of edges
    return own.withColumn(out, F.when(F.col(col) <= F.col("e")[1], labels[0]).when(F.col(col) <= F.col("e")[2], labels[1]).otherwise(labels[2])).drop("e")


def average_rank(df: DataFrame, col: str, out: str, pieces: int = 64) -> DataFrame:
    """Average ranks of ties of a number. Counts of distinct values are summed up by value within ``pieces`` ranges, and the ranges' totals
    before them: no task sees all values, however many are distinct."""
    counts = df.groupBy(col).agg(F.count(F.lit(1)).alias("__c"))
    edges = sorted(set(counts.approxQuantile(col, [i / pieces for i in range(1, pieces)], 0.01)))  # fewer than ``pieces``
    own = counts.withColumn("__p", sum((F.col(col) > F.lit(e)).cast("int") for e in edges) if edges else F.lit(0))
    totals = own.groupBy("__p").agg(F.sum("__c").alias("__n"))  # a row a range
    ahead = totals.select("__p", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    before = F.coalesce(F.sum("__c").over(Window.partitionBy("__p").orderBy(col).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranks = own.withColumn("__before", before).join(F.broadcast(ahead), "__p")
    return df.join(ranks.select(col, (F.col("__ahead") + F.col("__before") + (F.col("__c") + 1) / 2).alias(out)), col)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, rank_ic."""
    both = checkpointed(df.select(a, b).where(f"{a} is not null and {b} is not null"))  # read for the ranges' edges, the counts and the ranks
    ranked = average_rank(average_rank(both, a, "ra"), b, "rb")
    return ranked.agg(F.count(F.lit(1)).alias("n"), F.corr("ra", "rb").alias("rank_ic"))


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function, by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_inc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            num = 1.0
        elif i % 2 == 0:
            num = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            num = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + num * d if abs(1 + num * d) > 1e-300 else 1e-300)
        c = 1 + num / c if abs(1 + num / c) > 1e-300 else 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def t_p_value(t: float, df: float) -> float:
    """Two-sided p of Student's t."""
    return beta_inc(df / 2, 0.5, df / (df + t * t)) if math.isfinite(t) else float("nan")


def ols(df: DataFrame, by: str, y: str, xs: list[str]) -> DataFrame:
    """``by``, n, alpha, t_alpha, p_alpha, betas, t_betas, r2 of least squares with a constant.

    The normal equations' sums are one aggregation, whatever the number of rows; each group's few sums are solved in one row.
    """
    cols = ["__one", *xs]
    base = df.withColumn("__one", F.lit(1.0))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = base.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.sum(F.col(cols[i]) * F.col(cols[j])) for i, j in pairs]).alias("xx"),
        F.array(*[F.sum(F.col(c) * F.col(y)) for c in cols]).alias("xy"),
        F.sum(F.col(y) * F.col(y)).alias("yy"),
    )
    k = len(cols)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples(index=False):
            a = np.zeros((k, k))
            for v, (i, j) in zip(r.xx, pairs, strict=True):
                a[i, j] = a[j, i] = v
            xy, n = np.array(r.xy), int(r.n)
            inv = np.linalg.pinv(a)
            beta = inv @ xy
            sse, mean = float(r.yy - beta @ xy), xy[0] / n
            dof = n - k
            errors = [math.sqrt(max(0.0, sse / dof * v)) if dof > 0 else float("nan") for v in np.diag(inv)]
            ts = [float(b / e) if e else float("nan") for b, e in zip(beta, errors, strict=True)]
            t = ts[0]
            tss = float(r.yy - n * mean * mean)
            out.append((getattr(r, by), n, beta[0], t, t_p_value(t, dof) if dof > 0 else float("nan"), beta[1:].tolist(), ts[1:], 1 - sse / tss if tss else float("nan")))
        return pd.DataFrame(out, columns=[by, "n", "alpha", "t_alpha", "p_alpha", "betas", "t_betas", "r2"])

    return sums.mapInPandas(lambda it: (solve(p) for p in it), f"{by} string, n long, alpha double, t_alpha double, p_alpha double, betas array<double>, t_betas array<double>, r2 double")


def paired(df: DataFrame, a: str, b: str) -> DataFrame:
    """n, the means and population deviations of ``a`` and ``b``, the mean difference, wins of ``a``, t and two-sided p of the paired test."""
    x = F.col(a) - F.col(b)
    sums = df.where(f"{a} is not null and {b} is not null").agg(
        F.count(F.lit(1)).alias("n"), F.avg(a).alias(f"mean_{a}"), F.stddev_pop(a).alias(f"sd_{a}"), F.avg(b).alias(f"mean_{b}"), F.stddev_pop(b).alias(f"sd_{b}"),
        F.avg(x).alias("diff"), F.stddev_pop(x).alias("sd_diff"), F.count(F.when(x > 0, 1)).alias("wins"), F.try_divide(F.avg(x), F.try_divide(F.stddev_samp(x), F.sqrt(F.count(F.lit(1))))).alias("t"),
    )

    def add(it):
        for p in it:
            p["p"] = [t_p_value(float(t), int(n) - 1) if n > 1 and t == t and t is not None else float("nan") for t, n in zip(p["t"], p["n"], strict=True)]
            yield p

    return sums.mapInPandas(add, ", ".join(f"`{c}` {k}" for c, k in sums.dtypes) + ", p double")


#: Draws of one row.
DRAWS = 100


def drawn_sharpe(r: np.ndarray, name: str, draw: int, seed: int, rf: float) -> float:
    """The Sharpe ratio of one draw of as many days, with replacement."""
    key = int.from_bytes(hashlib.blake2b(name.encode(), digest_size=8).digest(), "big")
    rng = np.random.Generator(np.random.Philox(key=[seed, key], counter=[0, 0, 0, draw]))
    s = r[rng.integers(0, len(r), len(r))]
    vol = s.std(ddof=1) * math.sqrt(252) if len(s) > 1 else 0.0
    return (math.exp(np.log1p(s).sum() * 252 / len(s)) - 1 - rf) / vol if vol else 0.0


def bootstrap_sharpe(rets: DataFrame, draws: int = 10_000, seed: int = 42, rf: float = 0.02) -> DataFrame:
    """strategy, n, sharpe_lo, sharpe_hi: 2.5 and 97.5 percentiles over resampled days.

    A draw's numbers come from a counter-based generator keyed by seed and strategy, at a counter of the draw's own: any task can make any draw, and the interval is the
    same however they are laid out. ``DRAWS`` draws of a strategy are a row that carries its days, which number hundreds a year.
    """
    days = rets.groupBy("strategy").agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "ret"))), lambda x: x["ret"]).alias("r"))
    days = checkpointed(days)
    first = F.explode(F.sequence(F.lit(0), F.lit(draws - 1), F.lit(DRAWS)))
    blocks = days.select("strategy", "r", first.alias("first"))
    blocks = blocks.repartition(rets.sparkSession.sparkContext.defaultParallelism, "strategy", "first")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            out = [(name, k, drawn_sharpe(np.asarray(r), name, k, seed, rf)) for name, r, k0 in zip(p.strategy, p.r, p["first"], strict=True) for k in range(k0, min(k0 + DRAWS, draws))]
            yield pd.DataFrame(out, columns=["strategy", "draw", "sharpe"])

    drawn = blocks.mapInPandas(run, "strategy string, draw int, sharpe double")
    q = quantiles(drawn, ["strategy"], "sharpe", [0.025, 0.975])
    return days.select("strategy", F.size("r").cast("long").alias("n")).join(q, "strategy").select("strategy", "n", F.col("q")[0].alias("sharpe_lo"), F.col("q")[1].alias("sharpe_hi"))


def summary(df: DataFrame, by: str, col: str) -> DataFrame:
    """n, mean, sample sd, min, max, p5, p95 (interpolated)."""
    sums = df.groupBy(by).agg(F.count(col).alias("n"), F.avg(col).alias("mean"), F.stddev_samp(col).alias("sd"), F.min(col).alias("lo"), F.max(col).alias("hi"))
    q = quantiles(df, [by], col, [0.05, 0.95]).select(F.col(by).alias("__by"), F.col("q")[0].alias("p5"), F.col("q")[1].alias("p95"))
    return sums.join(q, F.col(by).eqNullSafe(F.col("__by"))).drop("__by")
