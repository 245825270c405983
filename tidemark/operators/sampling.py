"""Samples that come out alike on any cluster: random halves, a stratified manifest with tiers, probe files."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def random_halves(spark: SparkSession, names: list[str], n: int, seed: int) -> DataFrame:
    """split, ticker, ord: the first half of ``names``, shuffled anew for each split by one generator. ``names`` is a dimension."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        own = names[:]
        rng.shuffle(own)
        rows += [(i, x, k) for k, x in enumerate(own[: len(own) // 2])]
    return spark.createDataFrame(rows, "split int, ticker string, ord int")


def quota(sizes: dict[str, int], order: list[str], total: int) -> dict[str, int]:
    """Rounded shares of ``total``; what rounding leaves goes to the first of ``order``."""
    every = sum(sizes.values()) or 1
    out = {p: round(total * sizes.get(p, 0) / every) for p in order}
    out[order[0]] += total - sum(out.values())
    return out


def chosen(rows: list[tuple], want: dict[str, int], order: list[str], annual: float) -> list[tuple]:
    """Rows (id, ticker, form, period) in the order of the draw: annual forms up to their share, then quarterly ones, all of tickers that were not
    used before; where these are too few, any."""
    used: set = set()
    out: list[tuple] = []
    for p in order:
        pool, picked = [r for r in rows if r[3] == p], []
        for form, limit in (("10-K", round(want[p] * annual)), ("10-Q", want[p])):
            for r in pool:
                if len(picked) < limit and r[2] == form and r[1] not in used:
                    picked.append(r)
                    used.add(r[1])
        have = {r[0] for r in picked}
        for r in pool:
            if len(picked) < want[p] and r[0] not in have:
                picked.append(r)
                have.add(r[0])
        out += picked
    return out


def manifest(df: DataFrame, periods: list[str], total: int = 90, annual: float = 0.22, tiers: tuple[int, int] = (5, 15), seed: str = "20260829") -> DataFrame:
    """id, ticker, form, period, tier of ``total`` rows of ``df`` (id, ticker, form, period), drawn by a hash of id and seed.

    Only candidates come to the driver: of each period and form the first row of each of its first ``2 * total`` tickers, and of each period its first
    ``2 * total`` rows. More are never looked at: a draw uses ``total`` tickers at most.
    """
    spark = df.sparkSession
    own = df.where(F.col("period").isin(periods)).select("id", "ticker", "form", "period", F.md5(F.concat_ws("|", F.col("id").cast("string"), F.lit(seed))).alias("h"))
    sizes = {r["period"]: r["count"] for r in own.groupBy("period").count().collect()}
    first = own.withColumn("k", F.row_number().over(Window.partitionBy("period", "form", "ticker").orderBy("h", "id"))).where("k = 1")
    first = first.withColumn("k", F.row_number().over(Window.partitionBy("period", "form").orderBy("h", "id"))).where(F.col("k") <= 2 * total)
    every = own.withColumn("k", F.row_number().over(Window.partitionBy("period").orderBy("h", "id"))).where(F.col("k") <= 2 * total)
    rows = sorted({(r.h, r.id, r.ticker, r.form, r.period) for r in first.unionByName(every).collect()})
    want = quota(sizes, periods, min(total, sum(sizes.values())))
    got = chosen([r[1:] for r in rows], want, periods, annual)
    mark = {r[1]: r[0] for r in rows}
    got.sort(key=lambda r: mark[r[0]][::-1])  # another order than that of the draw
    label = lambda i: "tuning" if i < tiers[0] else "evaluation" if i < sum(tiers) else "pool"
    types = dict(df.dtypes)
    return spark.createDataFrame([(*r, label(i)) for i, r in enumerate(got)], f"id {types['id']}, ticker {types['ticker']}, form string, period string, tier string")


def probe(df: DataFrame, ticker: str, year: str, key: str, years: list[int], tickers: int, most: int, every: DataFrame) -> DataFrame:
    """ticker, year, key of the first file of each of ``years`` of the first ``tickers`` names of ``every``; ``most`` in all."""
    names = every.select(ticker).distinct().orderBy(ticker).limit(tickers)
    w = Window.partitionBy(ticker, year).orderBy(key)
    own = df.where(F.col(year).isin(years)).join(F.broadcast(names), ticker).withColumn("__k", F.row_number().over(w)).where("__k = 1")
    return own.orderBy(ticker, year).limit(most).select(ticker, year, key)
