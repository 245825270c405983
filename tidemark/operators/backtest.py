"""Strategies and the backtest, in closed form: windows instead of a loop over days.

With target weights w of a period and G the growth of an asset since its start, the value is V = sum(w * G), a day's return V / V(previous) - 1, and
the weights at the end w * G / V. Turnover compares a period's targets with the weights at the end of the one before (the first: with
equal weights), and its cost is taken from the first day's return.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators.rounds import checkpointed


def equal_weight(periods: DataFrame, universe: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by``, rebal_date, ticker, w: 1 / N. ``periods``, a calendar, is broadcast; with ``by`` (of universe and periods) each universe has its own."""
    counted = universe.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    own = universe.select(*by, "ticker").join(counted, [*by]) if by else universe.select("ticker").crossJoin(F.broadcast(counted))
    at = F.broadcast(periods.select(*[c for c in by if c in periods.columns], "rebal_date"))
    on = [c for c in by if c in periods.columns]
    return (own.join(at, on) if on else own.crossJoin(at)).select(*by, "rebal_date", "ticker", (F.lit(1.0) / F.col("n")).alias("w"))


def ranked_views(periods: DataFrame, universe: DataFrame, active: DataFrame, n: int = 10, best: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """``by``, rebal_date, ticker, w: equal weights of the ``n`` best (worst) active views; ties by the universe's order in both directions; no views: equal weight.
    ``by``: columns of ``universe`` that tell several universes apart, all in one plan."""
    keys = [*by, "rebal_date"]
    order = Window.partitionBy(*keys).orderBy(F.col("view_bps").desc() if best else F.col("view_bps").asc(), "ord")
    top = active.join(universe, "ticker").withColumn("k", F.row_number().over(order)).where(F.col("k") <= n)
    w = top.withColumn("w", F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy(*keys))).select(*keys, "ticker", "w")
    every = universe.select(*by).distinct().crossJoin(F.broadcast(periods.select("rebal_date"))) if by else periods.select("rebal_date")
    none = every.join(w.select(*keys).distinct(), keys, "left_anti")
    return w.unionByName(equal_weight(none, universe, by))


def islands(weights: DataFrame, held: DataFrame, universe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """strategy, rebal_date, since: the rebalance whose targets a period drifts from, its own or, where it is ``held`` (strategy, rebal_date), the last one before; and the targets with equal
    weights for strategies that begin by holding."""
    each = weights.select("strategy", "rebal_date").distinct().withColumn("good", F.col("rebal_date"))
    each = each.unionByName(held.select("strategy", "rebal_date").distinct().withColumn("good", F.lit(None).cast("date")))
    upto = Window.partitionBy("strategy").orderBy("rebal_date").rowsBetween(Window.unboundedPreceding, 0)  # a row a rebalance
    own = each.withColumn("since", F.coalesce(F.last("good", ignorenulls=True).over(upto), F.first("rebal_date").over(upto)))
    begin = own.where("good is null and since = rebal_date").select("strategy", "rebal_date")
    n = universe.agg(F.count(F.lit(1)).alias("n"))
    start = universe.select("ticker").crossJoin(F.broadcast(begin)).crossJoin(F.broadcast(n)).select("strategy", "rebal_date", "ticker", (F.lit(1.0) / F.col("n")).alias("w"))
    return own.select("strategy", "rebal_date", "since"), weights.select("strategy", "rebal_date", "ticker", "w").unionByName(start)


def run(rets: DataFrame, periods: DataFrame, weights: DataFrame, universe: DataFrame, cost_bps: float = 10.0, held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Daily returns (strategy, date, ret) and rebalances (strategy, rebal_date, turnover, cost).

    ``weights``: strategy, rebal_date, ticker, w. ``rets``: complete-case returns. The periods are a small dimension. ``held`` (strategy, rebal_date): rebalances without
    targets, at which a strategy keeps its drifted weights; the closed form runs on from the last rebalance before, and nothing is traded. Weights, grown positions and both results are
    files: what reads them does not hold the plan of the whole backtest, each step of which is read several times.
    """
    weights = checkpointed(weights)
    days = rets.select("date").distinct()
    own = F.broadcast(periods)  # a calendar
    of = days.join(own, (days["date"] >= own["trade_date"]) & (days["date"] < own["until"])).select("date", "rebal_date")
    r = rets.join(of, "date").select("rebal_date", "ticker", "date", "ret")
    if held is None:
        live = r.join(weights.where("w <> 0"), ["rebal_date", "ticker"])
    else:
        since, weights = map(checkpointed, islands(weights, held, universe))
        live = r.join(since, "rebal_date").drop("rebal_date").withColumnRenamed("since", "rebal_date").join(weights.where("w <> 0"), ["strategy", "rebal_date", "ticker"])
    so_far = Window.partitionBy("strategy", "rebal_date", "ticker").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    grown = live.withColumn("wg", F.col("w") * F.exp(F.sum(F.log1p("ret")).over(so_far))).drop("ret")
    grown = checkpointed(grown)
    value = grown.groupBy("strategy", "rebal_date", "date").agg(F.sum("wg").alias("v"))
    value = checkpointed(value)
    by_day = Window.partitionBy("strategy", "rebal_date").orderBy("date")
    gross = value.withColumn("first", F.row_number().over(by_day) == 1).withColumn("gross", F.col("v") / F.coalesce(F.lag("v").over(by_day), F.lit(1.0)) - 1)

    ends = value.groupBy("strategy", "rebal_date").agg(F.max("date").alias("date"), F.max_by("v", "date").alias("v_end"))
    w_end = grown.join(ends, ["strategy", "rebal_date", "date"]).select("strategy", "rebal_date", "ticker", (F.col("wg") / F.col("v_end")).alias("w_end"))
    ran = ends.select("strategy", "rebal_date")
    order = ran.withColumn("next", F.lead("rebal_date").over(Window.partitionBy("strategy").orderBy("rebal_date")))
    came = w_end.join(order, ["strategy", "rebal_date"]).where("next is not null").select("strategy", F.col("next").alias("rebal_date"), "ticker", F.col("w_end").alias("w_old"))
    first = ran.groupBy("strategy").agg(F.min("rebal_date").alias("rebal_date"))
    start = universe.select("ticker").crossJoin(F.broadcast(first)).crossJoin(F.broadcast(universe.agg(F.count(F.lit(1)).alias("n"))))
    old = came.unionByName(start.select("strategy", "rebal_date", "ticker", (F.lit(1.0) / F.col("n")).alias("w_old")))
    target = weights.join(ran, ["strategy", "rebal_date"], "left_semi")
    moved = target.join(old, ["strategy", "rebal_date", "ticker"], "full").select("strategy", "rebal_date", F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("w_old", F.lit(0.0))).alias("d"))
    turns = moved.groupBy("strategy", "rebal_date").agg(F.sum("d").alias("turnover")).withColumn("cost", F.col("turnover") * F.lit(cost_bps / 1e4))
    turns = checkpointed(turns)
    net = gross.join(turns, ["strategy", "rebal_date"]).select("strategy", "date", (F.col("gross") - F.when(F.col("first"), F.col("cost")).otherwise(0.0)).alias("ret"))
    if held is not None:  # those that ran, but for the one that a strategy begins with
        still = since.where("since < rebal_date").join(of.select("rebal_date").distinct(), "rebal_date", "left_semi")
        turns = turns.unionByName(still.select("strategy", "rebal_date", F.lit(0.0).alias("turnover"), F.lit(0.0).alias("cost")))
    return checkpointed(net), turns


def mean_curve(curves: DataFrame, on: str) -> DataFrame:
    """date, mean, n of curves (strategy, date, v) on the dates of ``on``, each filled forward."""
    dates = curves.where(F.col("strategy") == on).select("date").distinct()
    names = curves.select("strategy").distinct()
    grid = dates.crossJoin(names).join(curves, ["strategy", "date"], "left")  # a row a date and strategy: the table's own size
    so_far = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    return grid.withColumn("v", F.last("v", ignorenulls=True).over(so_far)).groupBy("date").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def target_turnover(weights: DataFrame) -> DataFrame:
    """strategy, rebal_date, turnover between consecutive target weights; the first date has none. Dense over the tickers a strategy ever holds."""
    names = weights.select("strategy", "ticker").distinct()
    dates = weights.select("strategy", "rebal_date").distinct()
    dense = dates.join(names, "strategy").join(weights, ["strategy", "rebal_date", "ticker"], "left").withColumn("w", F.coalesce("w", F.lit(0.0)))
    before = F.lag("w").over(Window.partitionBy("strategy", "ticker").orderBy("rebal_date"))
    moved = dense.withColumn("d", F.abs(F.col("w") - before)).where("d is not null")
    return moved.groupBy("strategy", "rebal_date").agg(F.sum("d").alias("turnover"))
