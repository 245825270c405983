"""Return and risk metrics by strategy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

YEAR = 252


def metrics(rets: DataFrame, rf: float = 0.02) -> DataFrame:
    """strategy, n_days, total_return, ann_return, ann_vol, sharpe, sortino, max_drawdown, calmar of daily returns (strategy, date, ret).

    The peak of the drawdown starts at the first day's value; the downside is the sample deviation of the days' shortfalls around their own mean.
    """
    rf_day = (1 + rf) ** (1 / YEAR) - 1
    day = Window.partitionBy("strategy").orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    path = rets.withColumn("v", F.exp(F.sum(F.log1p("ret")).over(day)))
    path = path.withColumn("dd", F.col("v") / F.max("v").over(day) - 1)
    short = F.when(F.col("ret") < rf_day, F.col("ret") - rf_day)
    base = path.groupBy("strategy").agg(
        F.count("ret").alias("n_days"),
        F.exp(F.sum(F.log1p("ret"))).alias("growth"),
        (F.coalesce(F.stddev_samp("ret"), F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))).alias("ann_vol"),
        (F.coalesce(F.stddev_samp(short), F.lit(0.0)) * F.sqrt(F.lit(float(YEAR)))).alias("down"),
        F.min("dd").alias("max_drawdown"),
    )
    out = base.withColumn("total_return", F.col("growth") - 1).withColumn("ann_return", F.when(F.col("n_days") > 0, F.pow("growth", F.lit(float(YEAR)) / F.col("n_days")) - 1).otherwise(0.0))
    ratio = lambda a, b: F.when(F.col(b) == 0, 0.0).otherwise(a / F.col(b))
    return out.select(
        "strategy",
        "n_days",
        "total_return",
        "ann_return",
        "ann_vol",
        ratio(F.col("ann_return") - rf, "ann_vol").alias("sharpe"),
        ratio(F.col("ann_return") - rf, "down").alias("sortino"),
        "max_drawdown",
        F.when(F.col("max_drawdown") == 0, 0.0).otherwise((F.col("ann_return") - rf) / F.abs("max_drawdown")).alias("calmar"),
    )


def t_test(diff: DataFrame, col: str) -> DataFrame:
    """n, mean, t of one sample against 0."""
    n, s = F.count(col), F.stddev_samp(col)
    return diff.agg(n.alias("n"), F.avg(col).alias("mean"), F.try_divide(F.avg(col), F.try_divide(s, F.sqrt(n))).alias("t"))


def annualised_difference(col):
    """(1 + m) ** 252 - 1."""
    return F.pow(F.lit(1.0) + col, F.lit(float(YEAR))) - 1
