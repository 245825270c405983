"""Rebalance calendars and trading periods."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Months in which a frequency rebalances at month-end, and whether the 15th counts too.
FREQUENCIES = {"quarterly": ((3, 6, 9, 12), False), "monthly_active": ((2, 3, 4, 5, 7, 8, 10, 11), False), "biweekly_active": ((2, 3, 4, 5, 7, 8, 10, 11), True)}


def rebalance_dates(spark: SparkSession, start: date, end: date, freq: str = "quarterly") -> DataFrame:
    """rebal_date: month-ends (and 15ths), moved back from weekends; holidays are not known."""
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency: {freq}")
    months, mid = FREQUENCIES[freq]
    first = spark.createDataFrame([(start.replace(day=1), end)], "s date, e date")
    month = first.select("e", F.explode(F.expr("sequence(s, e, interval 1 month)")).alias("m")).where(F.month("m").isin(*months))
    days = F.array(F.last_day("m"), F.date_add("m", 14)) if mid else F.array(F.last_day("m"))
    d = month.select("e", F.explode(days).alias("d")).withColumn("w", F.weekday("d"))
    moved = d.withColumn("rebal_date", F.expr("date_sub(d, greatest(0, w - 4))"))
    return moved.where((F.col("rebal_date") >= F.lit(start)) & (F.col("rebal_date") <= F.col("e"))).select("rebal_date").distinct()


def rebalances_between(span: DataFrame, freq: str = "quarterly") -> DataFrame:
    """As ``rebalance_dates`` for each row (s, e) of ``span``: freq, rebal_date from the first of the months to the last of them."""
    if freq not in FREQUENCIES:
        raise ValueError(f"unknown frequency: {freq}")
    months, mid = FREQUENCIES[freq]
    month = span.select("s", "e", F.explode(F.expr("sequence(trunc(s, 'month'), e, interval 1 month)")).alias("m")).where(F.month("m").isin(*months))
    each = month.select("s", "e", F.explode(F.array(F.last_day("m"), F.date_add("m", 14)) if mid else F.array(F.last_day("m"))).alias("d"))
    moved = each.withColumn("rebal_date", F.date_sub("d", F.greatest(F.lit(0), F.weekday("d") - 4)))
    return moved.where(F.col("rebal_date").between(F.col("s"), F.col("e"))).select(F.lit(freq).alias("freq"), "rebal_date").distinct()


def trade_periods(rebalances: DataFrame, days: DataFrame, min_rows: int = 262) -> DataFrame:
    """rebal_date, trade_date (first trading day after), until (the next period's trade date, or the last trading day).

    Rebalances with fewer than ``min_rows`` trading days of history, or none after, are skipped. ``days`` (date) has a row a trading day.
    """
    n = rebalances.join(days, days["date"] <= rebalances["rebal_date"]).groupBy("rebal_date").agg(F.count("date").alias("n"))
    after = rebalances.join(days, days["date"] > rebalances["rebal_date"]).groupBy("rebal_date").agg(F.min("date").alias("trade_date"))
    last = days.agg(F.max("date").alias("last_day"))
    w = Window.orderBy("rebal_date")  # a row a rebalance date
    have = after.join(n, "rebal_date").crossJoin(F.broadcast(last)).withColumn("until", F.coalesce(F.lead("trade_date").over(w), F.col("last_day")))
    return have.where(F.col("n") >= min_rows).select("rebal_date", "trade_date", "until")
