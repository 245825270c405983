"""Long price panels: grids, forward fill, returns, rolling features.

Nothing here is a window over a whole ticker: see ``scan``. A panel may carry ``n``, the rank of its dates, if every ticker has every date; else rows are numbered
by a scan where a frame needs it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.operators import scan

KEY = ["ticker"]


def grid(df: DataFrame, tickers: DataFrame | None = None) -> DataFrame:
    """Every date with every ticker, NULL where a ticker has no row; ``n`` is the date's rank, from 1. What is broadcast is a calendar: one row a trading day."""
    dates = df.select("date").distinct().withColumn("n", F.row_number().over(Window.orderBy("date")))
    names = (tickers if tickers is not None else df).select("ticker").distinct()
    return names.crossJoin(F.broadcast(dates)).join(df, ["ticker", "date"], "left")


def ranked(df: DataFrame) -> DataFrame:
    return df if "n" in df.columns else scan.numbered(df, KEY, ["date"], scan.days("date"))


def _same(out: DataFrame, df: DataFrame) -> DataFrame:
    return out.select(*df.columns)


def capped(df: DataFrame, end_year: int) -> DataFrame:
    """Rows up to the end of the quarter after ``end_year``."""
    return df.where(F.col("date") <= F.make_date(F.lit(end_year + 1), F.lit(3), F.lit(31)))


def smoothed(df: DataFrame, col: str, rows: int, limit: int) -> DataFrame:
    """``col``'s mean of the last ``rows`` rows, then filled forward over ``limit`` rows at most: both in one pass of blocks."""
    mean = lambda w: {col: F.avg(col).over(w.rowsBetween(1 - rows, 0))}
    fill = lambda w: {col: F.last(col, ignorenulls=True).over(w.rowsBetween(-limit, 0))}
    return _same(scan.framed(ranked(df), KEY, "n", [mean, fill], back=rows - 1 + limit), df)


def trailing_mean(df: DataFrame, col: str, rows: int) -> DataFrame:
    return _same(scan.framed(ranked(df), KEY, "n", [lambda w: {col: F.avg(col).over(w.rowsBetween(1 - rows, 0))}], back=rows - 1), df)


def ffill(df: DataFrame, col: str, limit: int | None = 5) -> DataFrame:
    """Last value not NULL of the ``limit`` rows before; ``None``: without limit."""
    if limit is None:
        return _same(scan.running(df, KEY, ["date"], scan.days("date"), col, "__filled").withColumn(col, F.col("__filled")), df)
    return _same(scan.framed(ranked(df), KEY, "n", [lambda w: {col: F.last(col, ignorenulls=True).over(w.rowsBetween(-limit, 0))}], back=limit), df)


def returns(df: DataFrame, pad: bool = True) -> DataFrame:
    """ticker, date, ret: simple returns. ``pad``: gaps are filled without limit first."""
    if pad:
        both = scan.running(df, KEY, ["date"], scan.days("date"), "close", "__p", previous="__before")
    else:
        both = scan.framed(ranked(df), KEY, "n", [lambda w: {"__p": F.col("close"), "__before": F.lag("close").over(w)}], back=1)
    return both.select("ticker", "date", (F.try_divide("__p", "__before") - 1).alias("ret"))


def complete_dates(rets: DataFrame, universe: DataFrame | None = None) -> DataFrame:
    """Rows of the dates on which every ticker has a return."""
    n = (universe if universe is not None else rets).select(F.count_distinct("ticker").alias("n_all"))
    full = rets.groupBy("date").agg(F.count("ret").alias("n_own")).join(F.broadcast(n), F.col("n_own") == F.col("n_all")).select("date")
    return rets.join(full, "date", "left_semi")


def _priced(df: DataFrame) -> DataFrame:
    """Rows with a price, numbered (m)."""
    return scan.numbered(df.where("close is not null").select("ticker", "date", "close"), KEY, ["date"], scan.days("date"), "m")


def momentum(df: DataFrame) -> DataFrame:
    """ret_1m (21 rows), ret_3m (63 rows), vol_60d, in percent; NULL while fewer than 63 (64 for 3m) rows exist."""

    def day(w):
        return {"ret": F.try_divide("close", F.lag("close").over(w)) - 1}

    def rolled(w):
        back = lambda k: F.try_divide("close", F.lag("close", k).over(w)) * 100 - 100
        return {"r21": back(21), "r63": back(63), "vol": F.stddev_samp("ret").over(w.rowsBetween(-59, 0)) * F.sqrt(F.lit(252.0)) * 100}

    base = scan.framed(_priced(df), KEY, "m", [day, rolled], back=63)
    return base.select(
        "ticker",
        "date",
        F.when(F.col("m") >= 63, F.col("r21")).alias("ret_1m"),
        F.when(F.col("m") >= 64, F.col("r63")).alias("ret_3m"),
        F.when(F.col("m") >= 63, F.col("vol")).alias("vol_60d"),
    )


def forward_return(df: DataFrame, horizon: int = 63) -> DataFrame:
    """ticker, date, fwd: return over the next ``horizon`` rows; NULL off the end or from a price that is not positive."""
    both = scan.framed(_priced(df), KEY, "m", [lambda w: {"ahead": F.lead("close", horizon).over(w)}], ahead=horizon)
    return both.select("ticker", "date", F.when(F.col("close") > 0, F.try_divide("ahead", "close") - 1).alias("fwd"))
